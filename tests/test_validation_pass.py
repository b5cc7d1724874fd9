"""Validation of documents reads and works them out once (finding F18)."""

from corvane.operators import dedup, quality

SCHEMA = "document_id string, extraction_status string, extraction_error string, char_count long, token_count long, is_duplicate boolean, duplicate_of string, duplicate_type string, near_duplicates array<struct<document_id:string,relation:string,jaccard:double,containment:double>>, image_only_units array<int>"


def test_documents_are_scanned_once(spark, tmp_path):
    near = [("b", "near_duplicate", 0.9, 0.95), ("A", "overlap", 0.3, 0.6)]
    rows = [
        ("a", "ok", None, 500, 120, True, "z", "exact_file", near, [2, 5]), ("b", "failed", "bad file", 0, 0, True, "z", "exact_file", near, [1]), ("c", "ok", None, None, None, False, None, None, None, None),
        ("d", "ok", None, 9, 2, None, None, None, [], []), (None, "ok", None, 600, 200, False, None, None, [], []), ("e", None, None, 0, 0, False, None, None, [], []),
    ]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    docs = spark.read.parquet(path)
    found = quality.document_issues(docs, spark.createDataFrame([("a",), ("a",), ("c",)], "document_id string"))
    want = {
        ("warning", "image_only_content", "a", "2 page(s)/slide(s) have images but almost no text: 2, 5"), ("info", "duplicate_document", "a", "exact_file duplicate of z"), ("info", "near_duplicate", "a", "with b (jaccard=0.9, containment=0.95)"),
        ("error", "extraction_failed", "b", "bad file"), ("error", "empty_document", "c", "no text extracted"), ("warning", "tiny_document", "d", "only 2 tokens extracted"), ("error", "no_chunks", "d", "document produced no chunks"),
        ("error", "no_chunks", None, "document produced no chunks"),
    }
    got = found.select("level", "code", "document_id", "message").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and found.where("chunk_id is not null").isEmpty()
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1  # the version before scanned them seven times


def test_texts_of_duplicates_are_hashed_once(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(0, "a copy.txt", "One two"), (1, "b.txt", "One two"), (2, "c.txt", "one, two!"), (3, "d.txt", None), (4, "e.txt", " "), (5, "f.txt", " ")], "doc_id long, name string, text string").write.parquet(path)
    found = dedup.exact_duplicates(spark.read.parquet(path), "name")
    assert sorted(map(tuple, found.collect())) == [(0, 1, "exact_file"), (2, 1, "identical_text"), (5, 4, "exact_file")]
    assert "sha2" not in found._jdf.queryExecution().optimizedPlan().toString()  # it was in each of four scans
