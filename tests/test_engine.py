"""Hand-computed cases for retrieval, metrics, dedup, text, dialogue, assessment, chunking and files."""

import math
import random
import uuid

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import assessment, chunk, clean, dedup, dialogue, metrics, quality, retrieval
from corvane.sources import files
from corvane.streaming.sessions import stream_states


CODE = ["int x = 1;", "  {", "}", "#define N 3", "while (x)", "a = b + c", "foo(); // why", "return", "x += 1", "} else", "for (;;) { a b c d e f g h i j k l m n o p"]
PROSE = ["This is a long sentence about locks.", "", "  ", "• int x;", "1) int x;", "a. return", "see http://x.org", "for example the lock", "one two three four five six;.", "if (a) b c d e f g h i j k l m n o", None]


def test_code_like(spark):
    rows = spark.createDataFrame([(t,) for t in CODE + PROSE], "t string").select("t", T.code_like(F.col("t")).alias("c")).collect()
    assert [(r.t, r.c) for r in rows] == [(t, True) for t in CODE] + [(t, False) for t in PROSE]


def test_text_loader(spark):
    text = "# Title \n\nfirst line\r\nsecond\n```c\n\n  int x;\n# no heading\n```\nafter\nint y;\nend\n\n### Deep\nlast"
    rows = spark.createDataFrame([("a", text.encode()), ("b", b""), ("c", b"bad \xff byte"), ("d", b"```\nopen")], "document_id string, content binary")
    got = {}
    for r in files.text_lines(rows).orderBy("document_id", "line").collect():
        got.setdefault(r.document_id, []).append((r.kind, r.text, r.level, r.para_break))
    assert got["a"] == [
        ("heading", "Title", 1, "para"), ("text", "first line", 0, "para"), ("text", "second", 0, "wrap"), ("code", "", 0, "wrap"), ("code", "  int x;", 0, "wrap"),
        ("code", "# no heading", 0, "wrap"), ("text", "after", 0, "para"), ("code", "int y;", 0, "wrap"), ("text", "end", 0, "wrap"), ("heading", "Deep", 3, "para"), ("text", "last", 0, "para"),
    ]
    assert got["c"] == [("text", "bad \ufffd byte", 0, "para")] and got["d"] == [("code", "open", 0, "wrap")] and "b" not in got


def test_marked_markdown(spark):
    rows = [("d", 0, "section", 0, "heading", "T", 9), ("d", 0, "section", 1, "list_item", "a", 0), ("d", 0, "section", 2, "list_item", "b", 1), ("s", 1, "slide", 0, "notes", "n", 0), ("s", 2, "slide", 0, "code", "x;", 0), ("s", 2, "slide", 1, "paragraph", "p", 0)]
    blocks = spark.createDataFrame(rows, clean.BLOCKS)
    docs = spark.createDataFrame([("d", "d.md"), ("s", "s.pptx"), ("e", "e.txt")], "document_id string, filename string")
    got = dict(clean.marked_markdown(blocks, docs).collect())
    assert got["d"] == "<!-- d.md -->\n\n<!-- section -->\n###### T\n\n- a\n  - b\n"
    assert got["s"] == "<!-- s.pptx -->\n\n<!-- slide 1 -->\nSpeaker notes: n\n\n<!-- slide 2 -->\n```\nx;\n```\n\np\n" and got["e"] == "<!-- e.txt -->\n"
    assert dict(clean.markdown(blocks).collect())["s"] == "Speaker notes: n\n\n```\nx;\n```\n\np"


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def test_text(spark):
    assert one(spark, T.tokens, "Lock, semaphore? pthread_join x_ É") == ["lock", "semaphore", "pthread_join", "x"]
    assert one(spark, T.shingles, "a b c") == ["a b c"] and one(spark, T.shingles, "?!") == []
    assert one(spark, T.shingles, "a b c d e f") == ["a b c d e", "b c d e f"]
    assert one(spark, T.repair_glyphs, "oﬃce  c⃝­") == "office • ©"
    assert one(spark, T.point_id, "chunk:1") == str(uuid.uuid5(uuid.NAMESPACE_URL, "chunk:1"))
    assert one(spark, T.document_id, "OS/Lecture 13 (final).pdf").startswith("lecture-13-final-")


CORPUS = ["lock lock mutex", "semaphore wait", "lock semaphore semaphore semaphore"]


def corpus(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_bm25(spark):
    asked = spark.createDataFrame([(0, "Lock, semaphore?")], "query_id long, text string")
    found = retrieval.bm25(corpus(spark, CORPUS), asked, 10).orderBy("rank").collect()
    assert [r.doc_id for r in found] == [2, 0, 1]
    assert retrieval.index_stats(corpus(spark, CORPUS)).first().avgdl == 3
    ties = retrieval.bm25(corpus(spark, ["mutex lock", "condition variable", "mutex lock"]), spark.createDataFrame([(0, "mutex")], "query_id long, text string"), 10)
    assert [r.doc_id for r in ties.orderBy("rank").collect()] == [0, 2]


def test_rrf(spark):
    rows = lambda ids: spark.createDataFrame([(0, i + 1, d) for i, d in enumerate(ids)], "query_id long, rank int, doc_id long")
    got = retrieval.rrf({"dense": rows([0, 1, 2]), "bm25": rows([2, 3, 0])}, 4).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [0, 2, 1, 3] and got[0].score == round(1 / 61 + 1 / 63, 6) and got[0].bm25_rank == 3


def test_filters(spark):
    for bad in ({"x": "a"}, {"source": []}, {"source": None}, {"source": [1]}):
        with pytest.raises(ValueError):
            retrieval.check_filters(bad)
    for bad in (0, -1, True, "3"):
        with pytest.raises(ValueError):
            retrieval.check_top_k(bad)
    t = spark.createDataFrame([("a", ["x", "y"]), ("b", ["z"])], "source string, subtopics array<string>")
    assert [r.source for r in retrieval.filter_rows(t, {"subtopics": ["y", "q"]}).collect()] == ["a"]
    assert retrieval.parse_filters(["a=1", "a=2"]) == {"a": ["1", "2"]}


def scores(spark, ranked, graded, **more):
    run = spark.createDataFrame([(0, i + 1, ord(d)) for i, d in enumerate(ranked)], "query_id long, rank int, doc_id long")
    rel = spark.createDataFrame([(0, ord(d), g) for d, g in graded.items()], "query_id long, doc_id long, grade int")
    return metrics.per_query(run, rel, spark.createDataFrame([(0,)], "query_id long"), **more).first()


def test_metrics(spark):
    graded = {"a": 2, "b": 1, "c": 2}
    got = scores(spark, "xaybz", graded)
    assert (got.recall_5, got.precision_5, got.mrr_5) == (round(2 / 3, 6), 0.4, 0.5)
    assert scores(spark, "xayb", graded).ndcg_5 == round((2 / math.log2(3) + 1 / math.log2(5)) / (2 + 2 / math.log2(3) + 0.5), 6)
    assert scores(spark, "axb", graded).map_5 == round((1 + 2 / 3) / 3, 6)
    assert sum(scores(spark, "", graded)[1:]) == 0 and sum(scores(spark, "ab", {})[1:]) == 0


def test_dedup(spark):
    words = " ".join(f"word{i}" for i in range(300))
    docs = spark.createDataFrame([(1, "A copy.txt", words), (2, "B.txt", words), (3, "C.txt", words + " extra tail words here"), (4, "D.txt", words.upper()), (5, "E.txt", "  ")], "doc_id long, filename string, text string")
    assert {(r.doc_id, r.duplicate_of, r.duplicate_type) for r in dedup.exact_duplicates(docs, "filename").collect()} == {(1, 2, "exact_file"), (4, 2, "identical_text")}
    pairs = dedup.near_duplicate_pairs(docs.select("doc_id", "text")).collect()
    assert [(r.a, r.b, r.relation, r.jaccard, r.containment) for r in pairs] == [(1, 3, "near_duplicate", 0.987, 1.0)]
    members = dedup.shingle_classes(docs)
    assert {r.doc_id: r.class_id for r in members.collect()} == {1: 1, 2: 1, 4: 1, 3: 3}
    near = dedup.adjacency(dedup.near_duplicate_pairs(docs.select("doc_id", "text")), members).collect()
    assert {r.doc_id: (r.n_near_duplicates, [(n.document_id, n.documents) for n in r.near_duplicates]) for r in near} == {1: (3, [(1, 2), (3, 1)]), 2: (3, [(1, 2), (3, 1)]), 4: (3, [(1, 2), (3, 1)]), 3: (3, [(1, 3)])}
    assert dedup.count_pairs(dedup.near_duplicate_pairs(docs.select("doc_id", "text")), members).first()[0] == 6


def test_dialogue(spark):
    text = "A [S9] B [S1] C [Wikipedia] D [Source] E [general knowledge]."
    assert one(spark, lambda c: dialogue.validated(c, F.lit(2)), text) == "A B [S1] C D E."
    assert one(spark, lambda c: dialogue.validated(c, F.lit(2)), "x [S1, S2] [TIP]") == "x [S1] [S2] [TIP]"
    assert [one(spark, dialogue.is_new_question, t) for t in ("What is a semaphore?", "skip", "the lock is held?", None)] == [True, False, False, False]
    assert one(spark, dialogue.analysis, 'x {"level": "solid", "gap": ""} y').level == "solid" and one(spark, dialogue.analysis, "no").level == "unclear"
    rows = [(s, i, a, lv) for s, (asides, levels) in enumerate([((0, 0), ("solid", "solid")), ((0, 0, 0, 0), ("unclear", "partial", "unclear", "solid")), ((0, 1, 0), ("misconception", None, "solid"))]) for i, (a, lv) in enumerate(zip(map(bool, asides), levels, strict=True))]
    got = dialogue.dialogue_states(spark.createDataFrame(rows, "session_id long, turn long, aside boolean, level string")).orderBy("session_id", "turn").collect()
    assert [r.stage for r in got] == ["CHECK", "DONE", "EXPLAIN", "EXPLAIN", "DONE", "DONE", "EXPLAIN", "EXPLAIN", "DONE"]
    assert [r.kind for r in got] == ["CHECK", "WRAP_UP", "EXPLAIN", "EXPLAIN", "ANSWER", "ERROR", "EXPLAIN", "ASIDE", "WRAP_UP"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(s, t, (s + t) % 4 == 0, ["solid", "unclear", "partial"][(s * t) % 3]) for s in range(5) for t in range(4)]
    schema = "session_id long, turn long, aside boolean, level string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    live = stream_states(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    query = live.writeStream.format("memory").queryName("states").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    want = dialogue.dialogue_states(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, spark.sql("select * from states").collect())) == sorted(map(tuple, want.collect()))


def test_dialogue_states_by_hand(spark):
    """A plain machine, reply by reply, over sessions with asides, null levels and replies after the end."""
    rng = random.Random(5)
    rows = [(s, t, rng.choice([True, False, False, None]), rng.choice(["solid", "unclear", "partial", None])) for s in range(150) for t in range(rng.randrange(9))]
    want = []
    for s in range(150):
        stage, rounds = "DIAGNOSE", 0
        for _, turn, aside, level in (r for r in rows if r[0] == s):
            if stage == "DONE":
                kind = "ERROR"
            elif aside:
                kind = "ASIDE"
            elif level == "solid":
                kind, stage = ("CHECK", "CHECK") if stage == "DIAGNOSE" else ("WRAP_UP", "DONE")
            elif rounds < 2:
                kind, stage, rounds = "EXPLAIN", "EXPLAIN", rounds + 1
            else:
                kind, stage = "ANSWER", "DONE"
            want.append((s, turn, stage, rounds, kind))
    got = dialogue.dialogue_states(spark.createDataFrame(rows, "session_id long, turn long, aside boolean, level string"))
    assert sorted(map(tuple, got.collect())) == want


def test_gains(spark):
    items = spark.createDataFrame([(f, "i", "LO", 1) for f in ("pre", "post")], "form string, item_id string, objective_id string, max_score int")
    points = spark.createDataFrame([(1, "pre", "i", 0), (1, "post", "i", 1), (2, "pre", "i", 1), (2, "post", "i", 1)], "participant_id long, form string, item_id string, points int")
    people = spark.createDataFrame([(1,), (2,)], "participant_id long")
    row = assessment.class_gains(assessment.participant_gains(items, points, people)).first()
    assert (row.pre, row.post, row.normalized_gain, row.mean_individual_normalized_gain) == (50, 100, 1.0, 1.0)
    with pytest.raises(ValueError):
        assessment.check(items, points.withColumn("points", F.lit(3)))


def test_gains_with_and_without_a_broadcast(spark, monkeypatch):
    items = spark.createDataFrame([(f, f"{o}{i}", o, 2) for f in ("pre", "post") for o in "abc" for i in range(2)], "form string, item_id string, objective_id string, max_score int")
    points = spark.createDataFrame([(p, f, f"{o}0", (p + len(f)) % 3) for p in range(5) for f in ("pre", "post") for o in "ab"], "participant_id long, form string, item_id string, points int")
    people = spark.createDataFrame([(p,) for p in range(6)], "participant_id long")  # one without any score
    gains = lambda: sorted(map(tuple, assessment.participant_gains(items, points, people, by_objective=True).collect()), key=str)
    want = gains()
    assert len(want) == 18 and (5, "c", 0, 0, 0, 0) in want
    monkeypatch.setattr(assessment, "SENT", 2)
    assert gains() == want


def test_clean_and_chunk():
    row = lambda text, kind="text", brk="para", **k: {"text": text, "kind": kind, "level": k.get("level", 0), "para_break": brk, "x0": None, "cw": None}
    got = clean.assemble([row("A multi-"), row("thread test", brk="wrap"), row("1. item", brk="wrap"), row("x;", "code"), row("go on"), row("y;", "code"), row("• one")], set(), True)
    assert [(b["type"], b["text"]) for b in got] == [("paragraph", "A multithread test"), ("paragraph", "1. item"), ("code", "x;\ngo on\ny;"), ("list_item", "one")]
    block = lambda kind, text, level=0: {"type": kind, "text": text, "level": level, "unit": 1, "unit_kind": "page"}
    long = "word " * 100
    chunks = chunk.chunk_blocks("d", [block("heading", "Tiny intro", 1), block("heading", "Big section", 2), *[block("paragraph", long.strip())] * 12])
    assert len(chunks) > 2 and all(c["token_count"] <= 600 for c in chunks) and chunks[0]["text"].startswith("# Tiny intro\n\n## Big section")
    assert chunks[0]["section"] == "Tiny intro > Big section"
    quiz = [block("paragraph", f"{n}. Why {n}?") if half == 0 else block("paragraph", "Ans: so") for n in (1, 2, 3) for half in (0, 1)]
    assert [(c["chunk_type"], c["question_number"], c["has_answer"]) for c in chunk.chunk_blocks("q", quiz)] == [("qa_pair", n, True) for n in (1, 2, 3)]


def test_files(spark, tmp_path):
    (tmp_path / "in/OS").mkdir(parents=True)
    (tmp_path / "in/OS/notes.md").write_text("# Head\n\nSome prose here\ngoes on.\n\n```\nint x;\n```\n")
    (tmp_path / "in/bad.docx").write_bytes(b"no zip")
    (tmp_path / "in/x.djvu").write_bytes(b"?")
    documents, unsupported, _ = files.scan(spark, str(tmp_path / "in"))
    assert {r.relative_path: r.topic_area for r in documents.collect()} == {"OS/notes.md": "OS", "bad.docx": "unknown"}
    assert [r.extension for r in unsupported.collect()] == ["djvu"]
    lines = files.extract_lines(documents).cache()
    assert lines.where("error is not null").count() == 1
    blocks = clean.clean(lines)
    assert [r.type for r in blocks.orderBy("block").collect()] == ["heading", "paragraph", "code"]
    assert clean.markdown(blocks).first().markdown == "# Head\n\nSome prose here goes on.\n\n```\nint x;\n```"
    assert chunk.chunk(blocks).count() == 1
    with pytest.raises(ValueError):
        files.guard_output(str(tmp_path), str(tmp_path / "out"))


def test_manifest_and_report(spark):
    assert quality.token_stats(spark.createDataFrame([(1,), (2,), (4,)], "token_count int")).first()[:] == (1, 2.0, 2.3, 4)
    assert "a\\|b" in quality.report("T", {"n": 1}, {"X": (["c"], [("a|b",)])})


def test_queries_have_their_sql():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_analysis_of_two_objects(spark):
    assert one(spark, dialogue.analysis, '{"level":"solid"} then {"level":"partial"}').level == "unclear"


def test_ingest(spark, tmp_path):
    from corvane.plans.ingest import ingest

    folder = tmp_path / "in"
    folder.mkdir()
    words = " ".join(f"term{i}" for i in range(150))
    quiz = "\n\n".join(f"{n}. Question {n} about {words}?" for n in (1, 2, 3))
    (folder / "lab sheet.md").write_text(f"# Lab sheet\n\n{quiz}\n")
    (folder / "a.txt").write_text(words)
    (folder / "copy of a.txt").write_text(words)
    (folder / "near.txt").write_text(f"{words} and more")
    (folder / "short.txt").write_text("only this")
    (folder / "x.bin").write_bytes(b"1")
    out = ingest(spark, str(folder), str(tmp_path / "out"))
    docs = {r.filename: r for r in out["documents"].collect()}
    assert docs["copy of a.txt"].duplicate_of == docs["a.txt"].document_id and docs["a.txt"].n_near_duplicates == 3 and docs["lab sheet.md"].title == "Lab sheet"
    total = out["manifest"].first()
    assert (total.documents, total.duplicate_documents, total.near_duplicate_pairs) == (5, 1, 6)
    codes = {(r.code, r.document_id) for r in out["issues"].collect()}
    assert ("tiny_document", docs["short.txt"].document_id) in codes and ("duplicate_document", docs["copy of a.txt"].document_id) in codes
    types = {r.filename: r.chunk_type for r in out["chunks"].collect()}
    assert types["a.txt"] == "section" and types["lab sheet.md"] == ("problem" if docs["lab sheet.md"].document_type in ("lab", "practice_problems", "assignment", "tutorial", "question_paper") else "section")
    assert (tmp_path / "out" / "manifest").is_dir()


def test_chunking_starts_no_function_a_document(spark):
    """20,000 small documents are read in a few batches: with a grouped function each they took minutes (F1)."""
    import time

    n = 20_000
    rows = spark.range(n).select(F.concat(F.lit("d"), "id").alias("document_id"), F.lit(0).alias("unit"), F.lit("section").alias("unit_kind"), F.explode(F.array(F.lit(0), F.lit(1))).alias("line"))
    lines = rows.select("*", F.when(F.col("line") == 0, "a sem-").otherwise("aphore waits.").alias("text"), F.lit("text").alias("kind"), F.lit(0).alias("level"), F.lit("wrap").alias("para_break"), *[F.lit(None).cast("double").alias(c) for c in ("top", "bottom", "x0", "cw")], F.lit(None).cast("string").alias("error"))
    began = time.time()
    got = chunk.chunk(clean.clean(lines)).groupBy("text", "chunk_index").count().collect()
    assert [tuple(r) for r in got] == [("a semaphore waits.", 0, n)] and time.time() - began < 45


def test_code_indents_without_frames():
    row = lambda t, x, w: {"text": t, "x0": x, "cw": w}
    assert clean.code_block([row("  a “b” ", 10.0, 5.0), row("c", 20.0, 5.0), row("d ", 900.0, 5.0), row(" e", None, 5.0), row(" f", 30.0, 0.0)]) == '  a "b"\n  c\n' + " " * 40 + "d\n e\n f"
