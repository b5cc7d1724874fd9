"""Medians by rank selection, the run registry, sections and code runs by windows, sessions that expire."""

import datetime
import json
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import chunk, clean, dialogue, medians, runs
from corvane.streaming import sessions

VALUES = {
    "one": [4.0], "two": [1.0, 2.0], "same": [7.0] * 400, "hot": [3.0] * 300 + [float(x) for x in range(500)], "ends": [0.0] * 200 + [1.0] * 200,
    "wide": [10.0**k for k in range(-300, 300)], "signs": [-1e308, 1e308, 0.0, 5.0] * 60, "random": np.random.default_rng(0).normal(size=777).tolist(), "inf": [float("inf"), float("-inf"), 1.0, 2.0] * 80,
}


@pytest.mark.parametrize("rows", [100_000, 20])
def test_medians(spark, rows):
    table = spark.createDataFrame([(k, v) for k, own in VALUES.items() for v in [*own, None]] + [("none", None), (None, 2.5)], "k string, v double").repartition(4)
    got = {r.k: (r.median, r["values"]) for r in medians.medians(table, "v", ["k"], rows).collect()}
    assert got == {k: (statistics.median(own), len(own)) for k, own in VALUES.items()} | {None: (2.5, 1)}
    assert medians.medians(table.where("k = 'hot'"), "v", rows=rows).first().median == statistics.median(VALUES["hot"])
    assert medians.medians(table.limit(0), "v").collect() == []


def test_median_tasks_are_bounded(spark, monkeypatch):
    """What is sorted in the end is the rows between the bounds, not a group."""
    written, whole = [], medians.stored

    def keep(table):
        out = whole(table)
        written.append(out)
        return out

    monkeypatch.setattr(medians, "stored", keep)
    table = spark.range(200_000).select(F.lit("a").alias("k"), F.hash("id").cast("double").alias("v"))
    assert medians.medians(table, "v", ["k"], 500).first().median == statistics.median(r.v for r in table.collect())
    assert written[-1].agg(F.max("within")).first()[0] <= 500 and len(written) < 8


def registered(spark, tmp_path):
    corpus = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    bench = spark.createDataFrame([(0, "q"), (1, "r")], "query_id long, text string")
    values = lambda x: spark.createDataFrame([(0, x), (1, x / 2)], "query_id long, ndcg double")
    return str(tmp_path), corpus, bench, values


def test_run_registry(spark, tmp_path):
    path, corpus, bench, values = registered(spark, tmp_path)
    assert runs.runs(spark, path).count() == 0
    first = runs.record(path, "dense", {"k": 10, "b": [1]}, corpus, bench, values(0.8))
    assert (first.queries, first.means, json.loads(first.config)) == (2, {"ndcg": 0.6}, {"k": 10, "b": [1]})
    second = runs.record(path, "bm25", {"b": [1], "k": 10}, corpus.repartition(3), bench.select("text", "query_id"), values(0.4))
    assert (second.config_digest, second.corpus_digest, second.benchmark_digest) == (first.config_digest, first.corpus_digest, first.benchmark_digest)
    assert [tuple(r) for r in runs.beside(spark, path, ["dense", "bm25"], ["ndcg"]).orderBy("query_id").collect()] == [(0, 0.8, 0.4), (1, 0.4, 0.2)]
    other = corpus.withColumn("text", F.upper("text"))
    for bad, why in (({"corpus": other}, "another corpus"), ({"name": "dense"}, "there is a run"), ({"values": values(1.0).limit(1)}, "alone"), ({"problems": bench}, "invalid benchmark"), ({"name": "a/b"}, "name")):
        given = {"name": "new", "config": {}, "corpus": corpus, "benchmark": bench, "values": values(0.1)} | bad
        with pytest.raises(ValueError, match=why):
            runs.record(path, **given)
    changed = bench.withColumn("text", F.lit("x"))
    assert runs.record(path, "new", {}, other, changed, values(0.1)).queries == 2  # another benchmark may have another corpus
    for names, why in ((["dense", "new"], "different"), (["dense", "gone"], "no run")):
        with pytest.raises(ValueError, match=why):
            runs.beside(spark, path, names, ["ndcg"])


def test_a_killed_run_is_not_seen(spark, tmp_path):
    path, corpus, bench, values = registered(spark, tmp_path)
    values(0.3).write.parquet(f"{path}/runs/half/values")
    assert runs.runs(spark, path).count() == 0
    assert runs.record(path, "half", {}, corpus, bench, values(0.5)).means == {"ndcg": 0.375}


def test_sections_equal_the_stack(spark):
    rng, rows = np.random.default_rng(1), []
    for d in range(30):
        for i in range(rng.integers(1, 40)):
            heading = rng.random() < 0.4
            rows.append((f"d{d}", int(i // 7), "page", int(i), "heading" if heading else "paragraph", f"t{d}.{i}", int(rng.integers(0, 7)) if heading else 0))
    found = {}
    for r in chunk.sections(spark.createDataFrame(rows, clean.BLOCKS)).orderBy("document_id", "unit", "block").collect():
        found.setdefault(r.document_id, []).append((r.section, tuple(r.path)))
    for d in found:
        own = chunk.Blocks([{"type": t, "text": x, "level": n, "unit": u, "unit_kind": k} for doc, u, k, _, t, x, n in rows if doc == d], len)
        assert found[d] == [(n, s.path) for n, s in enumerate(chunk.spans(own, {})) for _ in range(s.start, s.end)]


def test_code_runs_equal_the_fold(spark):
    rng, rows = np.random.default_rng(2), []
    texts = ["short", "ends here.", "• bullet", "x" * 70, "a:", "fine"]
    for d in range(25):
        rows += [(f"d{d}", i % 2, "page", i // 2, str(rng.choice(texts, p=[0.3, 0.1, 0.1, 0.1, 0.1, 0.3])), str(rng.choice(["code", "text", "heading"], p=[0.35, 0.6, 0.05]))) for i in range(rng.integers(1, 60))]
    table = spark.createDataFrame(rows, "document_id string, unit int, unit_kind string, line int, text string, kind string")
    got = {(r.document_id, r.unit, r.line): r.kind for r in clean.smoothed(table).collect()}
    groups = {}
    for doc, unit, _, no, text, kind in rows:
        groups.setdefault((doc, unit), []).append((no, {"text": text, "kind": kind}))
    want = {(*k, no): r["kind"] for k, own in groups.items() for (no, _), r in zip(sorted(own, key=lambda x: x[0]), clean.smooth([dict(r) for _, r in sorted(own, key=lambda x: x[0])]), strict=True)}
    assert got == want


def test_sessions_expire(spark, tmp_path):
    """Turn by turn the stream gives what the batch gives; a session that is idle ends with a row, and a late reply errs."""
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    schema = "session_id long, turn long, aside boolean, level string, at timestamp"
    batches = [
        [(1, 1, False, "partial", at(0)), (1, 2, True, None, at(1)), (2, 1, False, "solid", at(2))],
        [(1, 3, False, "solid", at(8)), (3, 1, False, "solid", at(30))],  # the watermark moves on
        [(3, 2, False, "solid", at(31))],  # 1 and 2 have expired
        [(2, 2, False, "solid", at(32)), (3, 3, False, "solid", at(33))],  # a reply after that
        [(3, 4, False, "solid", at(60))], [(3, 5, False, "solid", at(61)), (3, 6, False, "solid", at(500))],
    ]
    folder, out = tmp_path / "in", []
    before = spark.conf.get(sessions.ROCKSDB[0], None)
    spark.conf.set(*sessions.ROCKSDB)
    try:
        for i, batch in enumerate(batches):
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(folder / f"b{i}"))
            stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(folder))
            query = sessions.session_events(stream, 10_000, 100_000).writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            assert query.awaitTermination(120)
    finally:
        spark.conf.unset(sessions.ROCKSDB[0]) if before is None else spark.conf.set(sessions.ROCKSDB[0], before)
    rows = [(r.session_id, r.turn, r.stage, r.rounds, r.kind) for r in out]
    replies = spark.createDataFrame([r for b in batches[:2] for r in b if r[0] != 3], schema)
    batch = {tuple(r) for r in dialogue.dialogue_states(replies).select("session_id", "turn", "stage", "rounds", "kind").collect()}
    assert batch <= set(rows)
    assert [r[4] for r in rows if r[0] == 1][-1] == "EXPIRED" and (2, 2, "EXPIRED", 0, "EXPIRED_ERROR") in rows
    assert [r[4] for r in rows if r[0] == 2] == ["CHECK", "EXPIRED", "EXPIRED_ERROR"]
    assert [r[1:] for r in rows if r[0] == 3][3:] == [(3, "DONE", 0, "EXPIRED"), (4, "EXPIRED", 0, "EXPIRED_ERROR"), (5, "EXPIRED", 0, "EXPIRED_ERROR"), (6, "CHECK", 0, "CHECK")]  # and in the end the id is free


def test_judgments_and_scores_are_bounded_in_a_task(spark, monkeypatch):
    """Judgments grow with the square of the vectors: one task held all of a file's (F3), and they were all moved (F7)."""
    from corvane.operators import metrics, retrieval
    from corvane.plans import queries as plans

    monkeypatch.setattr(plans, "JUDGMENTS", 50, raising=False)
    made = plans.qrels(spark, "/root/testdata/sf0.001")
    counts = [r["count"] for r in made.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(counts) == made.count() and max(counts) < 200
    plan = lambda rows: rows._jdf.queryExecution().executedPlan().toString()
    assert plan(made.groupBy("query_id", "doc_id").count()).count("Exchange hashpartitioning") == 1  # the vectors
    asked = plans.dense_queries(spark, "/root/testdata/sf0.001")
    run = made.where("doc_id < 20").select("query_id", "doc_id", F.lit(1).alias("rank"))
    assert "LeftSemi" in plan(metrics.labelled(run, made)) and metrics.labelled(run, made).where("grade is null").isEmpty()
    bad = made.unionByName(made.where("doc_id = 7")).unionByName(spark.createDataFrame([(0, 10**9, 1), (77, 1, 3)], "query_id long, doc_id long, grade int"))
    got = {r.problem for r in metrics.validate_benchmark(asked.withColumn("query", F.lit("q")), bad, plans.vectors(spark, "/root/testdata/sf0.001"), {}).collect()}
    assert got >= {"unknown chunk", "chunk judged twice", "bad relevance grade", "judgment of an unknown query"}

    vectors = plans.vectors(spark, "/root/testdata/sf0.001").select("doc_id", "v")
    wanted = retrieval.cosine(vectors, asked.select("query_id", "v"), 5).collect()
    monkeypatch.setattr(retrieval, "SLICE", 2)  # before, a block's scores were one matrix of 4,096 by 4,096 (F15)
    assert sorted(retrieval.cosine(vectors, asked.select("query_id", "v"), 5).collect()) == sorted(wanted)


def test_shingles_are_made_once(spark):
    """The plain form was worked out a dozen times a text (F12, F14), and all shingles were shuffled twice (F6)."""
    from corvane.functions import text as T
    from corvane.operators import dedup

    rows = spark.createDataFrame([(1, "A b, c d e f"), (2, "a b c d e f!"), (3, "?!"), (4, "x"), (5, None), (6, "a b c d e f g")], "doc_id long, text string")
    made = rows.select("doc_id", T.shingles(F.col("text")).alias("s"))
    assert {r.doc_id: r.s for r in made.collect()} == {1: ["a b c d e", "b c d e f"], 2: ["a b c d e", "b c d e f"], 3: [], 4: ["x"], 5: None, 6: ["a b c d e", "b c d e f", "c d e f g"]}
    plan = lambda t: t._jdf.queryExecution().optimizedPlan().toString()
    assert plan(made).count("regexp_replace") == 1 and plan(rows.select(T.shingle_hashes(F.col("text")).alias("s"))).count("regexp_replace") == 1
    assert [tuple(r) for r in dedup.near_duplicate_pairs(rows).collect()] == [(1, 6, "overlap", 0.667, 1.0)]
