"""Findings of round 3: steps that must not grow faster than their input."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corvane.functions.text import tokens
from corvane.operators import inverted, retrieval

ODD = ["A__b _c_ d_e_f", "İstanbul Kelvin 9été_x", None, "", " ... ", "x_1_", "_", "café CAFÉ naïve_id", "one two\tthree_\nfour", "lock lock Lock"]


def texts(spark, rows, key="doc_id"):
    return spark.createDataFrame(rows, f"{key} long, text string")


def test_terms_are_those_of_the_column_function(spark):
    docs = texts(spark, list(enumerate(ODD)))
    want = {r.doc_id: Counter(r.ts) if r.ts is not None else None for r in docs.select("doc_id", tokens(F.col("text")).alias("ts")).collect()}
    got = {r.doc_id: None if r.dl is None else Counter(dict(zip(r.terms, r.tfs, strict=True))) for r in retrieval.counted(docs).collect()}
    assert got == want
    some = {r.doc_id: r.terms for r in retrieval.counted(docs, frozenset([b"lock", b"d_e_f"])).collect() if r.terms}
    assert some == {0: ["d_e_f"], 9: ["lock"]}


def plain_bm25(docs, asked, k):
    """By dictionaries; rows that repeat an id and a length are one document."""
    tf, n, lengths = defaultdict(Counter), len(docs), [len(t.split()) for _, t in docs if t is not None]
    for i, t in docs:
        if t:
            tf[i, len(t.split())].update(t.split())
    df, avgdl, out = Counter(t for c in tf.values() for t in c), sum(lengths) / len(lengths), []
    for q, text in asked:
        s = Counter()
        for (i, dl), c in tf.items():
            for t, m in Counter(text.split()).items():
                if t in c:
                    s[i] += m * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * dl / avgdl))
        out += [(q, r, i, round(x, 6)) for r, (i, x) in enumerate(sorted(s.items(), key=lambda p: (-round(p[1], 6), p[0]))[:k], 1)]
    return out


@pytest.mark.parametrize("sent", [200_000, 3])
def test_bm25_shuffles_no_scored_pairs(spark, monkeypatch, sent):
    """Blocks of 16 documents and 8 queries, 4 at once; repeated ids, null texts, and more terms than are sent."""
    for name, value in (("DOCS", 16), ("BLOCK", 8), ("SLICE", 4), ("CELLS", 64), ("SENT", sent)):
        monkeypatch.setattr(retrieval, name, value)
    docs = [(i % 90, None if i % 13 == 0 else " ".join(f"w{i * j % 23}" for j in range(i % 7 + 1))) for i in range(100)]
    asked = [(q, f"w{q} w{q * 5 % 23} w{q} w1 nowhere") for q in range(20)]
    found = retrieval.bm25(texts(spark, docs), texts(spark, asked, "query_id"), 5)
    assert sorted((r.query_id, r.rank, r.doc_id, r.score) for r in found.collect()) == sorted(plain_bm25(docs, asked, 5))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and "sum(" not in plan  # the version before summed a row for each query, document and term


def test_postings_are_put_together_where_they_are_read(spark):
    """500 documents of 40 words: the version before shuffled a row for each of 20,000 postings, twice."""
    rows = retrieval.counted(texts(spark, [(i, " ".join(f"w{j}" for j in range(40))) for i in range(500)]).coalesce(1))
    found = inverted.pieces(retrieval.merged(rows), 40.0, 1.2, 0.75, 64).select("term", "n", F.size("postings").alias("held")).collect()
    assert len(found) == 40 * 8 and all(r.n == r.held <= 64 for r in found)
    docs = texts(spark, [(i % 90, " ".join(f"w{i * j % 23}" for j in range(i % 7 + 1))) for i in range(100)] + [(200, None), (201, "")])
    index = inverted.build(docs, block=8)
    held = {(r.term, r.p.doc_id, r.p.dl): r.p.tf for r in index.blocks.select("term", F.explode("postings").alias("p")).collect()}
    want = docs.select("doc_id", tokens(F.col("text")).alias("ts")).select("doc_id", F.size("ts").alias("dl"), F.explode("ts").alias("term")).groupBy("term", "doc_id", "dl").count()
    assert held == {(r.term, r.doc_id, r.dl): r["count"] for r in want.collect()}
    assert index.blocks.agg(F.max("n")).first()[0] < 16 and index.figures[0] == 102


def test_only_what_can_reach_the_best_is_looked_up(spark):
    rows = [(q, i, float(i), 10.5) for q in (1, 2) for i in range(100)] + [(3, 1, 0.5, 9.0), (None, 1, 0.5, 9.0)]
    kept = inverted.narrowed(spark.createDataFrame(rows, "query_id long, doc_id long, s double, might double"), 5).collect()
    want = {(q, i) for q in (1, 2) for i in range(100) if i + 10.5 >= 95} | {(3, 1), (None, 1)}  # fewer than k: all stay
    assert {(r.query_id, r.doc_id) for r in kept} == want and len(kept) == len(want)
