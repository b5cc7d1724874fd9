"""Greedy packing by pointer doubling against the fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import chunk, cuts

SCHEMA = "doc string, i int, size long, most long, sticky boolean"


def fold(items):
    """Parts of one sequence, item after item."""
    starts = [0]
    for i in range(1, len(items)):
        if sum(size for size, _, _ in items[starts[-1] : i + 1]) > items[i][1]:
            cut = i
            while cut > starts[-1] and items[cut - 1][2]:
                cut -= 1
            if cut > starts[-1]:
                starts.append(cut)
    return [sum(s <= i for s in starts) - 1 for i in range(len(items))]


def parts(spark, docs):
    rows = [(d, i, *map(int, x[:2]), bool(x[2])) for d, items in docs.items() for i, x in enumerate(items)]
    found = {}
    for r in cuts.greedy_parts(spark.createDataFrame(rows, SCHEMA).repartition(4), ["doc"]).collect():
        found.setdefault(r.doc, {})[r.i] = r.part
    return {d: [own[i] for i in range(len(own))] for d, own in found.items()}


@pytest.mark.parametrize(("stretch", "spread", "seed"), [(8192, 1 << 16, 0), (3, 7, 1), (1, 1, 2)])
def test_parts_equal_the_fold(spark, monkeypatch, stretch, spread, seed):
    monkeypatch.setattr(cuts, "STRETCH", stretch)
    monkeypatch.setattr(cuts, "SPREAD", spread)
    rng = np.random.default_rng(seed)
    docs = {f"d{k}": [(rng.integers(0, 12), rng.choice([10, 16]), rng.random() < 0.25) for _ in range(rng.integers(1, 40))] for k in range(40)}
    docs |= {"one": [(99, 10, False)], "heads": [(6, 10, True)] * 9, "last": [(6, 10, True)] * 9 + [(1, 10, False)] * 30, "zero": [(0, 10, False)] * 9, "large": [(50, 10, False)] * 7, "mixed": [(50, 10, True), (50, 10, False)] * 5}
    assert parts(spark, docs) == {d: fold(items) for d, items in docs.items()}


def test_no_items(spark):
    assert cuts.greedy_parts(spark.createDataFrame([], SCHEMA), ["doc"]).collect() == []


def test_a_long_sequence_is_spread(spark):
    rows = spark.range(60_000).select(F.lit("d").alias("doc"), F.col("id").cast("int").alias("i"), (F.col("id") % 7 + 1).alias("size"), F.lit(50).cast("long").alias("most"), (F.col("id") % 5 == 0).alias("sticky"))
    got = [r.part for r in cuts.greedy_parts(rows, ["doc"]).orderBy("i").select("part").collect()]
    assert got == fold([(i % 7 + 1, 50, i % 5 == 0) for i in range(60_000)])


def test_blocks_of_a_section(spark):
    """The parts that the chunker's fold makes of blocks, tail and lead-ins included."""
    rng = np.random.default_rng(4)
    docs, rows = {}, []
    for k in range(25):
        own = [{"type": str(rng.choice(["paragraph", "heading"], p=[0.8, 0.2])), "text": " ".join(["word"] * int(rng.integers(1, 120))) + str(rng.choice(["", ":"])), "level": 1, "unit": 1, "unit_kind": "page"} for _ in range(rng.integers(1, 30))]
        blocks = chunk.Blocks(own, chunk.count_words_and_marks)
        docs[f"d{k}"] = [len(p) for p in chunk.packed(blocks, 0, len(blocks), chunk.TARGET, chunk.SECTION, chunk.count_words_and_marks)]
        rows += [(f"d{k}", i, b["type"], b["text"], blocks.tokens[i]) for i, b in enumerate(own)]
    table = spark.createDataFrame(rows, "doc string, i int, type string, text string, size long")
    found = {}
    for r in chunk.packed_blocks(table, ["doc"]).groupBy("doc", "part").count().orderBy("doc", "part").collect():
        found.setdefault(r.doc, []).append(r["count"])
    assert found == docs
