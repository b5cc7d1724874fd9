"""Findings of round 4: pairs of large tables, compared where they are read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import embed_dedup


def some_vectors():
    rng = np.random.default_rng(8)
    base = rng.standard_normal((90, 24))
    near = [base[i % 9] + 0.05 * (1 + i % 5) * rng.standard_normal(24) for i in range(120)]
    return [x.tolist() for x in [*base, *near, *[base[3]] * 7, 2.5 * base[3], -base[4]]]


@pytest.mark.parametrize("grid", [False, True])
def test_vectors_meet_in_blocks(spark, monkeypatch, grid):
    """each vector was sent to 8 cells and more (20 at 50,000 rows, some 300 at 600,000)."""
    monkeypatch.setattr(embed_dedup, "ROWS", 16)
    if grid:
        monkeypatch.setattr(embed_dedup, "ALWAYS", -1)
        monkeypatch.setattr(embed_dedup.Subspaces, "cheaper", lambda self, drawn, rows: True)
    plans, links = [], embed_dedup.all_links
    monkeypatch.setattr(embed_dedup, "all_links", lambda *a: plans.append(links(*a)) or plans[-1])
    vectors = [*some_vectors(), [0.0] * 24, [-0.0] * 23 + [1.0], [0.0] * 23 + [1.0], [float("nan")] * 24, None]
    table = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicate_vectors(table).collect()}
    x = np.array([v if v is not None and not np.isnan(v).any() else [0.0] * 24 for v in vectors], np.float32).astype(np.float64)
    norm = np.sqrt((x * x).sum(1))
    near = np.divide(x @ x.T, norm[:, None] * norm, out=np.zeros((len(x), len(x))), where=norm[:, None] * norm > 0) >= 0.95
    assert got == {i: int(near[i].sum() - near[i, i]) for i in range(len(x))} and sum(got.values()) > 300
    if grid:
        assert not plans
    else:
        plan = plans[0]._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Exchange" not in plan


def test_blocks_are_full(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "ROWS", 16)
    rows = spark.range(100).coalesce(1).select(F.col("id").alias("node"), *[F.lit(1).cast("long").alias(c) for c in ("copies", "k", "l")], F.array(F.col("id").cast("float")).alias("v"))
    blocks = embed_dedup.blocks_of(rows, 1, "array<float>")
    assert sorted(len(r.node) // 8 for r in blocks.collect()) == [4] + [16] * 6 and blocks.select("block").distinct().count() == 7
    assert sorted((r.node, r.v) for r in embed_dedup.members_of(blocks, "array<float>", 1).collect()) == [(i, [float(i)]) for i in range(100)]


def test_leading_coordinates():
    """Few for vectors far apart, all where a part of the distance tells nothing."""
    x = np.random.default_rng(3).standard_normal((500, 64))
    assert embed_dedup.Subspaces(64, 0.95).lead(x) <= 24 and embed_dedup.Subspaces(64, 0.1).lead(x) >= 48
