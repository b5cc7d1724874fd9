"""Nearest neighbours and embedding near-dedup against brute force."""

import numpy as np
import pytest

from corvane.llm import ann, embed_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, score double, v int"


def table(spark, vectors, ids=None):
    rows = [(i, None if x is None else [None if y is None else float(y) for y in x], 0, 0.5, 1) for i, x in zip(ids or range(len(vectors)), vectors, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(x, ids, asked, k):
    out = {}
    for i in asked:
        s = (x.astype(np.float64) * x[ids.index(i)].astype(np.float64)).sum(1)
        out[i] = sorted((-v, j) for v, j in zip(s, ids, strict=True) if j != i)[:k]
    return out


@pytest.mark.parametrize(("scale", "chunk"), [(False, 16_384), (True, 16_384), (True, 20)])
def test_recall(spark, monkeypatch, scale, chunk):
    monkeypatch.setattr(ann, "CHUNK", chunk)
    monkeypatch.setattr(ann, "QUERY_CHUNK", min(chunk, 4096))
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 16))
    x = centres[rng.integers(0, 30, 3000)] + 0.4 * rng.standard_normal((3000, 16))
    x = (x if scale else x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    vectors = table(spark, x)
    got = ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), 20).collect()
    want = brute(x, list(range(3000)), range(0, 3000, 20), 20)
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = sum(len({j for _, j, _ in found[i]} & {j for _, j in want[i]}) for i in want)
    assert hits / (20 * len(want)) >= 0.9
    for own in found.values():
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, 21)) and all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(own, own[1:], strict=False))
    for i, own in found.items():
        for _, j, s in own:
            assert s == pytest.approx(float((x[i].astype(np.float64) * x[j].astype(np.float64)).sum()), abs=1e-12)


def test_ties_copies_and_odd_vectors(spark):
    one, two = [1.0, 0, 0, 0], [0.6, 0.8, 0, 0]
    vectors = [one] * 30 + [two, None, [0.0] * 4, [1.0, None, 0, 0], [float("nan"), 1, 0, 0], [float("inf"), 0, 0, 0], []]
    t = table(spark, vectors)
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(t, t.where("vec_id in (0, 20, 31, 32)"), 5).orderBy("query_id", "rank").collect()]
    assert got == [(0, k, k) for k in range(1, 6)] + [(20, k + 1, k) for k in range(5)]
    few = table(spark, [one, two, one])
    assert [(r.query_id, r.vec_id) for r in ann.nearest(few, few, 20).orderBy("query_id", "rank").collect()] == [(0, 2), (0, 1), (1, 0), (1, 2), (2, 0), (2, 1)]
    assert ann.nearest(table(spark, [None]), few, 3).count() == 0 and ann.nearest(t.limit(0), t, 3).count() == 0


def slow_links(vectors, ids, cosine):
    ok = [i for i, x in enumerate(vectors) if x is not None and len(x) and all(y is not None and np.isfinite(y) for y in x) and any(x)]
    x = np.array([vectors[i] for i in ok], np.float32).astype(np.float64)
    norm = np.sqrt((x * x).sum(1))
    near = (x[:, None] * x[None]).sum(-1) / (norm[:, None] * norm[None]) >= cosine
    count, root = {i: 0 for i in ids}, {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(ok)):
        for b in range(a):
            if near[a, b]:
                p, q = ids[ok[a]], ids[ok[b]]
                count[p] += 1
                count[q] += 1
                p, q = find(p), find(q)
                root[max(p, q)] = min(p, q)
    return {i: (count[i], find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize(("chunk", "grid"), [(8192, None), (8192, 0), (8192, 1), (8192, 5), (40, 2), (40, 8)])
def test_links(spark, monkeypatch, chunk, grid):
    monkeypatch.setattr(embed_dedup, "CHUNK", chunk)
    if grid is not None:  # over as many coordinates as tables of other sizes and shapes would have
        monkeypatch.setattr(embed_dedup.Subspaces, "fit", lambda self, drawn, rows: self.grid.__setitem__(slice(None), [grid] * len(self.grid)))
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 24))
    near = [base[i % 20] + 0.05 * (1 + i % 5) * rng.standard_normal(24) for i in range(150)]
    copies = [base[3]] * 12 + [2.5 * base[3]]
    vectors = [*base, *near, *copies, None, [0.0] * 24, [*base[0][:23], None], [*base[0][:23], float("nan")], []]
    ids = rng.permutation(1000)[: len(vectors)].tolist()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicate_vectors(table(spark, vectors, ids)).collect()}
    assert got == slow_links(vectors, ids, 0.95)
    assert sum(n for n, _, _ in got.values()) > 300


@pytest.mark.parametrize(("rows", "most"), [(5 * 10**4, 24), (10**6, 600), (10**8, 60_000)])
def test_grid_costs_least(rows, most):
    """Copies of a near isotropic vector over all blocks, chunk pairs counted in, and no cheaper grid in any block."""
    spaces = embed_dedup.Subspaces(64, 0.95)
    x = np.random.default_rng(7).standard_normal((4000, 64))
    spaces.fit(x, rows)
    y, chosen, copies = spaces.rotated(x), list(spaces.grid), 0

    def cost(b, grid):
        spaces.grid[b] = grid
        found = spaces.dealt(y, b, rows)
        return found[0] * rows + found[1] / embed_dedup.PAIRS, found[0]

    for b in range(8):
        every = [cost(b, g) for g in range(9)]
        assert every[chosen[b]][0] == min(every)[0]
        copies += every[chosen[b]][1]
    assert copies <= most


def test_no_vectors(spark):
    assert embed_dedup.near_duplicate_vectors(table(spark, [None, []])).count() == 2
    assert embed_dedup.near_duplicate_vectors(table(spark, [None]).limit(0)).count() == 0


def scanned(x, k, step):
    """(recall, share of all rows scored a query) of the index over unit vectors, each row scored once a query."""
    longer = np.concatenate([x, np.sqrt(np.maximum(0, (x * x).sum(1).max() - (x * x).sum(1, keepdims=True)))], axis=1)
    graph, ratio = ann.fitted(longer, len(x), k)
    row, own = graph.lists_of(longer)
    member = np.zeros((len(x), len(graph.points)), np.float32)
    member[row, own] = 1
    asked = np.arange(0, len(x), step)
    zero = np.concatenate([x[asked], np.zeros((len(asked), 1))], axis=1)
    met = graph.probes(zero, ratio, member.sum(0), (k + 1) * ann.REPLICAS).astype(np.float32) @ member.T > 0
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(met, top, 1).mean(), met.mean()


def test_saves_work(spark):
    """The given vectors are near isotropic, so 0.9 of the nearest lie in over half of the rows; clusters need few lists."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("embedding").collect()
    given = np.array([r[0] for r in rows if r[0] is not None and all(y is not None and np.isfinite(y) for y in r[0]) and any(r[0])])
    recall, share = scanned(given, 20, 20)
    assert recall >= 0.9 and share <= 0.75
    rng = np.random.default_rng(5)
    x = rng.standard_normal((200, 32))[rng.integers(0, 200, 20_000)] + 0.3 * rng.standard_normal((20_000, 32))
    recall, share = scanned(x / np.linalg.norm(x, axis=1, keepdims=True), 20, 100)
    assert recall >= 0.9 and share <= 0.2


def test_query_recall(spark):
    """op1 itself on sf0.1 against brute force."""
    from corvane.llm.queries import op1_ann_posting_lists

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    rows = [(i, v) for i, v in rows if v is not None and all(y is not None and np.isfinite(y) for y in v) and any(v)]
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows])
    want = brute(x, ids, [i for i in ids if i % 20 == 0], 20)
    got = {}
    for r in op1_ann_posting_lists(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    assert np.mean([len(got[i] & {j for _, j in want[i]}) / 20 for i in want]) >= 0.9


def test_lists_grow_with_the_table():
    assert [ann.lists_for(n) for n in (0, 1, 2000, 51_282, 10**6, 6 * 10**7)] == [1, 2, 64, 512, 2048, 16_384]
