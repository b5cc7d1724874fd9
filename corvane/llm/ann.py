"""Approximate nearest neighbours over balanced posting lists.

Centroids come from a bounded sample by balanced bisection (every split halves the sample, so leaves are equal), moved
by a few rounds of k-means in which a full list costs more.  A
graph over the centroids, each linked to its nearest ones, is kept in memory in every task; a batched best-first walk
over it finds the centroids near a vector.  A vector goes to the list of its nearest centroid and, near a boundary,
to further lists whose centroid is within (1 + CLOSURE) of the nearest distance, REPLICAS at most.  A query searches
the lists whose centroid is within (1 + ratio) of its nearest one (distance-ratio pruning), and more of them if these
hold too few candidates.  The ratio is measured, not set: the least at which PROBES rows of the sample find RECALL of
their nearest in the sample by brute force.  (In a sample neighbours are farther away than in the table, so it errs to
the high side.)  On clustered vectors few lists are searched; on isotropic ones no index of this kind saves much.

Lists next to each other in the tree make a cell of about CELL vectors, so a query meets each cell once and returns its k
best of it.  A replica is scored only for queries that do not search its own list.  A cell's vectors and its queries
are both cut into chunks of bounded size, and each pair of
chunks is searched by itself, so a list that is crowded or much asked is many tasks' work.

Inner products become distances by one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm (0 for a query), so
vectors need not have unit length.  Every vector is indexed; only centroids and the ratio are fitted on a sample (SAMPLE
rows, or 8 a list, chosen by a hash of id and vector).  The number of lists is the power of two nearest to 2 sqrt(rows), so
lists have some sqrt(rows) / 2 vectors; it ends at LISTS, beyond which (67 million rows) lists grow longer and nothing is dropped.

Defined cases: vectors that take no part (vectors.valid_vectors) are neither queries nor candidates; a null id takes
no part; rows that repeat an id are one candidate (its best score); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm._shared import NULL_ID, materialise
from corvane.llm.vectors import matrix, valid_vectors

SAMPLE, PROBES, RECALL = 32_768, 512, 0.94
LISTS = 16_384
DEGREE = 16
REPLICAS, CLOSURE = 2, 0.02
CELL, CHUNK, QUERY_CHUNK = 4096, 16_384, 4096
ROUNDS, FULL = 6, 0.1


def lists_for(rows: int) -> int:
    return min(LISTS, 1 << max(0, round(np.log2(max(1.0, 2 * np.sqrt(rows))))))


def bisect(x: np.ndarray, leaves: int, seed: int = 1) -> np.ndarray:
    """Centroids of a balanced tree: each split halves the points between two means."""
    rng = np.random.default_rng(seed)
    groups = [x]
    while len(groups) < leaves:
        after = []
        for g in groups:
            if len(g) < 2:
                after += [g, g]
                continue
            means = g[rng.choice(len(g), 2, replace=False)].copy()
            for _ in range(6):
                lean = g @ (means[1] - means[0])
                right = lean > np.median(lean)
                if right.all() or not right.any():
                    right = np.arange(len(g)) >= len(g) // 2
                means = np.stack([g[~right].mean(0), g[right].mean(0)])
            order = np.argsort(g @ (means[1] - means[0]), kind="stable")
            after += [g[order[: len(g) // 2]], g[order[len(g) // 2 :]]]
        groups = after
    return np.stack([g.mean(0) for g in groups])


def refined(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroids after some rounds of k-means; lists over the mean size cost up to FULL of the mean squared distance more."""
    c, held, scale = centroids, np.ones(len(centroids)), 0.0
    for _ in range(ROUNDS):
        own, near, sums = np.zeros(len(x), np.int64), np.zeros(len(x)), np.zeros_like(c)
        for at in range(0, len(x), 2048):
            cost = (c * c).sum(1)[None] - 2 * x[at : at + 2048] @ c.T + scale * (held - 1)[None]
            own[at : at + 2048] = cost.argmin(1)
        near = ((x - c[own]) ** 2).sum(1)
        counts = np.bincount(own, minlength=len(c))
        np.add.at(sums, own, x)
        c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
        held, scale = counts * len(c) / len(x), FULL * float(near.mean())
    return c


class CentroidGraph:
    """Centroids, each linked to its nearest ones both ways and to its neighbour in the order they came."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.points = c = centroids.astype(np.float32)
        k = len(c)
        near = np.zeros((k, min(DEGREE, k)), np.int64)
        for at in range(0, k, 512):
            far = self.all_far(c[at : at + 512])
            near[at : at + 512] = np.argsort(far, axis=1, kind="stable")[:, : near.shape[1]]
        links = [{(i + 1) % k, (i - 1) % k, *row} for i, row in enumerate(near.tolist())]
        for i, row in enumerate(near.tolist()):
            for j in row:
                if len(links[j]) < 2 * DEGREE:
                    links[j].add(i)
        self.links = np.array([[*sorted(x), *[i] * (2 * DEGREE + 2 - len(x))] for i, x in enumerate(links)], np.int64)
        self.entries = np.unique(np.linspace(0, k - 1, min(k, 8)).astype(np.int64))

    def all_far(self, x: np.ndarray) -> np.ndarray:
        x, c = x.astype(np.float32), self.points
        return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T))

    @staticmethod
    def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, (a * a).sum(-1) + (b * b).sum(-1) - 2 * (a * b).sum(-1)))

    def walk(self, x: np.ndarray, ratio: float, width: int) -> np.ndarray:
        """Distances (rows x centroids), infinite where the walk did not come.

        It goes on from every centroid within (1 + ratio) of the nearest one found, or among the ``width`` nearest.
        """
        x = x.astype(np.float32)
        far = np.full((len(x), len(self.points)), np.inf, np.float32)
        done = np.zeros(far.shape, bool)
        far[:, self.entries] = self._far(x[:, None], self.points[self.entries][None])
        while True:
            kth = np.partition(far, min(width, far.shape[1]) - 1, axis=1)[:, min(width, far.shape[1]) - 1]
            limit = np.maximum(kth, far.min(1) * (1 + ratio))
            q, c = np.nonzero((far <= limit[:, None]) & ~done & np.isfinite(far))
            if not len(q):
                return far
            done[q, c] = True
            new = np.unique((q[:, None] * far.shape[1] + self.links[c]).ravel())
            q, c = np.divmod(new, far.shape[1])
            fresh = ~np.isfinite(far[q, c])
            q, c = q[fresh], c[fresh]
            for at in range(0, len(q), 1 << 16):
                i, j = q[at : at + (1 << 16)], c[at : at + (1 << 16)]
                far[i, j] = self._far(x[i], self.points[j])

    def lists_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of every vector: its nearest list and those near the boundary."""
        far = self.walk(x, CLOSURE, REPLICAS)
        most = min(REPLICAS, far.shape[1])
        order = np.argsort(far, axis=1, kind="stable")[:, :most]
        near = np.take_along_axis(far, order, 1)
        row, k = np.nonzero((near <= near[:, :1] * (1 + CLOSURE)) & np.isfinite(near))
        return row, order[row, k]

    def measured_ratio(self, x: np.ndarray, k: int) -> float:
        """The least ratio at which rows of a sample find RECALL of their k best inner products in it; x has the coordinate added."""
        asked = np.unique(np.linspace(0, len(x) - 1, min(PROBES, len(x))).astype(np.int64))
        scores = x[asked, :-1] @ x[:, :-1].T
        scores[np.arange(len(asked)), asked] = -np.inf
        take = min(k, len(x) - 1)
        if not take:
            return 0.0
        top = np.argpartition(-scores, take - 1, axis=1)[:, :take]
        far = self.all_far(np.concatenate([x[asked, :-1], np.zeros((len(asked), 1))], axis=1))
        rows, at = np.unique(top.ravel(), return_inverse=True)
        row, own = self.lists_of(x[rows])
        lists = np.full((len(rows), REPLICAS), -1)
        lists[row, np.arange(len(row)) - np.searchsorted(row, row)] = own
        lists = np.where(lists < 0, lists[:, :1], lists)[at.ravel()].reshape(len(asked), take, REPLICAS)
        need = far[np.arange(len(asked))[:, None, None], lists].min(2) / np.maximum(far.min(1), 1e-9)[:, None]
        return max(0.0, float(np.quantile(need, RECALL)) - 1) + 1e-6

    def probes(self, x: np.ndarray, ratio: float, sizes: np.ndarray, least: int) -> np.ndarray:
        """Rows x lists: which to search, within the ratio, and on by distance until the lists hold ``least`` entries."""
        far = self.walk(x, ratio, 4)
        within = np.isfinite(far) & (far <= far.min(1, keepdims=True) * (1 + ratio))
        short = np.flatnonzero((within * sizes[None]).sum(1) < least)
        if len(short):
            order = np.argsort(self.all_far(x[short]), axis=1, kind="stable")
            held = np.cumsum(sizes[order], axis=1) - sizes[order]
            row, at = np.nonzero(held < least)
            within[short[row], order[row, at]] = True
        return within


def fitted(sample: np.ndarray, rows: int, k: int) -> tuple[CentroidGraph, float]:
    """The graph and the ratio, from a sample of the vectors with the coordinate added."""
    sample = sample[np.lexsort(sample.T[::-1])]  # the same in whatever order it came
    sample = sample[np.random.default_rng(0).permutation(len(sample))]
    graph = CentroidGraph(refined(sample, bisect(sample, lists_for(rows))))
    return graph, graph.measured_ratio(sample, k)


def best(scores_of: np.ndarray, qid: np.ndarray, pid: np.ndarray, q: np.ndarray, p: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of each query's k best, ties to the smaller id; scores are summed anew, pair by pair."""
    scores_of[qid[:, None] == pid[None, :]] = -np.inf
    take = min(k, scores_of.shape[1])
    kth = np.partition(scores_of, scores_of.shape[1] - take, axis=1)[:, scores_of.shape[1] - take]
    i, j = np.nonzero((scores_of >= (kth - 1e-9 * (1 + np.abs(np.where(np.isfinite(kth), kth, 0))))[:, None]) & np.isfinite(scores_of))
    exact = np.concatenate([(q[i[a : a + 65536]] * p[j[a : a + 65536]]).sum(1) for a in range(0, len(i), 65536)] or [np.zeros(0)])
    order = np.lexsort((pid[j], -exact, i))
    i, j, exact = i[order], j[order], exact[order]
    same = np.concatenate([[False], (i[1:] == i[:-1]) & (pid[j][1:] == pid[j][:-1])]) if len(i) else np.zeros(0, bool)
    i, j, exact = i[~same], j[~same], exact[~same]
    starts = np.searchsorted(i, i)
    top = np.arange(len(i)) - starts < k
    return qid[i[top]], pid[j[top]], exact[top]


def nearest(table: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries (same columns as table) its k nearest of table.

    A candidate with the query's id is the query itself and left out.
    """
    rows, dim = valid_vectors(table.where(F.col(id_col).isNotNull()), id_col, vector_col)
    asked = queries.where(F.col(id_col).isNotNull())
    kind = table.schema[vector_col].dataType.simpleString()
    spark = table.sparkSession
    result = "query_id long, vec_id long, score double"
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    count, most = rows.agg(F.count(F.lit(1)), F.max(square)).first()
    lists = lists_for(count)
    sample = rows.where(F.pmod(F.xxhash64(F.lit(17), "vec_id", "v"), F.lit(max(1, count))) < max(SAMPLE, 8 * lists)).select("v").toArrow()
    longer = lambda x: np.concatenate([x, np.sqrt(np.maximum(0, most - (x * x).sum(1, keepdims=True)))], axis=1)
    drawn = matrix(sample.column("v"), dim) if sample.num_rows else matrix(rows.limit(1).select("v").toArrow().column("v"), dim)
    graph, ratio = fitted(longer(drawn), count, k)
    span = 1 << max(0, int(np.log2(max(1.0, CELL * lists / count))))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                row, held = graph.lists_of(longer(matrix(batch.column(1), dim)))
                own = held[np.searchsorted(row, row)]  # a row's nearest list comes first
                yield pa.RecordBatch.from_pydict({"cell": pa.array(held // span), "list": pa.array(held), "own": pa.array(own), "vec_id": batch.column(0).take(pa.array(row)), "v": batch.column(1).take(pa.array(row))})

    postings = materialise(rows.mapInArrow(post, f"cell long, list long, own long, vec_id long, v {kind}"))

    def held(table: DataFrame, by: str, most: int) -> np.ndarray:
        found = np.zeros(most, np.int64)
        for own, n in table.groupBy(by).count().collect():  # a row a list, LISTS at most
            found[own] = n
        return found

    cells = -(-lists // span)
    sizes = held(postings, "list", lists)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                x = matrix(batch.column(1), dim)
                wanted = graph.probes(np.concatenate([x, np.zeros((len(x), 1))], axis=1), ratio, sizes, (k + 1) * REPLICAS)
                row, cell = np.nonzero(np.add.reduceat(wanted, np.arange(0, lists, span), axis=1))
                bits = pa.array([b.tobytes() for b in np.packbits(wanted, axis=1)], pa.binary())
                yield pa.RecordBatch.from_pydict({"cell": pa.array(cell), "query_id": batch.column(0).take(pa.array(row)), "q": batch.column(1).take(pa.array(row)), "lists": bits.take(pa.array(row))})

    wanted = valid_queries(asked, id_col, vector_col, dim)
    probed = materialise(wanted.mapInArrow(probe, f"cell long, query_id long, q {kind}, lists binary"))
    of_cell = np.add.reduceat(sizes, np.arange(0, lists, span))
    parts = {"cell": np.arange(cells), "parts": np.maximum(1, -(-of_cell // CHUNK)), "askers": np.maximum(1, -(-held(probed, "cell", cells) // QUERY_CHUNK))}
    chunks = spark.createDataFrame(pa.table({k: pa.array(v) for k, v in parts.items()}))  # one row a cell, LISTS at most
    posted = postings.join(F.broadcast(chunks), "cell")
    posted = posted.withColumn("c", F.pmod(F.xxhash64("vec_id"), "parts")).withColumn("d", F.explode(F.expr("sequence(0L, askers - 1)")))
    probing = probed.join(F.broadcast(chunks), "cell").withColumn("d", F.pmod(F.xxhash64("query_id"), "askers")).withColumn("c", F.explode(F.expr("sequence(0L, parts - 1)")))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:  # an empty side has no columns
            return pa.table({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        order = np.lexsort((left.column("own").to_numpy(), left.column("list").to_numpy()))
        left = left.take(pa.array(order))
        pid, p, home, own = left.column("vec_id").to_numpy(), matrix(left.column("v"), dim), left.column("list").to_numpy(), left.column("own").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (home[1:] != home[:-1]) | (own[1:] != own[:-1])]))
        out = []
        ids, vectors, lists_of = right.column("query_id").to_numpy(), right.column("q"), right.column("lists").combine_chunks()
        for at in range(0, right.num_rows, 256):
            q = matrix(vectors.slice(at, 256), dim)
            searched = np.unpackbits(np.array([np.frombuffer(x.as_py(), np.uint8) for x in lists_of.slice(at, 256)]), axis=1).astype(bool)
            scores = np.full((len(q), len(p)), -np.inf)
            for s, e in zip(starts, [*starts[1:], len(p)], strict=True):
                who = searched[:, home[s]] & ~searched[:, own[s]] if home[s] != own[s] else searched[:, home[s]]
                if len(who := np.flatnonzero(who)):
                    scores[who, s:e] = q[who] @ p[s:e].T
            out.append(best(scores, ids[at : at + 256], pid, q, p, k))
        a, b, s = (np.concatenate([x[n] for x in out]) for n in range(3))
        return pa.table({"query_id": a, "vec_id": b, "score": s})

    block = ["cell", "c", "d"]
    found = posted.select(*block, "list", "own", "vec_id", "v").groupBy(*block).cogroup(probing.select(*block, "query_id", "q", "lists").groupBy(*block)).applyInArrow(search, result)
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def valid_queries(queries: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """One vector (the smallest, if an id repeats) for each id; queries of another dimension find nothing."""
    rows = valid_vectors(queries, id_col, vector_col)[0].where((F.size("v") == dim) & (F.col("vec_id") != NULL_ID))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))
