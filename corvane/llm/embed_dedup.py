"""Embedding near-dedup: all pairs in blocks, or a subspace pigeonhole join of very many vectors.

Up to ALWAYS pairs, and beyond where the join would cost more, vectors are written once in blocks, and every pair of blocks
is compared where it is read: a Cartesian product of files, so no vector is shuffled to meet another.  A product over the
leading coordinates of the turned vectors gives a part of the squared distance, which is no more than the whole; the few
pairs within the limit there are checked exactly.  How many coordinates is laid by a sample, and links don't depend on it.

The join: for unit vectors, cosine >= c means a squared distance of 2 (1 - c) at most.  All vectors are turned by one seeded
rotation and split into blocks of 8 dimensions; a linked pair keeps to its proportional share of the squared distance
in one block at least.  So in each block vectors are joined within that share: a grid over the block's leading
coordinates brings a vector to its own cell and to the neighbour cells its range touches, and in a cell block distances
select candidates, which are checked exactly on the original vectors.  Over how many coordinates a block's grid lies is
laid by the cells found on about SAMPLE vectors: what a finer grid saves in crowded cells against what it adds in
neighbours.  Links do not depend on it.
A pair counts in the first block in which it keeps to the share, and in one cell, so unions need no pair list: cells
return link counts and a spanning forest of their links.  Its vectors go to a cell and its neighbours in each block.

Equal vectors are one class with a number of copies.  A cell over CHUNK rows is dealt out as pairs of chunks, each a
task's work of bounded memory, so a crowded cell is spread and nothing is dropped.

Defined cases: vectors that take no part (see vectors.valid_vectors) have 0 links and are their own component; rows
that repeat an id and vector link with each other like any copies; rows that repeat an id with other vectors are one
node of the graph with the sum of their links; a null id ranks last; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._shared import id_column, materialise, small_arrow
from corvane.llm.components import connected_components
from corvane.llm.vectors import lists, matrix, takes_part, valid_vectors
from corvane.sources.shared import fresh_path

BLOCK = 8
#: Rows of a chunk (two of them in a task), vectors that the grid is fitted on, and pairs compared in a dealt row's time.
CHUNK, SAMPLE, PAIRS = 32_768, 8192, 2000
SLACK = 1e-6
#: Rows of a block of the all-pairs comparison and of a tile of it, blocks of a file, pairs that are always compared that way,
#: coordinates that may be compared first, and products of a coordinate in the time of one exact check.
ROWS, TILE, FILE_BLOCKS, ALWAYS, LEADS, CHECK = 8192, 512, 8, 1 << 40, (8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256), 2000


class Subspaces:
    """The rotation, its blocks and each block's share of the squared distance."""

    def __init__(self, dim: int, cosine: float, seed: int = 3) -> None:
        q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
        self.turn, self.cosine = q * np.sign(np.diag(r)), cosine
        self.edges = list(range(0, dim, BLOCK))
        width = np.diff([*self.edges, dim])
        self.share = (2 * (1 - cosine) + SLACK) * width / dim
        self.grid = [0] * len(width)
        self.step = 2 * np.sqrt(self.share) + 1e-9
        #: of a squared distance that single precision gives
        self.limit = np.float32(2 * (1 - cosine) + SLACK + 1e-5)

    def dealt(self, y: np.ndarray, b: int, rows: int) -> tuple[float, float]:
        """(copies of a vector, pairs compared) in block b of a table of ``rows`` vectors that ``y`` are drawn from."""
        found = [(key, np.full(len(at), home)) for at, key, home in self.cells(y, b)]
        _, cell = np.unique(np.concatenate([key for key, _ in found]), return_inverse=True)
        every, own = (np.bincount(cell, w) * rows / len(y) for w in (None, np.concatenate([home for _, home in found])))
        return float((every * np.ceil(every / CHUNK)).sum() / rows), float((own * (every - own / 2)).sum())

    def fit(self, drawn: np.ndarray, rows: int) -> None:
        """Lay each block's grid over the number of coordinates that costs least for ``rows`` vectors like ``drawn``."""
        y = self.rotated(drawn)
        for b, low in enumerate(self.edges):
            costs = []
            for self.grid[b] in range(min(BLOCK, y.shape[1] - low) + 1):
                copies, pairs = self.dealt(y, b, rows)
                costs.append(copies * rows + pairs / PAIRS)
            self.grid[b] = int(np.argmin(costs))

    def cheaper(self, drawn: np.ndarray, rows: int) -> bool:
        """Whether the join, as fitted, costs less than all pairs of ``rows`` vectors like ``drawn``."""
        y, half = self.rotated(drawn), rows * (rows - 1) / 2
        return half > ALWAYS and sum(copies * rows * PAIRS + pairs for copies, pairs in (self.dealt(y, b, rows) for b in range(len(self.edges)))) < half

    def lead(self, drawn: np.ndarray) -> int:
        """How many leading coordinates to compare first: their products and the exact checks that they leave cost least."""
        y, dim = self.rotated(drawn), len(self.turn)
        choices = [k for k in LEADS if k < dim] + [dim]
        passed = [float((_apart(y[:, :k], y[:, :k]) <= self.limit).mean()) for k in choices]
        return choices[int(np.argmin([k + CHECK * p for k, p in zip(choices, passed, strict=True)]))]

    def rotated(self, x: np.ndarray, b: int | None = None) -> np.ndarray:
        """Unit vectors turned (block b of them); summed one coordinate after another, so a vector's result depends on
        it alone."""
        turn = self.turn if b is None else self.turn[:, self.edges[b] : self.edges[b] + BLOCK]
        unit = x / np.sqrt(np.cumsum(x * x, axis=1)[:, -1:])
        out = np.zeros((len(x), turn.shape[1]))
        for k in range(unit.shape[1]):
            out += unit[:, k : k + 1] * turn[k]
        return out

    def cells(self, y: np.ndarray, b: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(row positions, cell keys, whether it is their own cell): neighbours with a smaller key alone."""
        lead = y[:, self.edges[b] : self.edges[b] + self.grid[b]]
        own = np.floor(lead / self.step[b]).astype(np.int64)
        reach = np.sqrt(self.share[b]) + 1e-9
        below, above = lead - own * self.step[b] <= reach, (own + 1) * self.step[b] - lead <= reach
        scale = 256 ** np.arange(self.grid[b], dtype=np.int64)
        key = (own + 128) @ scale
        yield np.arange(len(y)), key, True
        for move in product((-1, 0, 1), repeat=self.grid[b]):
            by = int(np.array(move, np.int64) @ scale)
            if by < 0:
                fits = np.all([np.ones(len(y), bool) if m == 0 else below[:, j] if m < 0 else above[:, j] for j, m in enumerate(move)], axis=0)
                yield np.flatnonzero(fits), key[fits] + by, False

    def links(self, b: int, x: np.ndarray, block: np.ndarray, left: np.ndarray, right: np.ndarray, upper: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Linked pairs of left x right whose first block within its share is b; upper: left is right, count once."""
        norm = np.sqrt(np.cumsum(x * x, axis=1)[:, -1])
        part = block.astype(np.float32)
        square = (part * part).sum(1, keepdims=True)
        one = np.ones_like(square)
        # a row of `from_` times one of `to` is the squared distance of the two, in one product
        # in the order of the next coordinate, a tile meets only the stretch within reach of it
        along = block[:, min(self.grid[b], block.shape[1] - 1)]
        left, right = left[np.argsort(along[left], kind="stable")], right[np.argsort(along[right], kind="stable")]
        reach = np.sqrt(self.share[b]) + 1e-9
        from_, to = np.concatenate([-2 * part, square, one], axis=1)[left], np.concatenate([part, one, square], axis=1)[right]
        tiles = []
        for m in range(0, len(left), 256):
            begin = np.searchsorted(along[right], along[left[m]] - reach)
            end = np.searchsorted(along[right], along[left[min(m + 255, len(left) - 1)]] + reach, side="right")
            tiles += [(m, n, min(n + 4096, int(end))) for n in range(max(int(begin), m if upper else 0), int(end), 4096)]
        for m, n, end in tiles:
            near = from_[m : m + 256] @ to[n:end].T <= np.float32(self.share[b] + 1e-5)
            i, j = np.divmod(np.flatnonzero(near), near.shape[1])
            if upper:
                later = j + n > i + m
                i, j = i[later], j[later]
            for s in range(0, len(i), 1 << 15):
                p, q = left[m + i[s : s + (1 << 15)]], right[n + j[s : s + (1 << 15)]]
                near = (x[p] * x[q]).sum(1) / (norm[p] * norm[q]) >= self.cosine
                p, q = p[near], q[near]
                rows, at = np.unique(np.concatenate([p, q]), return_inverse=True)
                y = self.rotated(x[rows])
                apart = y[at[: len(p)]] - y[at[len(p) :]]
                within = np.add.reduceat(apart * apart, self.edges, axis=1) <= self.share if len(p) else np.zeros((0, len(self.edges)), bool)
                first = np.argmax(within, axis=1) == b
                yield p[first & within[:, b]], q[first & within[:, b]]


def _sides(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two arrays: a row of the first times one of the second is the squared distance of the two, in one product."""
    part = part.astype(np.float32)
    square = (part * part).sum(1, keepdims=True)
    one = np.ones_like(square)
    return np.concatenate([-2 * part, square, one], axis=1), np.concatenate([part, one, square], axis=1)


def _apart(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _sides(left)[0] @ _sides(right)[1].T


def _joined(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """root, a forest of stars, with the links p, q in it."""
    while np.any(root[p] != root[q]):
        low = np.minimum(root[p], root[q])
        np.minimum.at(root, root[p], low)
        np.minimum.at(root, root[q], low)
        while np.any(root != root[root]):
            root = root[root]
    return root


def _said(node: np.ndarray, count: np.ndarray, root: np.ndarray) -> dict:
    """Link counts and a spanning forest as columns a, b, n."""
    linked, child = np.flatnonzero(count), np.flatnonzero(root != np.arange(len(root)))
    return {"a": np.concatenate([node[linked], node[child]]), "b": pa.array(np.concatenate([np.zeros(len(linked), np.int64), node[root[child]]]), mask=np.arange(len(linked) + len(child)) < len(linked)), "n": np.concatenate([count[linked], np.zeros(len(child), np.int64)])}


def blocks_of(classes: DataFrame, dim: int, kind: str) -> DataFrame:
    """classes(node, copies, k, l, v) written in blocks of ROWS at most: (block, node, copies, k, l, v), arrays as bytes."""
    held, most = np.float32 if "float" in kind else np.float64, ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        block = TaskContext.get().partitionId() << 32

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal kept, block
            table = pa.Table.from_batches(kept)
            row = {c: [table.column(c).to_numpy().tobytes()] for c in ("node", "copies", "k", "l")}
            yield pa.RecordBatch.from_pydict({"block": [block], **row, "v": [matrix(table.column("v"), dim).astype(held).tobytes()]})
            kept, block = [], block + 1

        for batch in batches:
            while batch.num_rows:  # full blocks, whatever the batches
                room = most - sum(b.num_rows for b in kept)
                kept.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in kept) == most:
                    yield from packed()
        if kept:
            yield from packed()

    spark, path = classes.sparkSession, fresh_path(classes.sparkSession)
    made = classes.select("node", "copies", "k", "l", "v").mapInArrow(run, "block long, node binary, copies binary, k binary, l binary, v binary")
    with small_arrow(spark):
        made.write.option("maxRecordsPerFile", FILE_BLOCKS).parquet(path)  # a reader holds the blocks of a file at once
    return spark.read.schema(made.schema).parquet(path)


def members_of(blocks: DataFrame, kind: str | None = None, dim: int = 0) -> DataFrame:
    """The rows of blocks again: (node, copies, k, l), with a kind (node, copies, v)."""
    names = ["node", "copies", *(["v"] if kind else ["k", "l"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(c) for c in names), strict=True):
                found = [np.frombuffer(x.as_py(), np.int64) for x in row[: 2 if kind else 4]]
                if kind:
                    held, made = (np.float32, pa.float32()) if "float" in kind else (np.float64, pa.float64())
                    found.append(lists(np.frombuffer(row[2].as_py(), held).reshape(-1, dim), made))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names)

    return blocks.select(*names).mapInArrow(run, "node long, copies long, " + (f"v {kind}" if kind else "k long, l long"))


def all_links(blocks: DataFrame, spaces: Subspaces, dim: int, kind: str, lead: int) -> DataFrame:
    """Link counts and links as ``vector_links`` gives them, by every pair of blocks."""
    held = np.float32 if "float" in kind else np.float64
    side = lambda x: blocks.select(*[F.col(c).alias(x + c) for c in ("block", "node", "copies", "v")])
    # of two blocks one order is taken, each block being first in about half of its pairs
    once = F.expr("ablock = bblock or (ablock < bblock) = ((xxhash64(ablock) ^ xxhash64(bblock)) & 1 = 0)")
    met = side("a").join(side("b").hint("shuffle_replicate_nl"), once)

    def read(node: pa.Scalar, copies: pa.Scalar, v: pa.Scalar) -> tuple:
        x = np.frombuffer(v.as_py(), held).reshape(-1, dim).astype(np.float64)
        norm = np.sqrt(np.cumsum(x * x, axis=1)[:, -1])
        return np.frombuffer(node.as_py(), np.int64), np.frombuffer(copies.as_py(), np.int64), x, norm, *_sides(x / norm[:, None] @ spaces.turn[:, :lead])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple = (None, None)  # the last block: the next pairs of a task have the same one
        for batch in batches:
            for a, an, ac, av, b, bn, bc, bv in zip(*batch.columns, strict=True):
                if seen[0] != a.as_py():
                    seen = (a.as_py(), read(an, ac, av))
                same, left = a.as_py() == b.as_py(), seen[1]
                right = left if same else read(bn, bc, bv)
                shift = 0 if same else len(left[0])
                node, copies = (left[k] if same else np.concatenate([left[k], right[k]]) for k in (0, 1))
                count, root = np.zeros(len(node), np.int64), np.arange(len(node))
                for m in range(0, len(left[0]), TILE):
                    for n in range(m if same else 0, len(right[0]), TILE):
                        near = left[4][m : m + TILE] @ right[5][n : n + TILE].T <= spaces.limit
                        i, j = np.divmod(np.flatnonzero(near), near.shape[1])
                        i, j = i + m, j + n
                        if same:
                            i, j = i[j > i], j[j > i]
                        for s in range(0, len(i), 1 << 15):
                            p, q = i[s : s + (1 << 15)], j[s : s + (1 << 15)]
                            linked = (left[2][p] * right[2][q]).sum(1) / (left[3][p] * right[3][q]) >= spaces.cosine
                            p, q = p[linked], q[linked] + shift
                            np.add.at(count, p, copies[q])
                            np.add.at(count, q, copies[p])
                            root = _joined(root, p, q)
                yield pa.RecordBatch.from_pydict(_said(node, count, root))

    return met.select(*[x + c for x in "ab" for c in ("block", "node", "copies", "v")]).mapInArrow(run, "a long, b long, n long")


def _keyed(classes: DataFrame, spaces: Subspaces, dim: int, kind: str, payload: bool) -> DataFrame:
    held = pa.float32() if "float" in kind else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(2), dim)
            y = spaces.rotated(x)
            node, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for b in range(len(spaces.edges)):
                for at, key, home in spaces.cells(y, b):
                    out = {"b": pa.array(np.full(len(at), b, np.int32)), "cell": pa.array(key), "home": pa.array(np.full(len(at), home)), "node": pa.array(node[at])}
                    if payload:
                        out |= {"copies": pa.array(copies[at]), "v": lists(x[at], held)}
                    yield pa.RecordBatch.from_pydict(out)

    return classes.select("node", "copies", "v").mapInArrow(run, "b int, cell long, home boolean, node long" + f", copies long, v {kind}" * payload)


def vector_links(classes: DataFrame, spaces: Subspaces, dim: int, kind: str) -> DataFrame:
    """classes(node, copies, v) -> (a, b, n): link counts of a (b null), and links a, b (n 0) that connect."""
    sizes = _keyed(classes, spaces, dim, kind, False).groupBy("b", "cell").count()
    crowded = materialise(sizes.where(F.col("count") > CHUNK).select("b", "cell", F.expr(f"cast((count + {CHUNK - 1}) div {CHUNK} as int)").alias("chunks")))
    dealt = _keyed(classes, spaces, dim, kind, True).join(crowded, ["b", "cell"], "left").fillna(1, "chunks").withColumn("c", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.expr("sequence(0, chunks - 1)"))).withColumns({"i": F.least("c", "o"), "j": F.greatest("c", "o")})

    def run(key: tuple, table: pa.Table) -> pa.Table:
        b, i, j = key[0].as_py(), key[2].as_py(), key[3].as_py()
        node, copies, home, c = (table.column(k).to_numpy() for k in ("node", "copies", "home", "c"))
        x = matrix(table.column("v"), dim)
        y = spaces.rotated(x, b)
        at = lambda own, chunk: np.flatnonzero((home == own) & (c == chunk))
        work = [(at(True, i), at(True, i), True), (at(True, i), at(False, i), False)] if i == j else [(at(True, i), at(True, j), False), (at(True, i), at(False, j), False), (at(True, j), at(False, i), False)]
        count, root = np.zeros(len(x), np.int64), np.arange(len(x))
        for left, right, upper in work:
            if not len(left) or not len(right):
                continue
            for p, q in spaces.links(b, x, y, left, right, upper):
                np.add.at(count, p, copies[q])
                np.add.at(count, q, copies[p])
                root = _joined(root, p, q)
        return pa.table(_said(node, count, root))

    # dealt by the pair of chunks too: a partitioning by cell, as a join may leave it, would do a cell's pairs in one task
    dealt = dealt.select("b", "cell", "i", "j", "home", "node", "copies", "c", "v").repartition("b", "cell", "i", "j")
    return dealt.groupBy("b", "cell", "i", "j").applyInArrow(run, "a long, b long, n long")


def near_duplicate_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of table."""
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be above 0 and at most 1")
    rows, dim = valid_vectors(table, id_col, vector_col)
    kind = table.schema[vector_col].dataType.simpleString()
    if not dim:
        return table.select(id_column(id_col).alias("vec_id"), F.lit(0).cast("long").alias("n_links"), id_column(id_col).alias("component_id"), F.lit(True).alias("kept"))
    # what a row's vector is found by again: 128 bits, so no vector is shuffled for it; -0.0 is 0.0
    key = lambda seed: F.xxhash64(F.lit(seed), F.transform("v", lambda x: x + F.lit(0).cast("float")))
    grouped = rows.groupBy("v").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    blocks = blocks_of(grouped.select("*", key(1).alias("k"), key(2).alias("l")).coalesce(max(1, -(-rows.count() // ROWS))), dim, kind)
    n, spaces = blocks.agg(F.sum(F.octet_length("node") / 8)).first()[0] or 0, Subspaces(dim, cosine)
    classes = members_of(blocks, kind, dim)
    drawn = matrix(classes.where(F.pmod(F.xxhash64(F.lit(19), "v"), F.lit(max(1, int(n)))) < SAMPLE).select("v").toArrow().column("v"), dim)
    grid = False
    if len(drawn) and n * (n - 1) / 2 > ALWAYS:
        spaces.fit(drawn, int(n))
        grid = spaces.cheaper(drawn, int(n))
    found = materialise(vector_links(classes, spaces, dim, kind) if grid else all_links(blocks, spaces, dim, kind, spaces.lead(drawn[:1024]) if len(drawn) else dim))
    reach = connected_components(found.where("b is not null").select("a", "b"))
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    named = members_of(blocks).join(counts, "node", "left").join(reach, "node", "left").select("k", "l", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    every = table.select(id_column(id_col).alias("vec_id"), F.col(vector_col).alias("v"))
    every = every.select("vec_id", F.when(takes_part("v", dim), key(1)).alias("k"), F.when(takes_part("v", dim), key(2)).alias("l")).join(named, ["k", "l"], "left")
    return every.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept"))
