"""Centroid clustering of quantised vectors with Drake's adaptive bounds.

Each component x becomes the integer floor(256 x), so distances, sums and centroids are exact.  A vector carries the
numbers of its next nearest centroids (as many as the bounds of a round), a lower bound of the distance to each, and one
lower bound (the remainder) of the distance to every other centroid.  When centroids have moved, each bound shrinks by its
centroid's move and the remainder by the largest move.  A round takes the exact distance to the vector's own centroid;
bounds above it certify that their centroids are farther.  Centroids whose bound does not are measured exactly; if then the
remainder is not above the nearest found either, the order can't be certified and the vector is compared with all
centroids anew.  Bounds are rounded towards safety and must be strictly above, so ties are always measured, and go to the
smaller number.  How many bounds are kept adapts: it falls to the most that a vector needed, not below an eighth of the
centroids.

A round is one pass over the vectors, written with their bounds in the shared folder, and one grouped aggregation of sums
(combined before the shuffle); the driver holds centroids alone.

Defined cases: vectors that are null, of another number of components than ``dim``, or that hold null or non-finite
components are not kept; a zero vector is.  Rows that repeat an id are vectors of their own; they and null ids (hashed as
an empty number) are ordered by their components where seeds tie.  Fewer vectors than centroids: each is one.  An empty
table gives no rows.  Components beyond 2^27 after scaling could pass 64 bits and raise ValueError.  Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm._shared import materialise

SCALE, DIM, CENTROIDS, ROUNDS, SEED = 256, 64, 40, 5, 2
LARGEST = 1 << 27
#: Bounds are lowered and distances raised by this share, far above the rounding of a few hundred additions.
SLACK = 1e-12
ROWS = 8192


def quantised(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, q array<int>) of the vectors that are kept."""
    v = F.col(vector_col).cast("array<double>")
    fit = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") == dim)).where(fit)
    checked = lambda x: F.when(F.abs(x * scale) <= LARGEST, F.floor(x * scale)).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST // scale}"))).cast("int")
    return rows.select("vec_id", F.transform("v", checked).alias("q"))


def _seed_hash(seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)


def seeds(vectors: DataFrame, k: int, dim: int = DIM, seed: int = SEED) -> np.ndarray:
    """The first ``k`` vectors by the hash of their id, one row each."""
    first = vectors.orderBy(_seed_hash(seed), "q").limit(k).select("q").collect()
    return np.array([r.q for r in first], np.int64).reshape(len(first), dim)


class Bounds:
    """One round's centroids and how far each has moved since the round before."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None, kept: int) -> None:
        self.centroids, self.kept = centroids, kept
        apart = centroids - (centroids if before is None else before)
        self.moved = np.sqrt((apart * apart).sum(1).astype(np.float64)) * (1 + SLACK)

    def distances(self, q: np.ndarray, rows: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Exact squared distances of q[rows] to the centroids numbered ``to``."""
        apart = q[rows] - self.centroids[to]
        return np.einsum("ij,ij->i", apart, apart)

    def scan(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cluster, distance, next centroids, their bounds, remainder) of vectors compared with every centroid."""
        every = np.arange(len(self.centroids))
        d = np.stack([self.distances(q, slice(None), np.full(len(q), c)) for c in every], 1)
        order = np.lexsort((np.broadcast_to(every, d.shape), d), axis=1)
        near = np.take_along_axis(d, order, 1)
        root = np.sqrt(near.astype(np.float64)) * (1 - SLACK)
        rest = root[:, self.kept + 1] if len(every) > self.kept + 1 else np.full(len(q), np.inf)
        return order[:, 0], near[:, 0], order[:, 1 : self.kept + 1], root[:, 1 : self.kept + 1], rest

    def round(self, q: np.ndarray, cluster: np.ndarray, near: np.ndarray, low: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same of vectors with the bounds of the round before, then centroids measured, and bounds needed, of each."""
        cluster, near = cluster.copy(), near.copy()
        low = (low - self.moved[near]) * (1 - SLACK) - SLACK
        rest = (rest - self.moved.max()) * (1 - SLACK) - SLACK
        d = self.distances(q, slice(None), cluster)
        top = np.sqrt(d.astype(np.float64)) * (1 + SLACK)
        row, z = np.nonzero(low <= top[:, None])
        measured = np.bincount(row, minlength=len(q)) + 1
        needed = np.zeros(len(q), np.int64)
        np.maximum.at(needed, row, z + 1)
        exact = self.distances(q, row, near[row, z])
        low[row, z] = np.sqrt(exact.astype(np.float64)) * (1 - SLACK)
        # the nearest of the own and the measured centroids, ties to the smaller number
        every_row, every_d = np.concatenate([np.arange(len(q)), row]), np.concatenate([d, exact])
        every_c, every_z = np.concatenate([cluster, near[row, z]]), np.concatenate([np.full(len(q), -1), z])
        order = np.lexsort((every_c, every_d, every_row))
        first = order[np.concatenate([[True], every_row[order][1:] != every_row[order][:-1]])] if len(q) else order
        best, own = every_d[first], cluster.copy()
        swap = np.flatnonzero(every_z[first] >= 0)
        place = every_z[first][swap]
        cluster[swap] = every_c[first][swap]
        near[swap, place] = own[swap]
        low[swap, place] = np.sqrt(d[swap].astype(np.float64)) * (1 - SLACK)
        lost = np.flatnonzero(rest <= np.sqrt(best.astype(np.float64)) * (1 + SLACK))
        if near.shape[1] > self.kept:
            rest = np.minimum(rest, low[:, self.kept :].min(1))
            near, low = near[:, : self.kept], low[:, : self.kept]
        if len(lost):
            cluster[lost], best[lost], near[lost], low[lost], rest[lost] = self.scan(q[lost])
            measured[lost] += len(self.centroids)
            needed[lost] = self.kept
        return cluster, best, near, low, rest, measured, needed


_STATE = "vec_id long, q array<int>, cluster int, distance long, near array<int>, low array<double>, rest double, measured long, needed long"


def _table(column: pa.Array, rows: int, kind: type) -> np.ndarray:
    return np.asarray(column.flatten()).astype(kind).reshape(rows, -1) if rows else np.zeros((0, 0), kind)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel(), kind))


def assigned(rows: DataFrame, bounds: Bounds) -> DataFrame:
    """Rows of quantised() or of the round before, with each vector's cluster, distance and bounds (see _STATE)."""
    new = "near" not in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            n = batch.num_rows
            q = _table(batch.column(1), n, np.int64)
            if new:
                found = *bounds.scan(q), np.full(n, len(bounds.centroids)), np.full(n, bounds.kept)
            else:
                found = bounds.round(q, batch.column(2).to_numpy().astype(np.int64), _table(batch.column(3), n, np.int64), _table(batch.column(4), n, np.float64), batch.column(5).to_numpy())
            cluster, distance, near, low, rest, measured, needed = found
            columns = [batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(distance), _lists(near, pa.int32()), _lists(low, pa.float64()), pa.array(rest), pa.array(measured), pa.array(needed)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _STATE.split(", ")])

    return rows.select("vec_id", "q", *([] if new else ["cluster", "near", "low", "rest"])).mapInArrow(run, _STATE)


def moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid as the floor of the mean of its vectors; one without vectors stays."""
    sums = [F.sum(F.col("q")[j].cast("long")).alias(f"s{j}") for j in range(centroids.shape[1])]
    out = centroids.copy()
    for row in state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        out[row.cluster] = [row[f"s{j}"] // row.n for j in range(centroids.shape[1])]
    return out


def clusters(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, measured), a row for each vector kept.

    ``measured`` counts the centroids compared with the vector in the last round.
    """
    if k < 1 or rounds < 0:
        raise ValueError("k must be 1 at least and rounds not negative")
    vectors = materialise(quantised(table, id_col, vector_col, dim, scale))
    centroids, before, rows = seeds(vectors, k, dim, seed), None, vectors
    kept = min(max(1, len(centroids) // 4), max(0, len(centroids) - 1))
    for r in range(rounds + 1):
        if not len(centroids):
            break
        rows = materialise(assigned(rows, Bounds(centroids, before, kept)))
        if r == rounds:
            break
        needed = rows.agg(F.max("needed")).first()[0] if r else kept
        kept = min(kept, max(len(centroids) // 8, needed))
        centroids, before = moved(rows, centroids), centroids
    if not len(centroids):
        return table.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, measured long")
    inertia = {r.cluster: r.d for r in rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    own = of([inertia.get(c, 0) for c in range(len(centroids))]).cast("long")
    digest = of([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()])
    return rows.select("vec_id", "cluster", "distance", own.alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), digest.alias("centroid_sha256"), "measured")


def _oracle(k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> str:
    steps = [f"""with v as (
  select vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as q from embeddings
  where len(embedding) = {dim} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as (select (row_number() over (order by sha256('{seed}:' || vec_id)) - 1)::int as c, q from v qualify row_number() over (order by sha256('{seed}:' || vec_id)) <= {k})"""]
    for r in range(rounds + 1):
        steps.append(f"a{r} as (select vec_id, any_value(v.q) as q, min(struct_pack(d := list_sum(list_transform(list_zip(v.q, c{r}.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint, c := c)) as b from v, c{r} group by vec_id)")
        if r < rounds:
            steps.append(f"""m{r} as (select c, list(((s - ((s % n) + n) % n) // n)::bigint order by j) as q from (
  select b.c as c, j, sum(q[j])::hugeint as s, count(*)::hugeint as n from (select b, q, unnest(range(1, {dim + 1})) as j from a{r}) group by 1, 2) group by c)""")
            steps.append(f"c{r + 1} as (select o.c, coalesce(m.q, o.q) as q from c{r} o left join m{r} m on m.c = o.c)")
    last = f"""select vec_id, b.c as cluster, b.d as distance, (sum(b.d) over (partition by b.c))::bigint as cluster_inertia, (sum(b.d) over ())::bigint as inertia,
  sha256(array_to_string(o.q, ',')) as centroid_sha256 from a{rounds} join c{rounds} o on o.c = b.c"""
    return ",\n".join(steps) + "\n" + last


ORACLE_SQL = _oracle()
