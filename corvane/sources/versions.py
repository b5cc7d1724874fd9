"""Vector tables in versions.

A version is a manifest: a row that names data segments, tombstones and digests.  Files are never changed or replaced;
a change writes a new segment, then the tombstones of the rows that it replaces, and last the manifest of the next
version, which makes it visible.  A writer that dies before leaves files that no manifest names, and the version before
stays whole and readable.  One writer at a time: one that finds its version number taken fails.

    data/<id>        chunk_id, vector, payload columns, vector_hash, payload_hash
    tombstones/<id>  chunk_id, vector_hash, payload_hash of rows that a version replaced or deleted
    versions/<n>     one row of JSON, see MANIFEST

Counts and digests of a segment are observed while it is written.  A digest is a XOR of row hashes, so the digest of a
version is that of its segments and its tombstones together, and no change reads the rows that it leaves alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

PART = "struct<name:string,version:int,rows:bigint,vectors:bigint,payload:bigint>"
MANIFEST = f"version int, model string, corpus string, dim int, rows bigint, vectors bigint, payload bigint, segments array<{PART}>, tombstones array<{PART}>"
HASHES = ("vector_hash", "payload_hash")
RowHash = Callable[[Sequence[str]], Column]


def row_hash(columns: Sequence[str]) -> Column:
    """XXH64 of the columns' values, nulls told from each other by their place."""
    return F.xxhash64(*columns, *[F.col(c).isNull() for c in columns])


def history(spark: SparkSession, path: str) -> DataFrame:
    """All versions' manifests; an AnalysisException where there is no index."""
    return spark.read.schema(MANIFEST).json(f"{path}/versions/*")


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Row:
    """The manifest of a version, by default of the last."""
    rows = history(spark, path)
    found = (rows if version is None else rows.where(F.col("version") == version)).orderBy(F.col("version").desc()).first()
    if found is None:
        raise ValueError(f"the index has no version {version}")
    return found


def _exists(spark: SparkSession, path: str) -> bool:
    """By Hadoop's file system, as a read that fails would be logged."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def _latest(spark: SparkSession, path: str) -> Row | None:
    return history(spark, path).orderBy(F.col("version").desc()).first() if _exists(spark, f"{path}/versions") else None


def guard(found: Row, model: str | None = None, corpus: str | None = None, dim: int | None = None) -> None:
    """Raise if the index was made by another model, from another corpus or with other vectors than asked for."""
    asked = {"model": model, "corpus": corpus, "dim": dim}
    if stale := [f"{k} is {found[k]}, not {v}" for k, v in asked.items() if v is not None and found[k] != v]:
        raise ValueError("stale index: " + "; ".join(stale))


def _put(table: DataFrame, path: str, kind: str, version: int) -> dict:
    """Write a part; its count and digests are those of the rows as they go to the files."""
    name, seen = uuid.uuid4().hex, Observation()
    figures = [F.count(F.lit(1)).alias("rows"), F.bit_xor("vector_hash").alias("vectors"), F.bit_xor("payload_hash").alias("payload")]
    if kind == "data":
        figures += [F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("dim"), F.count_if(F.col("chunk_id").isNull()).alias("unnamed")]
    table.observe(seen, *figures).write.parquet(f"{path}/{kind}/{name}")
    found = {k: v or 0 for k, v in seen.get.items()}
    if found["rows"] and kind == "data" and (found["least"] != found["dim"] or found["unnamed"]):
        raise ValueError("vectors must have one dimension and a chunk_id each")
    return {"name": name, "version": version} | found


def _commit(spark: SparkSession, path: str, version: int, model: str, corpus: str, dim: int, segments: list[dict], tombstones: list[dict]) -> Row:
    parts = [[{k: p[k] for k in ("name", "version", "rows", "vectors", "payload")} for p in own] for own in (segments, tombstones)]
    rows = sum(p["rows"] for p in parts[0]) - sum(p["rows"] for p in parts[1])
    digests = [reduce(lambda a, p: a ^ p[c], parts[0] + parts[1], 0) for c in ("vectors", "payload")]  # noqa: B023
    row = spark.createDataFrame([(version, model, corpus, dim, rows, *digests, *parts)], MANIFEST)
    target = f"{path}/versions/{version:08d}"
    if _exists(spark, f"{target}/_SUCCESS"):
        raise ValueError(f"another writer made version {version}")
    row.coalesce(1).write.mode("overwrite").json(target)  # what is there is what a killed writer left
    return row.first()


def _hashed(vectors: DataFrame, hash_: RowHash) -> DataFrame:
    rest = sorted(c for c in vectors.columns if c not in ("chunk_id", "vector"))
    return vectors.withColumns({"vector_hash": hash_(["chunk_id", "vector"]), "payload_hash": hash_(["chunk_id", *rest])})


def _known(spark: SparkSession, path: str, found: Row, columns: Sequence[str] | None = None) -> DataFrame:
    """The live rows of a version: no tombstone of a later version than their segment's names them."""
    pick = (lambda t: t.select(*columns)) if columns else (lambda t: t)
    data = [pick(spark.read.parquet(f"{path}/data/{p.name}")).withColumn("__v", F.lit(p.version)) for p in found.segments]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), data)
    if gone := [spark.read.parquet(f"{path}/tombstones/{p.name}").select("chunk_id", F.lit(p.version).alias("__dead")) for p in found.tombstones if p.rows]:
        dead = reduce(DataFrame.unionAll, gone).groupBy("chunk_id").agg(F.max("__dead").alias("__dead")).withColumnRenamed("chunk_id", "__id")
        rows = rows.join(dead, (F.col("chunk_id") == F.col("__id")) & (F.col("__v") < F.col("__dead")), "left_anti")
    return rows.drop("__v")


def _no_repeats(rows: DataFrame) -> None:
    if twice := rows.groupBy("chunk_id").count().where("count > 1").limit(3).collect():
        raise ValueError(f"chunk_id given twice: {[r['chunk_id'] for r in twice]}")


def create(vectors: DataFrame, path: str, model: str, corpus: str, recreate: bool = False, hash_: RowHash = row_hash) -> Row:
    """The first version of an index of (chunk_id, vector, payload...); refuses to replace one unless told to, and then
    the old versions stay readable by their number."""
    spark = vectors.sparkSession
    before = _latest(spark, path)
    if before is not None and not recreate:
        raise ValueError(f"{path} has an index already; recreate=True replaces it")
    version = before.version + 1 if before is not None else 1
    segment = _put(_hashed(vectors, hash_), path, "data", version)
    _no_repeats(spark.read.parquet(f"{path}/data/{segment['name']}").select("chunk_id"))
    return _commit(spark, path, version, model, corpus, segment["dim"], [segment], [])


def upsert(path: str, vectors: DataFrame, model: str, corpus: str, checked_as: str | None = None, hash_: RowHash = row_hash) -> Row:
    """A version with these vectors, in place of those of the same chunk_id; the index must be that of ``checked_as``
    (default: the same corpus)."""
    spark = vectors.sparkSession
    before = manifest(spark, path)
    guard(before, model, checked_as or corpus)
    segment = _put(_hashed(vectors, hash_), path, "data", before.version + 1)
    if segment["rows"] and before.rows and segment["dim"] != before.dim:
        raise ValueError(f"the index has {before.dim} dimensions, not {segment['dim']}")
    held = {c for p in before.segments[-1:] for c in spark.read.parquet(f"{path}/data/{p.name}").columns} - {"chunk_id", "vector", *HASHES}
    if held != set(vectors.columns) - {"chunk_id", "vector"}:
        raise ValueError(f"the index has the payload columns {sorted(held)}")
    ids = spark.read.parquet(f"{path}/data/{segment['name']}").select("chunk_id")
    _no_repeats(ids)
    return _replace(spark, path, before, ids, [segment], corpus)


def delete(path: str, ids: DataFrame, corpus: str | None = None) -> Row:
    """A version without the rows of ids(chunk_id); ids that are not there are no error."""
    before = manifest(ids.sparkSession, path)
    return _replace(ids.sparkSession, path, before, ids.select("chunk_id").distinct(), [], corpus or before.corpus)


def _replace(spark: SparkSession, path: str, before: Row, ids: DataFrame, new: list[dict], corpus: str) -> Row:
    gone = _known(spark, path, before, ("chunk_id", *HASHES)).join(ids, "chunk_id", "left_semi")
    tombstones = _put(gone, path, "tombstones", before.version + 1)
    kept = [[p.asDict() for p in own] for own in (before.segments, before.tombstones)]
    dim = new[0]["dim"] if new and new[0]["rows"] else before.dim
    return _commit(spark, path, before.version + 1, before.model, corpus, dim, kept[0] + new, kept[1] + [tombstones] * bool(tombstones["rows"]))


def compact(spark: SparkSession, path: str) -> Row:
    """A version of one segment without tombstones, which holds the same rows; its digests must come out the same."""
    before = manifest(spark, path)
    segment = _put(_known(spark, path, before), path, "data", before.version + 1)
    if (segment["rows"], segment["vectors"], segment["payload"]) != (before.rows, before.vectors, before.payload):
        raise ValueError("the rows of the index do not agree with its manifest")
    return _commit(spark, path, before.version + 1, before.model, before.corpus, before.dim, [segment], [])


def read(spark: SparkSession, path: str, model: str | None = None, corpus: str | None = None, version: int | None = None, dim: int | None = None) -> DataFrame:
    """The vectors of a version (by default the last), if its manifest agrees with what is asked; nothing is scanned for it."""
    found = manifest(spark, path, version)
    guard(found, model, corpus, dim)
    return _known(spark, path, found).drop(*HASHES)


def verify(spark: SparkSession, path: str, version: int | None = None, hash_: RowHash = row_hash) -> Row:
    """The manifest, after hashing every live row anew; raises if rows or digests differ from it."""
    found = manifest(spark, path, version)
    rows = _hashed(_known(spark, path, found).drop(*HASHES), hash_)
    now = rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor("vector_hash"), F.lit(0)).alias("vectors"), F.coalesce(F.bit_xor("payload_hash"), F.lit(0)).alias("payload")).first()
    if stale := [c for c in ("rows", "vectors", "payload") if now[c] != found[c]]:
        raise ValueError(f"damaged index: {stale} differ from the manifest")
    return found


def scroll(index: DataFrame, after: str | None, limit: int) -> DataFrame:
    """The next ``limit`` rows of an index by chunk_id, behind ``after`` (None: from the start)."""
    rows = index if after is None else index.where(F.col("chunk_id") > F.lit(after))
    return rows.orderBy("chunk_id").limit(limit)

