"""Sharding by proportional stratified interleaving; DataFrame functions only.

Rows are shuffled by a seeded hash within each source and ranked there; a row's fractional rank is (rank + 1/2) / rows
of its source.  Sorted by fractional rank, every stretch of rows holds each source in proportion, so cutting the
sequence into equal stretches gives shards that match the mixture.  Both rankings work on hash or fraction buckets of
50,000 rows at most on average and a table of bucket counts, so no task sorts a whole source, however large; the text is not
shuffled for the assignment.

Law: ``rows`` - counts of any two shards differ by one at most, for every table.  Equal texts are not kept together,
which this law would not allow for a large group of copies.

Defined cases: a null source is a source of its own; a null text has size 16 and checksum 0; a null id ranks as the
largest id; rows that repeat an id (and its text) are separate rows, each with its own slot; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._shared import buckets_for, fresh, id_column, materialise, ranked, source_key

LAW = "rows"


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """(id, size, text_crc32, source_key, law, shard, slot, grown_shard), one row for each row of docs."""
    if shards < 1:
        raise ValueError("shards must be positive")
    buckets = buckets_for(docs.count())
    text = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "utf-8")
    rows = docs.select(
        id_column(id_col).alias("__id"), F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), source_key(source_col).alias("__key"),
    ).withColumn("__h", F.xxhash64(F.lit(seed), "id", "text_crc32", "size")).withColumn("__bucket", F.pmod("__h", F.lit(buckets)))
    rows = materialise(rows)  # the text is read once
    inside = ranked(rows, ["__key"], ["__bucket"], [F.col("__h"), F.col("__id"), F.col("text_crc32")])
    inside = inside.withColumns({
        "__fraction": (2 * F.col("__rank") + 1) / (2 * F.col("__total")),
        "__stretch": F.expr(f"((2 * __rank + 1) * {buckets}) div (2 * __total)"),
    }).drop("__rank", "__total")
    order = [F.col("__fraction"), F.col("__key"), F.col("__h"), F.col("__id"), F.col("text_crc32")]
    cut = ranked(inside, [], ["__stretch"], order).withColumn("shard", F.expr(f"cast(__rank * {shards} div __total as int)"))
    return cut.select(
        "id", "size", "text_crc32", F.col("__key").alias("source_key"), F.lit(LAW).alias("law"), "shard",
        F.expr(f"__rank - (shard * __total + {shards - 1}) div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int, id_col: str = "doc_id", files: int = 1, **options: str | int) -> None:
    """Write docs as Parquet, a folder a shard of ``files`` files, each a stretch of its slots in order; ids must be distinct.

    The folder's name is the shard; columns of docs that are called shard or slot stay, as _shard and _slot.
    """
    number, at, own, part = fresh(docs, "number", "at", "own", "part")
    placed = assign_shards(docs, shards, id_col, **options)
    rows = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))  # a row a shard
    placed = placed.join(F.broadcast(rows), "shard").select(F.col("id").alias(own), F.col("shard").alias(number), F.col("slot").alias(at), F.expr(f"cast(slot * {files} div rows as int)").alias(part))
    kept = docs.withColumnsRenamed({c: f"_{c}" for c in docs.columns if c.lower() in ("shard", "slot")})
    joined = kept.join(placed, F.col(id_col).eqNullSafe(F.col(own))).drop(own).withColumnRenamed(number, "shard")
    joined.repartition(shards * files, "shard", part).sortWithinPartitions("shard", at).drop(at, part).write.partitionBy("shard").parquet(path)
