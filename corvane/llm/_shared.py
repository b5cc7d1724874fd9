"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators.folds import small_batches  # noqa: F401  for the operators
from corvane.sources.shared import shared_dir, small_arrow, stored  # noqa: F401  shared_dir for the operators

#: A null id is read as this value: it ranks after every other id.
NULL_ID = 2**63 - 1
#: The white space of all contracts: space and tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """A name for a working column like each of ``names`` that df does not have (names are compared without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while (name := f"_{name}").lower() in taken:
            pass
        out.append(name)
    return out


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back: lineage ends there, lost executors cost nothing."""
    with small_arrow(df.sparkSession):
        return stored(df)


def id_column(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def source_key(name: str) -> Column:
    """A string that is never null and keeps a null source apart from every other; sorts null last."""
    return F.when(F.col(name).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(name).cast("string")))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone.  A text without multi-byte characters takes the fast way with the same result."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def buckets_for(rows: int) -> int:
    """About 500 rows a bucket up to 1,024 buckets, so that even a small table spreads; 50,000 rows beyond."""
    return max(1, -(-rows // 50_000), min(1024, -(-rows // 500)))


def ranked(df: DataFrame, group: Sequence[str], bucket: Sequence[str], order: Sequence[Column], value: str | None = None) -> DataFrame:
    """Add __rank (from 0), __total (rows) and, for a value column, __before and __sum, all within ``group``.

    Rows count in the order (bucket columns, order).  No task ever sorts a whole group: rows are sorted within
    (group, bucket), which the caller keeps to a bounded size, and a table with one row a bucket supplies offsets.
    """
    keys = [*group, *bucket]
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *([F.sum(value).alias("__v")] if value else []))
    upto = Window.partitionBy(*group).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    zero = F.lit(0).cast("long")
    offsets = [F.coalesce(F.sum("__n").over(upto), zero).alias("__o"), F.sum("__n").over(whole).alias("__total")]
    if value:
        offsets += [F.coalesce(F.sum("__v").over(upto), zero).alias("__ov"), F.sum("__v").over(whole).alias("__sum")]
    offset = counted.select(*keys, *offsets)
    inside = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("__r", F.row_number().over(inside))
    if value:
        out = out.withColumn("__b", F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(value))
    out = out.join(offset, keys).withColumn("__rank", F.col("__o") + F.col("__r") - 1)
    if value:
        out = out.withColumn("__before", F.col("__ov") + F.col("__b"))
    return out.drop("__r", "__b", "__o", "__ov")


def split_words(text: Column) -> Column:
    """How many runs of other characters than white space a text has (null: 0)."""
    bare = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+", -1))).cast("long")
