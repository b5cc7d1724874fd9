"""Exact medians by rank selection: no task sees all values of a group.

A pass counts a group's values in BUCKETS equal ranges between its bounds and keeps the range, from its least to its
greatest value, that holds the middle ranks.  When few rows are left between the bounds, or one value, the ranks are read
from counts of distinct values.  Each pass is one grouped count, combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.sources.shared import stored

BUCKETS, ROWS, PASSES = 1024, 100_000, 64


def medians(table: DataFrame, column: str, keys: Sequence[str] = (), rows: int = ROWS) -> DataFrame:
    """(keys..., median double, values long): nulls do not count; a group of nulls alone, or an empty table, has no row.

    Null keys are a group.  NaN counts as the greatest value.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    held = stored(table.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(column).cast("double").alias("v")).where("v is not null"))
    if not keys:
        held, names = held.withColumn("__k", F.lit(0)), ["__k"]
    bounds = held.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    # ranks from 1: of the two middle values, and how many values are below the bounds and between them
    bounds = stored(bounds.select(*names, "n", "lo", "hi", F.expr("(n + 1) div 2").alias("r1"), F.expr("n div 2 + 1").alias("r2"), F.lit(0).cast("long").alias("below"), F.col("n").alias("within")))
    for _ in range(PASSES):
        open_ = bounds.where((F.col("within") > rows) & (F.col("lo") < F.col("hi")))
        if open_.isEmpty():
            break
        b = open_.select(*[F.col(n).alias(f"b{n}") for n in names], "lo", "hi")
        inside = held.join(b, [held[n].eqNullSafe(b[f"b{n}"]) for n in names]).where("v between lo and hi")
        # halves first: the width of the bounds may pass what a double holds
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        # bounds that are not finite, or too near, are parted from the rest
        bucket = F.when(F.isnan(share) | F.isnan("v"), F.when(F.col("v") == F.col("lo"), 0).when(F.col("v") == F.col("hi"), BUCKETS).otherwise(1)).otherwise(F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))).cast("int")
        counted = inside.groupBy(*names, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = F.sum("c").over(Window.partitionBy(*names).orderBy("bucket"))
        ranked = counted.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("c"))
        o = open_.select(*[F.col(n).alias(f"b{n}") for n in names], "n", "r1", "r2", "below")
        hit = ranked.join(o, [ranked[n].eqNullSafe(o[f"b{n}"]) for n in names]).where("below + upto >= r1 and below + before < r2")
        new = hit.groupBy(*names).agg(F.first("n").alias("n"), F.min("least").alias("lo"), F.max("most").alias("hi"), F.first("r1").alias("r1"), F.first("r2").alias("r2"), F.min(F.col("below") + F.col("before")).alias("below"), F.sum("c").alias("within"))
        closed = bounds.where((F.col("within") <= rows) | ~(F.col("lo") < F.col("hi")))
        bounds = stored(closed.unionByName(new.select(*closed.columns)))
    b = bounds.select(*[F.col(n).alias(f"b{n}") for n in names], "n", "lo", "hi", "r1", "r2", "below")
    values = held.join(b, [held[n].eqNullSafe(b[f"b{n}"]) for n in names]).where("v between lo and hi").groupBy(*names, "v", "n", "r1", "r2", "below").agg(F.count(F.lit(1)).alias("c"))
    upto = F.col("below") + F.sum("c").over(Window.partitionBy(*names).orderBy("v"))
    ranked = values.withColumn("upto", upto)
    middle = lambda r: F.min(F.when(F.col("upto") >= F.col(r), F.col("v")))
    found = ranked.groupBy(*names).agg(((middle("r1") + middle("r2")) / 2).alias("median"), F.first("n").alias("values"))
    return found.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=False)], "median", "values")
