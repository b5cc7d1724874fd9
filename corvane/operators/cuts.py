"""Greedy packing of ordered items without a task a sequence.

Items are packed from the first on; a cut comes before the item that would take the sum of the open part over that item's
own limit ``most``, and sticky items (headings) right before a cut move behind it.  Where the next cut lies depends only on
where a part starts.  So the next cut of every item as a start is found at once, by a search in running sums, and the cuts
that count, those reached from the first item, by pointer doubling: after k rounds of joins all cuts are known that lie
within 2^k parts.  Running sums and searches go by stretches of a sequence, joined by a table with one row a stretch; a
sequence of any length is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.sources.shared import stored

#: Items and units of size of a stretch.
STRETCH, SPREAD = 8192, 1 << 16


def _running(items: DataFrame, key: Sequence[str], value: Column, name: str, how: str, falling: bool = False, own: bool = True) -> DataFrame:
    """items(key..., i, ...) with ``name``: the sum or last value of ``value`` over the items before (falling: behind) and,
    if ``own``, at each of them; nulls are passed over."""
    rows = items.withColumns({"__v": value, "__b": F.expr(f"i div {STRETCH}")})
    order = (lambda c: F.col(c).desc()) if falling else F.col
    merge = F.sum if how == "sum" else (lambda c: F.last(c, ignorenulls=True))
    edge = 0 if own else -1
    inside = Window.partitionBy(*key, "__b").orderBy(order("i"))
    rows = rows.withColumn("__in", merge("__v").over(inside.rowsBetween(Window.unboundedPreceding, edge)))
    last = F.sum("__v") if how == "sum" else (F.max_by if not falling else F.min_by)("__v", F.when(F.col("__v").isNotNull(), F.col("i")))
    whole = rows.groupBy(*key, "__b").agg(last.alias("__t"))
    before = merge("__t").over(Window.partitionBy(*key).orderBy(order("__b")).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.join(whole.select(*key, "__b", before.alias("__o")), [*key, "__b"])
    both = F.coalesce("__o", F.lit(0)) + F.coalesce("__in", F.lit(0)) if how == "sum" else F.coalesce("__in", "__o")
    return rows.withColumn(name, both).drop("__v", "__b", "__in", "__o")


def next_cuts(items: DataFrame, key: Sequence[str]) -> DataFrame:
    """items(key..., i, size, most, sticky) -> (key..., i, next): where the part that starts at i ends, null at the end.

    i counts from 0 without gaps; sizes are not negative.
    """
    rows = _running(items, key, F.col("size"), "before", "sum", own=False)
    rows = rows.withColumn("upto", F.col("before") + F.col("size"))
    # the first item at or behind each that is no heading, and where a cut before each item comes to lie
    plain = F.when(~F.col("sticky"), F.struct("i", "upto"))
    rows = _running(rows, key, plain, "solid", "last", falling=True)
    rows = _running(rows, key, F.when(~F.col("sticky"), F.col("i") + 1), "cut", "last", own=False)
    rows = stored(rows.select(*key, "i", "most", "before", "upto", "solid", "cut"))
    limits = rows.select(*key, "most").distinct().withColumnRenamed("most", "limit")
    by = [*key, "limit"]
    # an item that can be cut before stands at (sum up to it, i); a start asks for the first beyond (its sum + limit), and
    # beyond its first item that is no heading
    places = rows.where("i > 0").select(*key, F.col("most").alias("limit"), F.col("upto").alias("v"), F.col("i").alias("at"), F.struct("i", "cut").alias("place"), F.lit(None).cast("bigint").alias("start"))
    reach = F.col("before") + F.col("limit")
    open_ = reach >= F.col("solid.upto")
    asked = rows.where("solid is not null").join(limits, list(key)).select(*by, F.when(open_, reach).otherwise(F.col("solid.upto")).alias("v"), F.when(open_, F.lit(2**62)).otherwise(F.col("solid.i")).alias("at"), F.lit(None).cast("struct<i:bigint,cut:bigint>").alias("place"), F.col("i").cast("bigint").alias("start"))
    both = places.select(*by, "v", "at", F.col("place").cast("struct<i:bigint,cut:bigint>").alias("place"), "start").unionByName(asked).withColumn("s", F.expr(f"v div {SPREAD}"))
    down = Window.partitionBy(*by, "s").orderBy(F.col("v").desc(), F.col("at").desc(), F.col("start").asc_nulls_last())
    near = both.withColumn("near", F.last("place", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1)))
    stretches = both.groupBy(*by, "s").agg(F.min("place").alias("first"))
    beyond = F.last("first", ignorenulls=True).over(Window.partitionBy(*by).orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, -1))
    found = near.where("start is not null").join(stretches.select(*by, "s", beyond.alias("beyond")), [*by, "s"])
    first = found.groupBy(*key, F.col("start").alias("i")).agg(F.min(F.coalesce("near", "beyond")).alias("place"))
    return rows.select(*key, "i").join(first.select(*key, "i", F.col("place.cut").alias("next")), [*key, "i"], "left")


def greedy_parts(items: DataFrame, key: Sequence[str]) -> DataFrame:
    """items(key..., i, size, most, sticky, ...) with ``part``, from 0: the part of each item of its sequence."""
    jump = stored(next_cuts(items, key).where("next is not null").select(*key, "i", F.col("next").cast("bigint").alias("next")))
    reached = items.where("i = 0").select(*key, F.lit(0).cast("bigint").alias("i"))
    while not jump.isEmpty():
        further = reached.join(jump, [*key, "i"]).select(*key, F.col("next").alias("i"))
        reached = stored(reached.unionByName(further).distinct())
        onward = jump.select(*key, F.col("i").alias("next"), F.col("next").alias("then"))
        jump = stored(jump.join(onward, [*key, "next"]).select(*key, "i", F.col("then").alias("next")))
    numbered = reached.select(*key, "i", (F.row_number().over(Window.partitionBy(*key).orderBy("i")) - 1).alias("__part"))
    marked = items.join(numbered, [*key, "i"], "left")
    return _running(marked, key, F.col("__part"), "part", "last").drop("__part")


def absorb_tail(parts: DataFrame, key: Sequence[str], least: int, limit: int) -> DataFrame:
    """greedy_parts' rows; a last part under ``least`` joins the part before it where both keep to ``limit``."""
    sizes = parts.groupBy(*key, "part").agg(F.sum("size").alias("n"))
    back = Window.partitionBy(*key).orderBy(F.col("part").desc())
    ends = sizes.select(*key, "part", "n", F.lead("n").over(back).alias("prior"), F.row_number().over(back).alias("r")).where((F.col("r") == 1) & (F.col("n") < least) & (F.col("n") + F.col("prior") <= limit))
    joined = parts.join(ends.select(*key, "part", F.lit(True).alias("tail")), [*key, "part"], "left")
    return joined.withColumn("part", F.when(F.col("tail"), F.col("part") - 1).otherwise(F.col("part"))).drop("tail")
