"""Connected components of a graph of links, in rounds of grouped aggregations (large star, then small star).

No task or driver holds the graph.  A node with very many links is a key of a sum-like aggregation, which is combined
before the shuffle, and of a join whose large partitions Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._shared import materialise


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> (node long, component long): the smallest node reachable, for each node with a link.

    Links to oneself and repeated links are harmless; an empty table of links gives an empty result.
    """
    step = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(step)
    while mark[0]:
        both = step.unionAll(step.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialise(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        found = _mark(after)
        step, same, mark = after, found == mark, found
        if same:
            break
    return step.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(step.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
