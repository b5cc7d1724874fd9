"""Pre/post assessment: percentages and gains of participants, and class gains overall, by condition and by objective."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: So many groups of items are broadcast at most; more meet the participants by pairs of partitions.
SENT = 10_000


def problems(items: DataFrame, scores: DataFrame) -> DataFrame:
    """(participant_id, problem): scores of unknown items and scores out of range."""
    known = scores.join(items.select("form", "item_id", "max_score"), ["form", "item_id"], "left")
    return known.select("participant_id", F.when(F.col("max_score").isNull(), F.concat(F.lit("unknown item "), "item_id")).when((F.col("points") < 0) | (F.col("points") > F.col("max_score")), F.concat(F.lit("score out of range for "), "item_id")).alias("problem")).where("problem is not null")


def check(items: DataFrame, scores: DataFrame) -> None:
    if row := problems(items, scores).limit(1).collect():
        raise ValueError(f"{row[0].participant_id}: {row[0].problem}")


def percentages(items: DataFrame, scores: DataFrame, participants: DataFrame, by: list[str]) -> DataFrame:
    """(participant_id, *by, pre, post): 100 x points over the form's whole score; a missing item counts 0.

    The whole score needs no participants x items product: it is a total of the item table.
    """
    share = items.groupBy("form", *by).agg(F.sum("max_score").alias("total"))
    got = scores.join(items.select("form", "item_id", *by), ["form", "item_id"]).groupBy("participant_id", "form", *by).agg(F.sum("points").alias("points"))
    frame = participants.select("participant_id")
    if by:  # the result has a row for each of these
        groups = items.select(*by).distinct()
        frame = frame.crossJoin(F.broadcast(groups) if groups.limit(SENT + 1).count() <= SENT else groups)
    for form in ("pre", "post"):
        own = got.where(F.col("form") == form).select("participant_id", *by, F.col("points").alias(form))
        total = share.where(F.col("form") == form).select(*by, F.col("total").alias(f"{form}_total"))
        frame = frame.join(own, ["participant_id", *by], "left")
        frame = frame.join(total, by) if by else frame.crossJoin(F.broadcast(total))  # one row
    return frame.select("participant_id", *by, *[(100 * F.coalesce(F.col(f), F.lit(0)) / F.col(f"{f}_total")).alias(f) for f in ("pre", "post")])


def gains(pre: Column, post: Column) -> list[Column]:
    """Rounded pre, post and absolute gain, and the normalised gain (null where pre is 100 or more)."""
    normal = F.when(pre < 100, F.round((post - pre) / F.when(pre < 100, 100 - pre), 4))
    return [F.round(pre, 2).alias("pre"), F.round(post, 2).alias("post"), F.round(post - pre, 2).alias("absolute_gain"), normal.alias("normalized_gain")]


def participant_gains(items: DataFrame, scores: DataFrame, participants: DataFrame, by_objective: bool = False) -> DataFrame:
    by = ["objective_id"] if by_objective else []
    return percentages(items, scores, participants, by).select("participant_id", *by, *gains(F.col("pre"), F.col("post")))


def class_gains(rows: DataFrame, *by: str) -> DataFrame:
    """Gains of the means of already rounded percentages, and the mean of the individual gains that exist."""
    means = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("pre").alias("mp"), F.avg("post").alias("mq"), F.round(F.avg("normalized_gain"), 4).alias("mean_individual_normalized_gain"))
    return means.select(*by, "n", *gains(F.col("mp"), F.col("mq")), "mean_individual_normalized_gain")
