"""Line dedup: explode normalised lines, hash, count documents per hash, drop repeated lines, reassemble by position.

A line's key is the line stripped of white space at both ends with A-Z lower-cased.  The hash has 128 bits.  Only
hashes, ids and positions are shuffled to find repeats; min and max of the id per hash tell whether two documents
share a line (documents are counted for a higher threshold), so a very common line is combined before the shuffle and its documents are never gathered.  The table
of repeated lines is written before the join, so both sides are plain shuffles and Spark can split a common line's rows.

Defined cases: a null or empty text is one empty line (and comes back as an empty text); a null id ranks after all
others; rows that repeat an id are one document (a line that only they share is not repeated); other columns of the
input are carried along untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm._shared import SPACES, ascii_lower, fresh, id_column, materialise


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, text hash, position, key hash) of every line whose key has min_chars code points or more."""
    lines = docs.select(id_column(id_col).alias("__id"), F.xxhash64(text_col).alias("__t"), F.posexplode(split_lines(F.col(text_col))).alias("__pos", "__line"))
    key = ascii_lower(F.btrim("__line", F.lit(SPACES)))
    return lines.select("__id", "__t", "__pos", key.alias("__k")).where(F.char_length("__k") >= min_chars).select("__id", "__t", "__pos", F.unhex(F.md5("__k")).alias("__k"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """docs plus __kept (the new text), __n_lines and __n_dropped, which replace columns of these names.

    A line whose key is found in min_docs documents or more stays only in the one with the smallest id.
    """
    if min_docs < 2:
        raise ValueError("min_docs must be at least 2")
    keys = materialise(line_keys(docs, id_col, text_col, min_chars))
    if min_docs == 2:  # two ends that differ are two documents
        repeated = keys.groupBy("__k").agg(F.min("__id").alias("__first"), F.max("__id").alias("__last")).where("__first <> __last")
    else:  # combined by document first, so that no line's documents are gathered
        repeated = keys.groupBy("__k", "__id").agg(F.count(F.lit(1))).groupBy("__k").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= min_docs)
    repeated = materialise(repeated.select("__k", "__first"))
    own, text, drop, split = fresh(docs, "id", "text", "drop", "lines")
    drops = keys.join(repeated, "__k").where("__id <> __first").groupBy(F.col("__id").alias(own), F.col("__t").alias(text)).agg(F.collect_set("__pos").alias(drop))
    marked = docs.withColumns({own: id_column(id_col), text: F.xxhash64(text_col)}).join(drops, [own, text], "left")
    # a column of its own: written into the lambda below, the split would run once for each line
    marked, lines = marked.withColumn(split, split_lines(F.col(text_col))), F.col(split)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drop))
    kept = F.when(F.col(drop).isNull(), F.coalesce(text_col, F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    dropped = F.coalesce(F.size(drop), F.lit(0))
    return marked.withColumns({"__n_lines": F.size(lines).cast("long"), "__n_dropped": F.when(F.col(drop).isNull(), 0).otherwise(dropped).cast("long"), "__kept": kept}).drop(own, text, drop, split)
