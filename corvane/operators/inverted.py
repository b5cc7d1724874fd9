"""A stored inverted index for BM25 with bounded top-k.

Texts are tokenised once.  Each posting has an impact, its term's share of a score without the query's weight; postings of
a term lie in LEVELS bands of impact and, within a band, in blocks of BLOCK at most.  A block is of documents that a task
read one after the other (PACKED postings at a time, of all terms), so no term's postings are ever shuffled or held whole.
A block carries its highest impact; a term carries the count and the range of impacts of each of its bands.

A search runs all queries at once:

1. The bands give a first threshold: the k-th best impact of one term, with its weight, is a score that k documents reach.
2. Postings of the highest small bands, summed by document, give a better one; a sum over some terms is a lower bound.
3. Terms whose highest contributions together stay below the threshold can't bring in a document; the others are
   essential.  Of their blocks those are read whose maximum, with all that other terms can add, reaches the threshold.
4. A document's sum over essential terms and what the others could add decide whether it is looked up in those others: k
   documents have the k-th best of these sums at least, so what can't reach it is left out as well.

What is left out has a score below that of k documents, so the result is that of scoring everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.text import tokens
from corvane.operators.retrieval import B, K1, check_top_k, counted, impact, inverse_frequency, merged, top
from corvane.sources.shared import small_arrow, stored, written

BLOCK, LEVELS = 1024, 16
#: Postings of a band that may be summed for the threshold, and how many of a query are wanted, times k.
SEED_ROWS, SEEDS = 16_384, 64
#: Scores are rounded to 6 places: a bound must be below by more than that.
MARGIN = 2e-6
#: Postings that a task puts together by term before they are shuffled, and rows of them that go back to Spark at once.
PACKED, SENT_ROWS = 1 << 20, 1 << 14


@dataclass
class InvertedIndex:
    """stats(n, avgdl, k1, b): one row; terms(term, df, bands array<struct<level, n, low, high>>), highest band first;
    blocks(term, level, block, n, high, postings array<struct<doc_id, tf, dl>>)."""

    stats: DataFrame
    terms: DataFrame
    blocks: DataFrame

    @cached_property
    def figures(self) -> tuple[int, float, float, float]:
        return tuple(self.stats.select("n", "avgdl", "k1", "b").first())


def pieces(rows: DataFrame, avgdl: float, k1: float, b: float, block: int) -> DataFrame:
    """Rows of ``retrieval.merged`` -> (term, level, n, low, high, postings): about PACKED postings at a time are put together
    by term and level, ``block`` in a row at most."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches).combine_chunks()
        terms, tf = (pa.concat_arrays(t.column(c).chunks) for c in ("terms", "tfs"))
        row = np.repeat(np.arange(len(t)), terms.value_lengths().to_numpy())
        tf, dl, terms = tf.flatten().to_numpy(), t.column("dl").to_numpy()[row], terms.flatten().dictionary_encode()
        own = impact(tf.astype(float), dl, avgdl, k1, b)
        key = terms.indices.to_numpy().astype(np.int64) * LEVELS + np.minimum(np.floor(own * LEVELS / (k1 + 1)), LEVELS - 1).astype(np.int64)
        order = np.argsort(key, kind="stable")
        key, own = key[order], own[order]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        within = np.arange(len(key)) - np.repeat(new, np.diff(np.r_[new, len(key)]))
        starts = np.flatnonzero(within % block == 0)
        ends = np.r_[starts, len(key)].astype(np.int32)
        each = pa.StructArray.from_arrays([t.column("doc_id").chunk(0).take(pa.array(row[order])), pa.array(tf[order]), pa.array(dl[order].astype(np.int32))], ["doc_id", "tf", "dl"])
        columns = {
            "term": terms.dictionary.take(pa.array(key[starts] // LEVELS)), "level": pa.array((key[starts] % LEVELS).astype(np.int32)), "n": pa.array(np.diff(ends).astype(np.int64)),
            "low": pa.array(np.minimum.reduceat(own, starts)), "high": pa.array(np.maximum.reduceat(own, starts)), "postings": pa.ListArray.from_arrays(pa.array(ends), each),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch.column("terms").flatten())
            if n >= PACKED:
                yield from parts(packed(held))
                held, n = [], 0
        if n:
            yield from parts(packed(held))

    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        return (batch.slice(i, SENT_ROWS) for i in range(0, batch.num_rows, SENT_ROWS))

    return rows.select("doc_id", "dl", "terms", "tfs").mapInArrow(run, f"term string, level int, n long, low double, high double, postings array<struct<doc_id:{kind},tf:int,dl:int>>")


def build(docs: DataFrame, path: str | None = None, k1: float = K1, b: float = B, block: int = BLOCK) -> InvertedIndex:
    """The index of docs(doc_id, text), written below ``path`` (default: the shared folder).  A null text has no terms and no
    length; rows that repeat an id and a length are one document.

    Terms are counted where a text is read, and postings put together there: none is shuffled, only the figures of bands.
    """
    spark = docs.sparkSession
    keep = (lambda t, name: written(t, f"{path}/{name}")) if path else (lambda t, _: stored(t))
    rows = counted(docs)
    n, length, texts = rows.agg(F.count(F.lit(1)), F.sum("dl"), F.count("dl")).first()  # a null text is a document without a length
    avgdl = (length or 0) / max(texts, 1)
    stats = keep(spark.createDataFrame([(n, avgdl, k1, b)], "n long, avgdl double, k1 double, b double").coalesce(1), "stats")
    with small_arrow(spark):
        blocks = keep(pieces(merged(rows), avgdl or 1.0, k1, b, block).select("term", "level", F.monotonically_increasing_id().alias("block"), "n", "low", "high", "postings"), "blocks")
    bands = blocks.groupBy("term", "level").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    terms = keep(bands.groupBy("term").agg(F.sum("n").alias("df"), F.reverse(F.array_sort(F.collect_list(F.struct("level", "n", "low", "high")))).alias("bands")), "terms")
    return InvertedIndex(stats, terms, blocks)


def load(spark: SparkSession, path: str) -> InvertedIndex:
    return InvertedIndex(*(spark.read.parquet(f"{path}/{name}") for name in ("stats", "terms", "blocks")))


def index_stats(index: InvertedIndex) -> DataFrame:
    """(documents, vocabulary, avgdl): one row."""
    return index.terms.agg(F.count(F.lit(1)).alias("vocabulary")).crossJoin(index.stats).select(F.col("n").alias("documents"), "vocabulary", F.round("avgdl", 4).alias("avgdl"))


def term_statistics(index: InvertedIndex) -> DataFrame:
    """(term, df, idf) of the vocabulary."""
    n = index.figures[0]
    return index.terms.select("term", "df", inverse_frequency(F.col("df"), F.lit(n)).alias("idf"))


def weighed(index: InvertedIndex, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, term, w, bands, most, reached): most is the term's highest contribution, reached one that k documents have."""
    n = index.figures[0]
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    found = asked.join(index.terms, "term").withColumn("w", F.col("qtf") * inverse_frequency(F.col("df"), F.lit(n)))
    kth = F.aggregate(
        "bands", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("low")),
        lambda s, x: F.when(s["n"] >= k, s).otherwise(F.struct((s["n"] + x["n"]).alias("n"), F.when(s["n"] + x["n"] >= k, x["low"]).otherwise(0.0).alias("low"))),
        lambda s: s["low"],
    )
    return found.select("query_id", "term", "w", "bands", (F.col("w") * F.col("bands")[0]["high"]).alias("most"), (F.col("w") * kth).alias("reached"))


def _postings(blocks: DataFrame) -> DataFrame:
    return blocks.select(*[c for c in blocks.columns if c != "postings"], F.explode("postings").alias("p")).select("*", "p.doc_id", "p.tf", "p.dl").drop("p")


def thresholds(index: InvertedIndex, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, threshold): a score that at least k documents reach, 0 where none is known."""
    _, avgdl, k1, b = index.figures
    bands = asked.select("query_id", "term", "w", F.explode("bands").alias("band")).select("query_id", "term", "w", "band.level", "band.n", (F.col("w") * F.col("band.high")).alias("bound")).where(F.col("n") <= SEED_ROWS)
    before = F.sum("n").over(Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "term", "level").rowsBetween(Window.unboundedPreceding, -1))
    seeds = bands.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < SEEDS * k).select("query_id", "term", "level", "w")
    hit = _postings(index.blocks.select("term", "level", "postings").join(seeds, ["term", "level"]))
    sums = hit.groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * impact(F.col("tf"), F.col("dl"), avgdl or 1.0, k1, b)).alias("s"))
    best = sums.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("s").desc()))).where(F.col("r") <= k)
    kth = best.where(F.col("r") == k).select("query_id", "s")
    return asked.groupBy("query_id").agg(F.max("reached").alias("first")).join(kth, "query_id", "left").select("query_id", F.greatest("first", F.coalesce("s", F.lit(0.0))).alias("threshold"))


def narrowed(found: DataFrame, k: int) -> DataFrame:
    """found(query_id, doc_id, s, might) without the rows whose s and all they might get stay below the k-th best s."""
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("s").desc()))).where(F.col("r") <= k)
    kth = best.where(F.col("r") == k).select(F.col("query_id").alias("__q"), (F.col("s") - MARGIN).alias("kth"))
    left = found.join(kth, F.col("query_id").eqNullSafe(F.col("__q")), "left")
    return stored(left.where(F.col("kth").isNull() | (F.col("s") + F.col("might") >= F.col("kth"))).select("query_id", "doc_id", "s"))


def search(index: InvertedIndex, queries: DataFrame, k: int, work: Observation | None = None) -> DataFrame:
    """queries(query_id, text) -> (query_id, rank, doc_id, score); repeated query tokens count, ties go by doc_id.

    ``work``, if given, observes ``scored``: the (query, document) pairs that got a sum at all.
    """
    check_top_k(k)
    _, avgdl, k1, b = index.figures
    own = impact(F.col("tf"), F.col("dl"), avgdl or 1.0, k1, b)
    asked = stored(weighed(index, queries, k))
    limits = thresholds(index, asked, k)
    query = Window.partitionBy("query_id")
    rising = query.orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
    planned = asked.join(limits, "query_id").withColumns({"upto": F.sum("most").over(rising), "rest": F.sum("most").over(query) - F.col("most"), "least": F.col("threshold") - MARGIN})
    planned = stored(planned.withColumn("essential", F.col("upto") >= F.col("least")).select("query_id", "term", "w", "most", "rest", "least", "essential"))
    others = planned.where("not essential")
    might = planned.groupBy("query_id").agg(F.first("least").alias("least"), F.sum(F.when(~F.col("essential"), F.col("most")).otherwise(0.0)).alias("might"))
    read = index.blocks.select("term", "high", "postings").join(planned.where("essential").drop("most", "essential"), "term").where(F.col("w") * F.col("high") + F.col("rest") >= F.col("least"))
    sums = _postings(read.select("query_id", "w", "postings")).groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * own).alias("s"))
    if work is not None:
        sums = sums.observe(work, F.count(F.lit(1)).alias("scored"))
    open_ = sums.join(might, "query_id").where(F.col("s") + F.col("might") >= F.col("least")).select("query_id", "doc_id", "s", "might")
    if others.isEmpty():
        scored = open_.drop("might")
    else:
        open_ = narrowed(stored(open_), k)
        wanted = open_.select("query_id", "doc_id").join(others.select("query_id", "term", "w"), "query_id")
        lists = _postings(index.blocks.select("term", "postings").join(others.select("term").distinct(), "term", "left_semi"))
        added = lists.join(wanted, ["term", "doc_id"]).select("query_id", "doc_id", (F.col("w") * own).alias("s"))
        scored = open_.unionByName(added).groupBy("query_id", "doc_id").agg(F.sum("s").alias("s"))
    return top(scored.withColumn("score", F.round("s", 6)), k).select("query_id", "rank", "doc_id", "score")
