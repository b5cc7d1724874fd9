"""A training-data pipeline over documents, one operator a stage; part of subpackage llm.

Stages: language ID (documents without a known language go), line dedup, near-dedup (five-word shingles, Jaccard 0.8
or more; the smallest id of each group stays), mixing sources to target weights, packing into power-of-two sequences.

Every stage knows a row by its id and contents, so rows that repeat an id, or have none, are documents of their own.  The
rows that a stage drops meet the documents in an anti-join, which Spark broadcasts while they are few.

Defined cases: a null or empty text has no language and goes in the first stage; a null id ranks last; null sources
and languages are values of their own; wholly equal rows share their fate until near-dedup makes one of them; other columns
than those of documents are dropped; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import jaccard, language, line_dedup, mixing, packing
from corvane.llm._shared import id_column, materialise
from corvane.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def _contents() -> Column:
    return F.xxhash64(*COLUMNS, *[F.col(c).isNull() for c in COLUMNS])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows in a known language; a row's decision is found again by its contents."""
    rows = _documents(docs).withColumn("__id", _contents())
    found = language.identify(language.document_evidence(rows, "__id"), language.fit(docs))
    rejected = materialise(found.where(~F.col("accepted")).select(F.col("id").alias("__id")).distinct())
    return rows.join(rejected, "__id", "left_anti").drop("__id")


def line_level(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated lines; a document that had text and has none left goes."""
    kept = line_dedup.dedup_lines(_documents(docs))
    return kept.where((F.col("__kept") != "") | (F.col("__n_dropped") == 0)).select("doc_id", F.col("__kept").alias("text"), "lang", "source", F.char_length("__kept").cast("long").alias("n_chars"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents linked by Jaccard >= 0.8, that of the smallest id; op7's SimHash links far fewer.

    A row is known by its id and its contents: rows with a null id, or with one id and different texts, are documents
    of their own (a null id ranks last; among equal ids the smallest hash stays), and wholly equal rows are one.
    """
    rows, key = _documents(docs).withColumns({"__id": id_column("doc_id"), "__hash": _contents()}), ["__id", "__hash"]
    found = materialise(jaccard.near_duplicates(rows.select(F.col("__id").alias("id"), F.col("__hash").alias("hash"), F.col("text").cast("binary").alias("t"))))
    named = [F.col("id").alias("__id"), F.col("hash").alias("__hash")]
    others = materialise(found.where((F.col("id") != F.col("first.id")) | (F.col("hash") != F.col("first.hash"))).select(*named).distinct())
    kept = rows.join(others, key, "left_anti")
    equal = materialise(found.groupBy("id", "hash").count().where("count > 1").select(*named))
    if not equal.isEmpty():
        kept = kept.join(equal, key, "left_anti").unionAll(kept.join(equal, key, "left_semi").dropDuplicates(key))
    return kept.drop(*key)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in blocks of one word, so that small sources meet their targets beside large ones."""
    return mixing.mix(_documents(docs), block=1).select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("line_dedup", line_level), ("simhash_dedup", near_copies), ("source_mix", source_mix), ("packing", sequences)]

#: SQL has neither the trained language model nor XXH64 and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
