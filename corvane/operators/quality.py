"""Corpus validation, manifest and report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.dedup import count_pairs
from corvane.operators.medians import medians

MIN_DOCUMENT, TINY_CHUNK, CHUNK_LIMIT, QA_LIMIT, OVERSIZE = 100, 20, 600, 1000, 1.1
ISSUES = "array<struct<level:string,code:string,message:string>>"
# The location field that chunks of a file type need.
PAGED = {"pdf": "page_start", "pptx": "slide_start", "ppt": "slide_start"}


def _issues(rows: DataFrame, level: str, code: str, message: Column | str, chunk: bool = False) -> DataFrame:
    text = F.lit(message) if isinstance(message, str) else message
    return rows.select(F.lit(level).alias("level"), F.lit(code).alias("code"), F.col("document_id"), (F.col("chunk_id") if chunk else F.lit(None).cast("string")).alias("chunk_id"), text.alias("message"))


def document_issues(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """docs(document_id, extraction_status, extraction_error, char_count, token_count, is_duplicate, duplicate_of,
    duplicate_type, near_duplicates, image_only_units): one row an issue; a failed extraction has no other issues."""
    known = chunks.select("document_id", F.lit(True).alias("__chunks")).distinct()
    ok, failed = F.col("extraction_status") == "ok", F.col("extraction_status") != "ok"

    def issue(where: Column, level: str, code: str | Column, message: Column | str) -> Column:
        code, message = (F.lit(x) if isinstance(x, str) else x for x in (code, message))
        return F.when(where, F.struct(F.lit(level).alias("level"), code.alias("code"), message.alias("message")))

    said = lambda n: F.concat(F.lit("with "), n["document_id"], F.lit(" (jaccard="), n["jaccard"], F.lit(", containment="), n["containment"], F.lit(")"))
    near = F.transform("near_duplicates", lambda n: issue(ok & (F.col("document_id") < n["document_id"]), "info", n["relation"], said(n)))
    parts = F.array(
        issue(failed, "error", "extraction_failed", F.coalesce("extraction_error", F.lit("extraction failed"))),
        issue(ok & (F.coalesce("char_count", F.lit(0)) == 0), "error", "empty_document", "no text extracted"),
        issue(ok & (F.col("char_count") > 0) & (F.col("token_count") < MIN_DOCUMENT), "warning", "tiny_document", F.concat(F.lit("only "), F.col("token_count"), F.lit(" tokens extracted"))),
        issue(ok & (F.col("char_count") > 0) & F.col("__chunks").isNull(), "error", "no_chunks", "document produced no chunks"),
        issue(ok & F.col("is_duplicate"), "info", "duplicate_document", F.concat(F.col("duplicate_type"), F.lit(" duplicate of "), F.col("duplicate_of"))),
        issue(ok & (F.size("image_only_units") > 0), "warning", "image_only_content", F.concat(F.size("image_only_units"), F.lit(" page(s)/slide(s) have images but almost no text: "), F.array_join(F.col("image_only_units").cast("array<string>"), ", "))),
    )
    # all of a document's issues in one pass: each part on its own would work the documents out anew
    every = docs.join(known, "document_id", "left").select("document_id", F.explode(F.concat(parts, F.coalesce(near, F.array().cast(ISSUES)))).alias("i"))
    return every.where("i is not null").select("i.level", "i.code", "document_id", F.lit(None).cast("string").alias("chunk_id"), "i.message")


def chunk_issues(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    known = docs.select(F.col("document_id"), F.col("file_type").alias("__type")).withColumn("__known", F.lit(True))
    rows = chunks.join(known, "document_id", "left")
    again = rows.withColumn("__n", F.row_number().over(Window.partitionBy("chunk_id").orderBy("document_id", F.xxhash64("text")))).where("__n > 1")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    missing = F.lit(None).cast("string")
    for kind, field in PAGED.items():
        missing = F.when((F.col("__type") == kind) & F.col(field).isNull(), F.lit(field)).otherwise(missing)
    limit = F.when(F.col("chunk_type").isin("qa_pair", "problem"), F.lit(QA_LIMIT)).otherwise(F.lit(CHUNK_LIMIT))
    size = F.coalesce("token_count", F.lit(0))
    parts = [
        _issues(again, "error", "duplicate_chunk_id", "chunk id is not unique", True),
        _issues(rows.where(blank("text")), "error", "empty_chunk", "chunk has no text", True),
        _issues(rows.where(F.col("__known").isNull()), "error", "missing_document_id", "chunk has no valid document_id", True),
        _issues(rows.where(blank("filename") | blank("relative_path")), "error", "missing_source_reference", "chunk has no filename/relative_path", True),
        _issues(rows.withColumn("__m", missing).where("__m is not null"), "error", "missing_location", F.concat(F.col("__m"), F.lit(" is missing")), True),
        _issues(rows.where(size > limit * OVERSIZE), "warning", "oversized_chunk", F.concat(F.col("token_count"), F.lit(" tokens (limit "), limit, F.lit(")")), True),
        _issues(rows.where(size < TINY_CHUNK), "warning", "tiny_chunk", F.concat(F.lit("only "), size, F.lit(" tokens")), True),
    ]
    return reduce(DataFrame.unionAll, parts)


def histogram(issues: DataFrame) -> DataFrame:
    return issues.groupBy("level", "code").agg(F.count(F.lit(1)).alias("n"))


def grouped_counts(table: DataFrame, columns: list[str]) -> DataFrame:
    """(grouping, key, n): counts by each column, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("grouping"), F.col(c).cast("string").alias("key")) for c in columns])
    return table.select(F.explode(pairs).alias("x")).groupBy("x.grouping", "x.key").agg(F.count(F.lit(1)).alias("n"))


def token_stats(table: DataFrame, column: str = "token_count") -> DataFrame:
    """min, exact median, mean (1 digit) and max; no row for an empty table."""
    rest = table.agg(F.min(column).alias("min"), F.round(F.avg(column), 1).alias("mean"), F.max(column).alias("max")).where("min is not null")
    return rest.crossJoin(F.broadcast(medians(table, column).select("median"))).select("min", "median", "mean", "max")


def manifest(docs: DataFrame, chunks: DataFrame, pairs: DataFrame, members: DataFrame) -> DataFrame:
    """One row of totals over documents, chunks and near-duplicate pairs of documents (pairs of classes, and their members)."""
    d = docs.agg(F.count(F.lit(1)).alias("documents"), F.count_if("is_duplicate").alias("duplicate_documents"), F.coalesce(F.sum("char_count"), F.lit(0)).alias("characters"))
    c = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("chunk_tokens"))
    return d.crossJoin(c).crossJoin(count_pairs(pairs, members))  # one row each


def report(title: str, totals: dict, tables: dict[str, tuple[list[str], list[tuple]]]) -> str:
    """Markdown of small, already collected tables; pipes in cells are escaped."""
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    out = [f"# {title}", "", *[f"- {k}: {v}" for k, v in totals.items()]]
    for name, (head, rows) in tables.items():
        out += ["", f"## {name}", "", "| " + " | ".join(head) + " |", "|" + " --- |" * len(head)]
        out += ["| " + " | ".join(map(cell, row)) + " |" for row in rows]
    return "\n".join(out) + "\n"
