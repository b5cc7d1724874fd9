"""From files to chunks, relations and issues: the whole ingestion as one set of DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import tokens
from corvane.operators import chunk, clean, dedup, metadata, quality
from corvane.sources import files


def pictured(details: DataFrame, blocks: DataFrame) -> DataFrame:
    """(document_id, image_only_units): slides and pages with pictures and hardly a word below their title."""
    units = details.select("document_id", F.explode("units").alias("u")).select("document_id", F.col("u.unit").alias("number"), "u.images")
    words = blocks.where("type <> 'heading'").groupBy("document_id", F.col("unit").alias("number")).agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(r"\w+|[^\w\s]"), F.lit(0)))).alias("body_tokens"))
    return metadata.image_only_units(units.join(words, ["document_id", "number"], "left").fillna(0, "body_tokens"))


def described(documents: DataFrame, lines: DataFrame, blocks: DataFrame, texts: DataFrame, details: DataFrame) -> DataFrame:
    """documents with their layout, metadata, title, properties, image-only units and extraction status."""
    raw = lines.where("error is null").groupBy("document_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit", "line", "text"))), lambda x: x["text"]), "\n").alias("raw_text"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("unit") <= 1, F.struct("unit", "line", "text")))), lambda x: x["text"]), "\n").alias("first_text"),
        F.when(F.bool_or(F.col("unit_kind") == "slide"), "slides").otherwise("document").alias("layout"),
    )
    code = blocks.groupBy("document_id").agg(F.sum(F.when(F.col("type") == "code", F.char_length("text")).otherwise(0)).cast("long").alias("code_chars"))
    heads = blocks.where("type = 'heading'").select("document_id", F.struct("unit", "block").alias("pos"), "level", "text")
    failed = lines.where("error is not null").groupBy("document_id").agg(F.min("error").alias("extraction_error"))
    rows = documents.join(raw, "document_id", "left").join(code, "document_id", "left").join(failed, "document_id", "left")
    rows = rows.join(texts.select(F.col("doc_id").alias("document_id"), F.col("text").alias("clean_text")), "document_id", "left")
    rows = rows.join(details.select("document_id", "properties", "master_text"), "document_id", "left").join(pictured(details, blocks), "document_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("raw_text", "first_text", "clean_text", "master_text")})
    rows = rows.withColumns({"layout": F.coalesce("layout", F.lit("document")), "code_chars": F.coalesce("code_chars", F.lit(0)), "tokens": F.size(tokens(F.col("clean_text")))})
    kept = metadata.classify(rows).join(metadata.titles(heads), "document_id", "left").drop("raw_text", "first_text", "clean_text", "master_text", "code_chars")
    status = F.when(F.col("extraction_error").isNull(), "ok").otherwise("failed")
    return kept.withColumns({"extraction_status": status, "token_count": F.col("tokens").cast("long"), "image_only_units": F.coalesce("image_only_units", F.array().cast("array<int>"))}).drop("tokens")


def ingest(spark: SparkSession, source: str, target: str | None = None) -> dict[str, DataFrame]:
    """documents with metadata and relations, blocks, chunks, duplicates, pairs, members, issues, manifest and marked Markdown of a folder;
    written as JSON below target if given."""
    if target:
        files.guard_output(source, target)
    found, unsupported, ignored = files.scan(spark, source)
    lines = files.stored(files.extract_lines(found.where(F.col("file_type").isin(*files.LOADERS, *files.TEXTS))))
    details = files.stored(files.extract_details(found))
    blocks = files.stored(clean.clean(lines))
    markdown = clean.markdown(blocks).select(F.col("document_id").alias("doc_id"), F.col("markdown").alias("text"))
    texts = files.stored(markdown.join(found.select(F.col("document_id").alias("doc_id"), "filename"), "doc_id"))
    documents = files.stored(described(found.drop("content"), lines, blocks, texts, details))
    typed = blocks.join(documents.select("document_id", "document_type", "layout"), "document_id")
    own = ["filename", "relative_path", "topic_area", "document_type", "source", "professor", "module", "semester"]
    chunks = files.stored(chunk.located(chunk.chunk(typed)).join(documents.select("document_id", *own), "document_id"))
    sets = dedup.shingle_sets(texts)
    duplicates, pairs, members = (files.stored(x) for x in (dedup.exact_duplicates(texts, "filename"), dedup.near_duplicate_pairs(texts, sets=sets), dedup.shingle_classes(texts, sets=sets)))
    near = dedup.adjacency(pairs, members).select(F.col("doc_id").alias("document_id"), "n_near_duplicates", "near_duplicates")
    related = documents.join(duplicates.withColumnRenamed("doc_id", "document_id"), "document_id", "left").join(near, "document_id", "left")
    related = related.join(texts.select(F.col("doc_id").alias("document_id"), F.char_length("text").cast("long").alias("char_count")), "document_id", "left")
    related = related.withColumns({"is_duplicate": F.col("duplicate_of").isNotNull(), "char_count": F.coalesce("char_count", F.lit(0)), "near_duplicates": F.coalesce("near_duplicates", F.array())})
    related = files.stored(related)
    issues = quality.document_issues(related, chunks).unionByName(quality.chunk_issues(chunks, documents.select("document_id", "file_type")))
    out = {
        "documents": related, "unsupported": unsupported, "ignored": ignored, "blocks": blocks, "chunks": chunks,
        "duplicates": duplicates, "pairs": pairs, "members": members, "duplicate_chunks": dedup.duplicate_chunks(chunks, "chunk_id"),
        "issues": issues, "manifest": quality.manifest(related, chunks, pairs, members), "failures": lines.where("error is not null").select("document_id", "error"), "markdown": clean.marked_markdown(blocks, documents),
    }
    for name, table in out.items() if target else ():
        table.write.mode("overwrite").json(f"{target}/{name}")
    return out
