"""The thin opN_* queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import ann, clustering, collocations, embed_dedup, html_extract, language, line_dedup, mixing, packing, shard, simhash, token_counts, token_files

SHARDS = 40


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op2_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard.assign_shards(_table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("__kept", 256).alias("kept_sha256"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.taken_words(_table(spark, sf_dir, "documents"))
    return taken.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op5_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.95)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.fit(_table(spark, sf_dir, "documents"))
    found = language.identify(language.page_evidence(_table(spark, sf_dir, "pages")), model)
    return found.select(F.col("id").alias("page_id"), F.col("n").alias("n_trigrams"), "lang", "probability", "accepted")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clusters(_table(spark, sf_dir, "embeddings")).drop("measured")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_files(token_files.write_files(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_ann_posting_lists, op2_interleaved_shards, op3_line_dedup, op4_source_mix, op5_binary_packing, op6_embedding_dedup, op7_simhash, op8_token_counts, op9_language_id, op10_html_text, op11_phrase_collocations, op12_centroid_clusters, op13_token_files, pipeline)
    return {f.__name__: f for f in own}


_OP3 = r"""
with lines as (
  select doc_id, n, line, lower_key as k from (
    select doc_id, n, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_key
    from (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as n from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents)))),
firsts as (select k, min(doc_id) as first_id from lines where length(k) >= 10 group by k having count(distinct doc_id) > 1),
marked as (select l.doc_id, l.n, l.line, f.k is not null and l.doc_id <> f.first_id as dropped from lines l left join firsts f on l.k = f.k)
select doc_id, cast(count(*) as bigint) as n_lines, cast(count(*) filter (dropped) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by n) filter (not dropped), '')) as kept_sha256
from marked group by doc_id
"""

_OP6 = """
with recursive v as (
  select vec_id, embedding::double[] as e, sqrt(list_inner_product(embedding::double[], embedding::double[])) as norm from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
low as (select a, min(b) as b from reach group by a)
select e.vec_id, cast(coalesce(n.n, 0) as bigint) as n_links, least(e.vec_id, coalesce(low.b, e.vec_id)) as component_id,
  e.vec_id <= coalesce(low.b, e.vec_id) as kept
from embeddings e left join (select a, count(*) as n from links group by a) n on n.a = e.vec_id left join low on low.a = e.vec_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can express; op1 is approximate, and the others need XXH64, CRC-32, tokenizers or a DOM."""
    return {"op3_line_dedup": _OP3, "op4_source_mix": mixing.ORACLE_SQL, "op6_embedding_dedup": _OP6, "op11_phrase_collocations": collocations.ORACLE_SQL, "op12_centroid_clusters": clustering.ORACLE_SQL}
