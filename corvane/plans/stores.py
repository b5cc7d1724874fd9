"""Queries over what the engine stores: versions of a vector table, their digests, builds with observed figures, runs."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from corvane.operators import embedding, inverted, runs
from corvane.plans.queries import BASE, Query, bm25_sql, dense_queries, docs, items, measured, metrics_sql, table, vectors
from corvane.sources import versions
from corvane.sources.shared import fresh_path

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SQL_BM25 = f"with {bm25_sql(10)} select query_id, rank, doc_id, score from bm25"


def query(sql: str):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


# ---------------------------------------------------------------- versions of a vector table
def sql_hash(columns) -> Column:
    """A row hash that SQL can say too: 60 bits of the MD5 of the columns' texts, vectors in units of 2^-40."""
    texts = [F.array_join(F.transform("vector", lambda x: F.floor(x.cast("double") * 2.0**40).cast("string")), ",") if c == "vector" else F.col(c).cast("string") for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *texts)), 1, 15), 16, 10).cast("long")


def changed_index(spark: SparkSession, sf: str) -> str:
    """Two thirds of the vectors, then every fifth vector put in (again, reversed), then every seventh deleted, then compacted."""
    path = fresh_path(spark, "index")
    rows = table(spark, sf, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label", "vec_id")
    keep = lambda where: rows.where(where).drop("vec_id")
    versions.create(keep("vec_id % 3 <> 0"), path, "m", "c1", hash_=sql_hash)
    turned = keep("vec_id % 5 = 0").withColumns({"vector": F.reverse("vector"), "label": F.col("label") + 100})
    versions.upsert(path, turned, "m", "c2", checked_as="c1", hash_=sql_hash)
    versions.delete(path, keep("vec_id % 7 = 0").select("chunk_id"))
    versions.compact(spark, path)
    return path


_LIVE = """e as (select 'v' || vec_id as chunk_id, vec_id, embedding as vector, label from embeddings),
v1 as (select 1 as version, * from e where vec_id % 3 <> 0),
v2 as (select 2 as version, chunk_id, vec_id, list_reverse(vector) as vector, label + 100 as label from e where vec_id % 5 = 0 union all select 2, * exclude (version) from v1 where vec_id % 5 <> 0),
v3 as (select 3 as version, * exclude (version) from v2 where vec_id % 7 <> 0),
live as (select * from v1 union all select * from v2 union all select * from v3 union all select 4, * exclude (version) from v3)"""


@query(f"""with {_LIVE}, n as (select version, count(*) as rows from live group by version)
select version, rows, ['c1', 'c2', 'c2', 'c2'][version] as corpus, [1, 2, 2, 1][version] as segments, case version when 2 then (select count(*) from v1 where vec_id % 5 = 0) when 3 then (select count(*) from v1 where vec_id % 5 = 0) + (select count(*) from v2 where vec_id % 7 = 0) else 0 end as buried,
  (select max(len(vector)) from e) as dim from n""")
def index_versions(spark, sf):
    """What the manifests say, beside what is in the tables."""
    rows = versions.history(spark, changed_index(spark, sf))
    buried = F.aggregate("tombstones", F.lit(0).cast("long"), lambda a, t: a + t["rows"])
    return rows.select("version", "rows", "corpus", F.size("segments").alias("segments"), buried.alias("buried"), "dim")


@query(f"""with {_LIVE}, h as (select version, chunk_id || '|' || array_to_string(list_transform(vector, lambda x: floor(x::double * 1099511627776)::bigint), ',') as t, chunk_id || '|' || label as p from live)
select version, bit_xor(('0x' || substr(md5(t), 1, 15))::bigint) as vectors, bit_xor(('0x' || substr(md5(p), 1, 15))::bigint) as payload from h group by version""")
def index_digest(spark, sf):
    """Digests put together from those of segments and tombstones, none of which was read for it."""
    return versions.history(spark, changed_index(spark, sf)).select("version", "vectors", "payload")


@query(f"""with {_LIVE} select chunk_id, label, round(vector[1]::double, 6) as first from v3""")
def index_rows(spark, sf):
    """The rows of the last version but one: one with two segments and tombstones."""
    return versions.read(spark, changed_index(spark, sf), "m", "c2", version=3).select("chunk_id", "label", F.round(F.col("vector")[0].cast("double"), 6).alias("first"))


# ---------------------------------------------------------------- a build with observed figures
SPEC = embedding.Spec("letters", 26, 1500, document_prefix="text ")


def letters(texts) -> np.ndarray:
    """How often each letter is in each text: a model without weights."""
    return np.array([[t.count(chr(97 + i)) for i in range(26)] for t in texts], float)


@query("""with n as (select len(regexp_extract_all('text ' || text, '[A-Za-z0-9]+')) as n, trim(text) = '' as blank from documents)
select count(*) as rows, count(*) filter (blank or n > 1500) as failures, max(case when blank then 0 else n end) as longest, count(*) filter (n > 512 and not blank) as over_512, count(*) filter (n > 1500 and not blank) as over_max, count(*) filter (not blank and n <= 1500) as indexed from n""")
def index_build_figures(spark, sf):
    """Figures observed while an index of all documents was written; what the index then holds."""
    chunks = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("chunk_id"), "text", "lang")
    manifest, _, figures = embedding.build_index(chunks, fresh_path(spark, "index"), SPEC, lambda t: len(re.findall("[A-Za-z0-9]+", t)), letters, "c")
    row = figures | {"indexed": manifest.rows}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} long" for k in row))


# ---------------------------------------------------------------- runs
_BOTH = f"{BASE}, {metrics_sql('run_a')}, ma as (select * from met), {metrics_sql('run_b').replace('ideal as', 'ideal_b as').replace('join ideal ', 'join ideal_b ').replace('met as', 'mb as')}"


@query(f"with {_BOTH} select query_id, ma.ndcg_10 as whole_ndcg_10, mb.ndcg_10 as half_ndcg_10, ma.recall_5 as whole_recall_5, mb.recall_5 as half_recall_5 from ma join mb using (query_id)")
def recorded_runs(spark, sf):
    """Two runs recorded with their corpus and benchmark, read back side by side."""
    path = fresh_path(spark, "registry")
    corpus, bench = vectors(spark, sf).select("doc_id", "v"), dense_queries(spark, sf).select("query_id", "topic", "difficulty")
    for name, dims in (("whole", None), ("half", 32)):
        runs.record(path, name, {"dims": dims}, corpus, bench, measured(spark, sf, dims).select("query_id", "ndcg_10", "recall_5"))
    return runs.beside(spark, path, ["whole", "half"], ["ndcg_10", "recall_5"])


# ---------------------------------------------------------------- the inverted index
_TERMS = "select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:_[a-z0-9]+)*')) as term from documents"


@query(f"with t as ({_TERMS}), p as (select term, doc_id, count(*) as tf from t group by all) select term, count(*) as df, sum(tf)::bigint as occurrences, max(tf)::int as most from p group by term")
def index_postings(spark, sf):
    """What the blocks of a stored index hold of each term."""
    blocks = inverted.build(docs(spark, sf)).blocks.select("term", F.explode("postings").alias("p"))
    return blocks.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.col("p.tf").cast("long")).alias("occurrences"), F.max("p.tf").alias("most"))



@query(SQL_BM25)
def bm25_indexed_topk(spark, sf):
    """bm25_topk from a stored index, with its bounded search."""
    return inverted.search(inverted.build(docs(spark, sf)), items(spark, sf), 10)
