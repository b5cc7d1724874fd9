"""The engine's queries over the driver's tables, each beside the SQL that must give the same rows.

Derived entities: documents are chunks of their own (corpus order is doc_id); ``benchmark`` items are lexical queries.
Dense queries are the vectors whose vec_id is divisible by 100.  For these, judgments are made by rule: same label and
same parity of the id 2, same label 1, next label 0, everything else is not judged.  Run A is the cosine of all
dimensions, run B that of the first half.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import assessment, chunk, clean, dedup, dialogue, metadata, metrics, quality, retrieval
from corvane.sources.shared import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DEPTH = 20
#: Made judgments in one task.
JUDGMENTS = 1_000_000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"), "label")


def dense_queries(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("conceptual", "mechanism", "code"))), (F.col("query_id") / 100 % 3).cast("int") + 1)
    rows = vectors(spark, sf).where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    return rows.withColumns({"topic": F.concat(F.lit("label"), F.col("label")), "difficulty": F.when(F.col("query_id") % 200 == 0, "easy").otherwise("hard"), "query_type": kind})


def run(spark: SparkSession, sf: str, dims: int | None = None, k: int = DEPTH) -> DataFrame:
    """Written once, as measures read it several times."""
    return stored(retrieval.cosine(vectors(spark, sf).select("doc_id", "v"), dense_queries(spark, sf).select("query_id", "v"), k, dims))


def qrels(spark: SparkSession, sf: str) -> DataFrame:
    asked = dense_queries(spark, sf).select("query_id", "label", ((F.col("label") + 1) % 10).alias("next"))
    rows = vectors(spark, sf).select("doc_id", F.col("label").alias("own"))
    judged = asked.select("query_id", F.explode(F.array(F.struct(F.col("label").alias("own"), F.lit(1).alias("g")), F.struct(F.col("next").alias("own"), F.lit(0).alias("g")))).alias("x")).select("query_id", "x.own", "x.g")
    grade = F.when(F.col("g") == 0, 0).when((F.col("doc_id") - F.col("query_id")) % 2 == 0, 2).otherwise(1)
    # their number grows with the square of the vectors: they stay where their vector is dealt to, about JUDGMENTS a part
    n = rows.groupBy("own").count().join(judged.groupBy("own").agg(F.count(F.lit(1)).alias("m")), "own").agg(F.sum(F.expr("count * m"))).first()[0] or 0
    return rows.repartition(-(-n // JUDGMENTS) or 1, "doc_id").join(F.broadcast(judged), "own").where("doc_id <> query_id").select("query_id", "doc_id", grade.alias("grade"))


# ---------------------------------------------------------------- SQL building blocks
TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+(?:_[a-z0-9]+)*')"
PLAIN = "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))"


def ranked_sql(name: str, score: str, source: str, k: int) -> str:
    return f"{name} as (select query_id, rank, doc_id, score from (select *, cast(row_number() over (partition by query_id order by score desc, doc_id) as int) as rank from (select query_id, doc_id, {score} as score from {source})) where rank <= {k})"


def bm25_sql(k: int, where: str = "true") -> str:
    return f"""d as (select doc_id, {TOKENS} as ts from documents where {where}),
dl as (select doc_id, len(ts) as dl from d), st as (select count(*) as n, avg(dl) as avgdl from dl),
tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(ts) as term from d) group by all),
df as (select term, count(*) as df from tf group by term),
q as (select item_id as query_id, term, count(*) as qtf from (select item_id, unnest({TOKENS}) as term from benchmark) group by all),
s as (select query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) as score
  from q join tf using (term) join df using (term) join dl using (doc_id), st group by all),
{ranked_sql('bm25', 'score', 's', k)}"""


def dense_sql(name: str, k: int, dims: int = 64, where: str = "true", asked: str = "vec_id % 100 = 0") -> str:
    e = f"embedding[1:{dims}]::double[]"
    return ranked_sql(name, "round(list_cosine_similarity(qe, e), 6)", f"(select vec_id as query_id, {e} as qe from embeddings where {asked}) q join (select vec_id as doc_id, {e} as e from embeddings where {where}) x on query_id <> doc_id", k)


ASKED = """dq as (select vec_id as query_id, label, 'label' || label as topic, case when vec_id % 200 = 0 then 'easy' else 'hard' end as difficulty,
  ['conceptual', 'mechanism', 'code'][cast(vec_id // 100 % 3 + 1 as int)] as query_type from embeddings where vec_id % 100 = 0)"""
QRELS = """qrels as (select query_id, vec_id as doc_id, case when e.label <> dq.label then 0 when (vec_id - query_id) % 2 = 0 then 2 else 1 end as grade
  from dq join embeddings e on vec_id <> query_id and (e.label = dq.label or e.label = (dq.label + 1) % 10))"""
BASE = f"{ASKED},\n{QRELS},\n{dense_sql('run_a', DEPTH)},\n{dense_sql('run_b', DEPTH, 32)}"
LABELLED = "lab_{0} as (select r.*, grade, coalesce(grade, 0) > 0 as rel, sum(case when coalesce(grade, 0) > 0 then 1 else 0 end) over (partition by query_id order by rank) as hits from {0} r left join qrels using (query_id, doc_id))"


def metrics_sql(source: str) -> str:
    """CTEs that end in ``met``: every metric of each query at depth 20."""
    value = {
        "recall": "count(*) filter (rel and rank <= {k}) / n_rel", "hit": "cast(max(case when rel and rank <= {k} then 1 end) as double)", "precision": "count(*) filter (rel and rank <= {k}) / {k}",
        "mrr": "1 / min(case when rel and rank <= {k} then rank end)", "ndcg": "sum(case when rel and rank <= {k} then grade / log2(rank + 1) end) / ideal_{k}", "map": "sum(case when rel and rank <= {k} then hits / rank end) / n_rel",
    }
    columns = ", ".join(f"round(coalesce({value[n.split('_')[0]].format(k=n.split('_')[1])}, 0.0), 6) as {n}" for n in metrics.names(DEPTH))
    return f"""{LABELLED.format(source)},
ideal as (select query_id, count(*) as n_rel, {', '.join(f"sum(case when pos <= {k} then grade / log2(pos + 1) end) as ideal_{k}" for k in metrics.NDCG)}
  from (select *, row_number() over (partition by query_id order by grade desc, doc_id) as pos from qrels where grade > 0) group by query_id),
met as (select query_id, {columns} from dq left join lab_{source} using (query_id) left join ideal using (query_id) group by query_id, n_rel, ideal_5, ideal_10)"""


MET_COLUMNS = metrics.names(DEPTH)


# ---------------------------------------------------------------- text and dedup
@query(f"select doc_id, sha256({PLAIN}) as content_hash, substr(sha256(text), 1, 16) as text_hash from documents")
def content_hash(spark, sf):
    return docs(spark, sf).select("doc_id", T.content_hash(F.col("text")).alias("content_hash"), T.text_hash(F.col("text")).alias("text_hash"))


@query("select page_id, trim(substr(trim(regexp_replace(lower(regexp_replace(parts[-1], '(.)\\.[^.]*$', '\\1')), '[^a-z0-9]+', '-', 'g'), '-'), 1, 40), '-') || '-' || substr(sha1(url), 1, 8) as document_id, case when len(parts) > 1 then parts[1] else 'unknown' end as topic_area from (select *, string_split(url, '/') as parts from pages)")
def doc_slug_ids(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.document_id(F.col("url")).alias("document_id"), T.topic_area(F.col("url")).alias("topic_area"))


_DIGEST = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('chunk:' || doc_id))"


@query(f"""select doc_id, concat_ws('-', substr(s, 1, 8), substr(s, 9, 4), '5' || substr(s, 14, 3), substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr(s, 17, 1)), 1) || substr(s, 18, 3), substr(s, 21, 12)) as point_id
from (select doc_id, {_DIGEST} as s from documents)""")
def point_ids(spark, sf):
    return docs(spark, sf).select("doc_id", T.point_id(F.concat(F.lit("chunk:"), F.col("doc_id"))).alias("point_id"))


_EXACT = f"""with f as (select doc_id, text, min(doc_id) over (partition by sha256(text)) as first from documents),
r as (select doc_id, text, min(doc_id) over (partition by sha256({PLAIN})) as first from f where first = doc_id and trim(text) <> '')
select doc_id, first as duplicate_of, 'exact_file' as duplicate_type from f where first <> doc_id
union all select doc_id, first, 'identical_text' from r where first <> doc_id"""


@query(_EXACT)
def exact_duplicates(spark, sf):
    return dedup.exact_duplicates(docs(spark, sf))


@query(f"select doc_id, first as duplicate_of from (select doc_id, min(doc_id) over (partition by sha256({PLAIN})) as first from documents) where first <> doc_id")
def dup_first_occurrence(spark, sf):
    return dedup.duplicate_chunks(docs(spark, sf))


_GRAMS = f"""w as (select doc_id, string_split(p, ' ') as w from (select doc_id, {PLAIN} as p from documents) where p <> ''),
g as (select doc_id, list_sort(list_distinct(list_transform(range(greatest(len(w) - 5, 0) + 1), lambda i: array_to_string(w[i + 1:i + 5], ' ')))) as s from w)"""


@query(f"with {_GRAMS} select d.doc_id, coalesce(len(s), 0)::int as shingles from documents d left join g using (doc_id)")
def shingle_counts(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(T.shingles(F.col("text"))).alias("shingles"))


_PAIRS = f"""{_GRAMS}, c as (select min(doc_id) as id, s, len(s) as n from g group by s), x as (select id, n, unnest(s) as t from c),
i as (select a.id as a, b.id as b, a.n as na, b.n as nb, count(*) as i from x a join x b on a.t = b.t and a.id < b.id group by all),
pairs as (select a, b, case when i / (na + nb - i) >= 0.8 then 'near_duplicate' else 'overlap' end as relation, round(i / (na + nb - i), 3) as jaccard, round(i / least(na, nb), 3) as containment
  from i where i / (na + nb - i) >= 0.8 or i / least(na, nb) >= 0.5)"""


@query(f"with {_PAIRS} select * from pairs")
def near_duplicate_pairs(spark, sf):
    return dedup.near_duplicate_pairs(docs(spark, sf))


@query(f"with {_GRAMS}, c as (select min(doc_id) as class_id, s from g group by s) select doc_id, class_id from g join c using (s)")
def shingle_classes(spark, sf):
    return dedup.shingle_classes(docs(spark, sf))


# every pair of documents by definition, copies included
_DOC_PAIRS = f"""{_GRAMS}, x as (select doc_id, len(s) as n, unnest(s) as t from g), i as (select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as i from x a join x b on a.t = b.t and a.doc_id < b.doc_id group by all),
pairs as (select a, b, case when i / (na + nb - i) >= 0.8 then 'near_duplicate' else 'overlap' end as relation from i where i / (na + nb - i) >= 0.8 or i / least(na, nb) >= 0.5),
ways as (select a as doc_id, b as other, relation from pairs union all select b, a, relation from pairs), c as (select min(doc_id) as class_id, s from g group by s), m as (select doc_id, class_id from g join c using (s))"""


@query(f"""with {_DOC_PAIRS}, named as (select w.doc_id, m.class_id as other, w.relation, count(*) as n from ways w join m on m.doc_id = w.other group by all)
select doc_id, class_id, n_near_duplicates, neighbours from (select doc_id, cast(sum(n) as bigint) as n_near_duplicates, string_agg(other || ':' || relation || ':' || n, ',' order by other) as neighbours from named group by doc_id) join m using (doc_id)""")
def near_dup_adjacency(spark, sf):
    """Each document's near duplicates, as classes with the number of documents in each; twins have each other."""
    found = dedup.near_adjacency(docs(spark, sf))
    return found.select("doc_id", "class_id", "n_near_duplicates", F.array_join(F.transform("near_duplicates", lambda n: F.concat_ws(":", n["document_id"], n["relation"], n["documents"])), ",").alias("neighbours"))


# ---------------------------------------------------------------- retrieval
@query(f"with {bm25_sql(10)} select query_id, rank, doc_id, score from bm25")
def bm25_topk(spark, sf):
    return retrieval.bm25(docs(spark, sf), items(spark, sf), 10)


@query(f"""with {bm25_sql(10, "lang in ('en', 'fr')")} select query_id, rank, doc_id, score from bm25""")
def bm25_filtered_topk(spark, sf):
    return retrieval.bm25(retrieval.filter_rows(table(spark, sf, "documents"), {"lang": ["en", "fr"]}, ("lang",)), items(spark, sf), 10)


@query(f"with d as (select doc_id, {TOKENS} as ts from documents) select count(*) as documents, (select count(distinct t) from (select unnest(ts) as t from d)) as vocabulary, round(avg(len(ts)), 4) as avgdl from d")
def bm25_index_stats(spark, sf):
    return retrieval.index_stats(docs(spark, sf))


@query(f"with t as (select distinct doc_id, unnest({TOKENS}) as term from documents) select term, count(*) as df, round(ln(1 + ((select count(*) from documents) - count(*) + 0.5) / (count(*) + 0.5)), 6) as idf from t group by term")
def term_df_idf(spark, sf):
    return retrieval.document_frequencies(docs(spark, sf)).withColumn("idf", F.round("idf", 6))


@query(f"select doc_id, cast(len({TOKENS}) as bigint) as dl from documents")
def doc_lengths(spark, sf):
    return retrieval.lengths(docs(spark, sf))


@query(f"with {dense_sql('r', 10)} select * from r")
def dense_topk(spark, sf):
    return run(spark, sf, k=10)


@query(f"with {dense_sql('r', 10, where='label in (1, 2, 3)')} select * from r")
def dense_filtered_topk(spark, sf):
    kept = vectors(spark, sf).where(F.col("label").isin(1, 2, 3)).select("doc_id", "v")
    return retrieval.cosine(kept, dense_queries(spark, sf).select("query_id", "v"), 10)


@query("select vec_id, round(sqrt(list_inner_product(embedding::double[], embedding::double[])), 6) as norm from embeddings")
def vector_norms(spark, sf):
    return retrieval.norms(table(spark, sf, "embeddings"))


_FUSED = f"""with {bm25_sql(50)}, {dense_sql('dense', 50, asked='vec_id in (select item_id from benchmark)')},
f as (select query_id, doc_id, round(sum(1.0::double / (60 + rank)), 6) as score, max(case when sys = 'bm25' then rank end) as bm25_rank, max(case when sys = 'dense' then rank end) as dense_rank
  from (select *, 'bm25' as sys from bm25 union all select *, 'dense' from dense) group by all)
select query_id, rank, doc_id, score, bm25_rank, dense_rank from (select *, cast(row_number() over (partition by query_id order by score desc, doc_id) as int) as rank from f) where rank <= 10"""


@query(_FUSED)
def hybrid_rrf_topk(spark, sf):
    """An exercise in fusion: item i is paired with vector i, and documents with vectors of their id."""
    v = vectors(spark, sf)
    asked = v.join(items(spark, sf).select(F.col("query_id").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("query_id"), "v")
    return retrieval.rrf({"bm25": retrieval.bm25(docs(spark, sf), items(spark, sf), 50), "dense": retrieval.cosine(v.select("doc_id", "v"), asked, 50)}, 10)


@query("select d.doc_id, lang, source, n_chars, quality, toxic from documents d left join labels l using (doc_id)")
def payload_join(spark, sf):
    return retrieval.payload(table(spark, sf, "documents"), table(spark, sf, "labels"), {"quality": "quality", "toxic": "toxic"}, "doc_id").select("doc_id", "lang", "source", "n_chars", "quality", "toxic")


@query("select doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def orphan_docs(spark, sf):
    return retrieval.orphans(docs(spark, sf), table(spark, sf, "labels"), "doc_id").select("doc_id")


@query("select doc_id, doc_id % 5 <> 0 as text_verified from documents")
def text_verified(spark, sf):
    """Every fifth text was changed after its hash was stored."""
    stored = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" then"))).otherwise(F.col("text"))
    hashed = docs(spark, sf).withColumn("text_hash", T.text_hash(stored))
    return hashed.select("doc_id", retrieval.verified(hashed).alias("text_verified"))


# ---------------------------------------------------------------- evaluation
def measured(spark, sf, dims=None):
    return metrics.per_query(run(spark, sf, dims), qrels(spark, sf), dense_queries(spark, sf), DEPTH)


@query(f"with {BASE}, {metrics_sql('run_a')} select * from met")
def metrics_per_query(spark, sf):
    return measured(spark, sf)


_MEANS = ", ".join(f"round(avg({c}), 4) as {c}" for c in MET_COLUMNS)


@query(f"""with {BASE}, {metrics_sql('run_a')}, j as (select * from met join dq using (query_id))
select 'overall' as grouping, null::varchar as value, count(*) as queries, {_MEANS} from j
union all select 'topic', topic, count(*), {_MEANS} from j group by topic
union all select 'difficulty', difficulty, count(*), {_MEANS} from j group by difficulty
union all select 'query_type', query_type, count(*), {_MEANS} from j group by query_type""")
def metrics_by_group(spark, sf):
    return metrics.grouped(measured(spark, sf), dense_queries(spark, sf), ["topic", "difficulty", "query_type"], MET_COLUMNS)


@query(f"""with {BASE}, {LABELLED.format('run_a')}, c as (select unnest([5, 10, 20]) as cut)
select cut, cast(count(*) filter (grade is null) as bigint) as unjudged, count(*) as retrieved, round(count(*) filter (grade is null) / count(*), 4) as share, round(count(*) filter (grade is null) / (select count(*) from dq), 4) as mean
from c join lab_run_a on rank <= cut group by cut""")
def judgment_coverage(spark, sf):
    return metrics.coverage(run(spark, sf), qrels(spark, sf), dense_queries(spark, sf))


@query(f"""with {BASE}, {LABELLED.format('run_a')},
run_c as (select query_id, doc_id, row_number() over (partition by query_id order by rank) as rank from lab_run_a where grade is not null), {metrics_sql('run_c')} select * from met""")
def condensed_metrics(spark, sf):
    asked = dense_queries(spark, sf)
    return metrics.per_query(metrics.condensed(run(spark, sf), qrels(spark, sf)), qrels(spark, sf), asked, DEPTH)


@query(f"""with {BASE}, {metrics_sql('run_a')}, ma as (select * from met), {metrics_sql('run_b').replace('ideal as', 'ideal_b as').replace('join ideal ', 'join ideal_b ').replace('met as', 'met_b as')},
x as ({' union all '.join(f"select '{c}' as metric, avg(a.{c}) as a, avg(b.{c}) as b from ma a join met_b b using (query_id)" for c in MET_COLUMNS)})
select metric, round(a, 4) as mean_a, round(b, 4) as mean_b, round(b - a, 4) as delta from x""")
def run_delta(spark, sf):
    return metrics.compare(measured(spark, sf), measured(spark, sf, 32), MET_COLUMNS)


@query(f"""with {BASE}, o as (select query_id, doc_id, a.rank as ra, b.rank as rb from (select * from run_a where rank <= 10) a full join (select * from run_b where rank <= 10) b using (query_id, doc_id)),
r as (select o.*, coalesce(grade, 0) > 0 as rel from o left join qrels using (query_id, doc_id))
select query_id, count(*) filter (ra is not null and rb is not null) as common, count(*) filter (rel and ra is not null and rb is not null) as rel_both, count(*) filter (rel and rb is null) as rel_a_only, count(*) filter (rel and ra is null) as rel_b_only from r group by query_id""")
def run_overlap(spark, sf):
    return metrics.overlap(run(spark, sf), run(spark, sf, 32), qrels(spark, sf), 10)


@query(f"with {BASE}, {LABELLED.format('run_a')} select query_id, min(rank) filter (grade > 0) as first_rank from dq left join lab_run_a using (query_id) group by query_id")
def first_relevant_rank(spark, sf):
    return metrics.first_relevant(run(spark, sf), qrels(spark, sf), dense_queries(spark, sf))


@query(f"with {BASE} select query_id from run_a r join embeddings e on e.vec_id = r.doc_id where rank <= 10 and label in (0, 1) group by query_id having count(distinct label) = 2")
def superset_queries(spark, sf):
    labelled = run(spark, sf).join(vectors(spark, sf).select("doc_id", "label"), "doc_id")
    return metrics.containing_all(labelled, spark.createDataFrame([(0,), (1,)], "label int"), "label")


@query(f"with {BASE}, {LABELLED.format('run_a')} select 'label' || label as category, count(*) filter (grade > 0) as relevant, count(*) filter (grade = 0) as zero, count(*) filter (grade is null) as unjudged from lab_run_a l join embeddings e on e.vec_id = l.doc_id where rank <= 10 group by label")
def category_counts(spark, sf):
    rows = run(spark, sf).join(vectors(spark, sf).select("doc_id", "label"), "doc_id")
    return metrics.categories(rows, qrels(spark, sf), F.concat(F.lit("label"), F.col("label")))


@query(f"""with {BASE} select a.query_id, a.doc_id as a, b.doc_id as b from run_a a join run_a b on a.query_id = b.query_id and a.rank < b.rank and b.rank <= 10
join embeddings x on x.vec_id = a.doc_id join embeddings y on y.vec_id = b.doc_id and x.label = y.label""")
def result_duplicate_pairs(spark, sf):
    """Labels stand for classes of copies."""
    return metrics.duplicate_pairs(run(spark, sf), vectors(spark, sf).select("doc_id", F.col("label").alias("class_id")), 10)


@query(f"""with {BASE}, {LABELLED.format('run_a')}, w as (select l.query_id, l.doc_id, l.rank, e.label, l.doc_id // 10 as d, l.doc_id % 10 as c from lab_run_a l join embeddings e on e.vec_id = l.doc_id where rank <= 5 and not rel),
nb as (select distinct query_id, doc_id // 10 as d, doc_id % 10 as c from qrels where grade > 0),
t as (select w.*, exists (select 1 from nb where nb.query_id = w.query_id and nb.d = w.d and abs(nb.c - w.c) = 1) as near, w.label = dq.label as topical from w join dq using (query_id))
select query_id, doc_id, rank, array_to_string(list_filter([case when near then 'neighboring_chunk' end, case when topical then 'topically_related_unjudged' end], lambda x: x is not null), ',') as tags from t""")
def error_tags(spark, sf):
    """Ten ids in a row stand for one document's chunks, labels for subtopics."""
    meta = vectors(spark, sf).select("doc_id", F.expr("doc_id div 10").alias("document_id"), (F.col("doc_id") % 10).alias("chunk_index"), F.lit(None).cast("string").alias("section"), F.array("label").alias("subtopics"), F.lit(None).cast("int").alias("class_id"), F.lit(False).alias("image_only"))
    asked = dense_queries(spark, sf).select("query_id", F.array("label").alias("subtopics"))
    return metrics.error_tags(run(spark, sf), qrels(spark, sf), meta, asked).withColumn("tags", F.array_join("tags", ","))


@query(f"""with {BASE}, {metrics_sql('run_a')}, asked as (select query_id, case query_id // 100 % 4 when 0 then 'EN' when 1 then 'ZQX' when 2 then 'join_all' end as ident from dq),
f as (select query_id, hit_5 = 0 as five, hit_10 = 0 as ten, ident is not null and not exists (select 1 from run_a r join documents d using (doc_id) where r.query_id = asked.query_id and rank <= 5 and contains(lower(text), lower(ident))) as miss,
  exists (select 1 from qrels j where j.query_id = asked.query_id and grade > 0 and doc_id % 50 = 7) as picture from met join asked using (query_id))
select query_id, array_to_string(list_filter([case when five then 'no_relevant_in_top5' end, case when five and miss then 'exact_terminology_miss' end, case when five and picture then 'relevant_near_image_only_unit' end,
  case when five and not miss and not picture then 'semantic_mismatch' end, case when ten then 'no_relevant_in_top10' end], lambda x: x is not null), ',') as categories from f where five or ten""")
def failure_categories(spark, sf):
    """Queries that name a term met often, one never met, an identifier, and none."""
    texts = docs(spark, sf)
    said = F.array(*map(F.lit, ("EN on a CPU", "ZQX", "what is join_all", "of the OS")))
    asked = dense_queries(spark, sf).select("query_id", F.element_at(said, (F.expr("query_id div 100") % 4 + 1).cast("int")).alias("text"))
    none = vectors(spark, sf).where("doc_id % 50 = 7").select("doc_id")
    return metrics.failures(measured(spark, sf), run(spark, sf), asked, texts, qrels(spark, sf), none).withColumn("categories", F.array_join("categories", ","))


@query(f"with {ASKED}, {dense_sql('deep', 40)} select deep.* from deep join dq using (query_id) where difficulty = 'hard' and rank > {DEPTH}")
def deep_pool_results(spark, sf):
    hard = dense_queries(spark, sf).where("difficulty = 'hard'").select("query_id", "v")
    return retrieval.cosine(vectors(spark, sf).select("doc_id", "v"), hard, 2 * DEPTH).where(F.col("rank") > DEPTH)


@query(f"with {ASKED}, {QRELS} select cast(query_id as varchar) as query_id, 'no relevant chunks' as problem from dq where query_id not in (select query_id from qrels where grade > 0)")
def benchmark_problems(spark, sf):
    asked = dense_queries(spark, sf).withColumn("query", F.col("topic"))
    return metrics.validate_benchmark(asked, qrels(spark, sf), vectors(spark, sf), {"difficulty": ("easy", "medium", "hard"), "query_type": ("conceptual", "mechanism", "code")})


# ---------------------------------------------------------------- manifest, validation, metadata
def described(spark, sf):
    """documents as the validator wants them; every 97th counts as a failed extraction."""
    d = table(spark, sf, "documents")
    dup = dedup.exact_duplicates(d).withColumn("is_duplicate", F.lit(True))
    # counted before the join, so that no text is shuffled
    counts = d.select("doc_id", F.char_length("text").cast("long").alias("char_count"), F.size(T.tokens(F.col("text"))).cast("long").alias("token_count"))
    rows = counts.join(dup, "doc_id", "left").withColumns({"document_id": F.concat(F.lit("d"), F.col("doc_id")), "is_duplicate": F.coalesce("is_duplicate", F.lit(False)), "extraction_status": F.when(F.col("doc_id") % 97 == 0, "failed").otherwise("ok"), "extraction_error": F.lit(None).cast("string")})
    near = "array<struct<document_id:string,relation:string,jaccard:double,containment:double>>"
    other = F.struct(F.concat(F.lit("d"), F.col("doc_id") + 1), F.lit("near_duplicate"), F.lit(0.85), F.lit(0.9))
    return rows.withColumns({
        "duplicate_of": F.concat(F.lit("d"), F.col("duplicate_of")), "near_duplicates": F.when(F.col("doc_id") % 31 == 0, F.array(other)).otherwise(F.array()).cast(near),
        "image_only_units": F.when(F.col("doc_id") % 29 == 0, F.array(F.lit(2), F.lit(5))).otherwise(F.array()).cast("array<int>"),
    })


_DESCRIBED = f"dup as ({_EXACT}), t as (select d.*, 'd' || doc_id as document_id, len({TOKENS}) as tokens, length(text) as chars, dup.duplicate_of, duplicate_type from documents d left join dup using (doc_id)), ok as (select * from t where doc_id % 97 <> 0)"
_ISSUES = f"""{_DESCRIBED}, issues as (select 'error' as level, 'extraction_failed' as code, document_id, 'extraction failed' as message from t where doc_id % 97 = 0
union all select 'error', 'empty_document', document_id, 'no text extracted' from ok where chars = 0
union all select 'warning', 'tiny_document', document_id, 'only ' || tokens || ' tokens extracted' from ok where chars > 0 and tokens < 100
union all select 'info', 'duplicate_document', document_id, duplicate_type || ' duplicate of d' || duplicate_of from ok where duplicate_of is not null
union all select 'error', 'no_chunks', document_id, 'document produced no chunks' from ok where chars > 0 and doc_id % 37 = 0
union all select 'info', 'near_duplicate', document_id, 'with d' || doc_id + 1 || ' (jaccard=0.85, containment=0.9)' from ok where doc_id % 31 = 0 and document_id < 'd' || doc_id + 1
union all select 'warning', 'image_only_content', document_id, '2 page(s)/slide(s) have images but almost no text: 2, 5' from ok where doc_id % 29 = 0)"""


def issues(spark, sf):
    chunks = table(spark, sf, "documents").where("doc_id % 37 <> 0").select(F.concat(F.lit("d"), "doc_id").alias("document_id"))
    return quality.document_issues(described(spark, sf), chunks)


@query(f"with {_ISSUES} select * from issues")
def validation_issues(spark, sf):
    return issues(spark, sf).drop("chunk_id")


@query(f"with {_ISSUES} select level, code, count(*) as n from issues group by all")
def issue_histogram(spark, sf):
    return quality.histogram(issues(spark, sf))


@query("select grouping, key, count(*) as n from (select unnest(['lang', 'source', 'size']) as grouping, unnest([lang, source, case when n_chars < 500 then 'short' else 'long' end]) as key from documents) group by all")
def grouped_counts(spark, sf):
    rows = table(spark, sf, "documents").withColumn("size", F.when(F.col("n_chars") < 500, "short").otherwise("long"))
    return quality.grouped_counts(rows, ["lang", "source", "size"])


@query(f"select min(n) as min, median(n) as median, round(avg(n), 1) as mean, max(n) as max from (select cast(len({TOKENS}) as bigint) as n from documents)")
def token_stats(spark, sf):
    return quality.token_stats(retrieval.lengths(docs(spark, sf)), "dl")


@query(f"""with {_DOC_PAIRS}, dup as ({_EXACT}) select (select count(*) from documents) as documents, (select count(*) from dup) as duplicate_documents, (select cast(sum(length(text)) as bigint) from documents) as characters,
(select count(*) from documents) as chunks, (select cast(sum(len({TOKENS})) as bigint) from documents) as chunk_tokens, (select count(*) from pairs) as near_duplicate_pairs""")
def corpus_manifest(spark, sf):
    # written once: totals and chunks are both counted on it
    d, texts = stored(described(spark, sf).select("is_duplicate", "char_count", "token_count")), docs(spark, sf)
    sets = dedup.shingle_sets(texts)
    return quality.manifest(d, d.select("token_count"), dedup.pair_counts(texts, sets=sets), dedup.shingle_classes(texts, sets=sets))


_FAULTY = """chunks as (select d.*, len(regexp_extract_all(text, '\\S+')) as tokens, case when doc_id % 11 = 0 then 'c0' else 'c' || doc_id end as chunk_id, case when doc_id % 13 = 0 then 'none' else 'd' || doc_id end as document_id,
  case when doc_id % 17 = 0 then ' ' else 'f' end as filename, case doc_id % 3 when 0 then 'pdf' when 1 then 'pptx' else 'txt' end as kind, case when doc_id % 2 = 0 then doc_id end as place, case when doc_id % 19 = 0 then null else text end as own, if(doc_id % 4 = 0, 'qa_pair', 'section') as chunk_type from documents d),
c as (select *, case when doc_id % 13 <> 0 then kind end as known, if(chunk_type = 'qa_pair', 1000, 600) as most from chunks)"""


@query(f"""with {_FAULTY} select * from (
select 'error' as level, 'duplicate_chunk_id' as code, chunk_id, cast(count(*) - 1 as bigint) as n from c group by chunk_id having count(*) > 1
union all select 'error', 'empty_chunk', chunk_id, count(*) from c where own is null or trim(own) = '' group by chunk_id
union all select 'error', 'missing_document_id', chunk_id, count(*) from c where doc_id % 13 = 0 group by chunk_id
union all select 'error', 'missing_source_reference', chunk_id, count(*) from c where filename = ' ' group by chunk_id
union all select 'error', 'missing_location', chunk_id, count(*) from c where known in ('pdf', 'pptx') and place is null group by chunk_id
union all select 'warning', 'oversized_chunk', chunk_id, count(*) from c where tokens > most * {quality.OVERSIZE} group by chunk_id
union all select 'warning', 'tiny_chunk', chunk_id, count(*) from c where tokens < {quality.TINY_CHUNK} group by chunk_id)""")
def chunk_issues(spark, sf):
    """Documents as chunks of files that lack this and that, so that every check finds something."""
    i = F.col("doc_id")
    rows = docs(spark, sf).withColumns({
        "token_count": F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))), "chunk_id": F.when(i % 11 == 0, "c0").otherwise(F.concat(F.lit("c"), i)), "document_id": F.when(i % 13 == 0, "none").otherwise(F.concat(F.lit("d"), i)),
        "filename": F.when(i % 17 == 0, " ").otherwise("f"), "relative_path": F.lit("a/f"), "chunk_type": F.when(i % 4 == 0, "qa_pair").otherwise("section"), "page_start": F.when(i % 2 == 0, i), "slide_start": F.when(i % 2 == 0, i), "text": F.when(i % 19 != 0, F.col("text")),
    })
    files = docs(spark, sf).select(F.concat(F.lit("d"), i).alias("document_id"), F.element_at(F.array(*map(F.lit, ("pdf", "pptx", "txt"))), (i % 3 + 1).cast("int")).alias("file_type"))
    return quality.chunk_issues(rows, files).groupBy("level", "code", "chunk_id").agg(F.count(F.lit(1)).alias("n"))


# words that the synthetic texts have; the taxonomy itself is a parameter
WORDS = {"articles": "the|der|die|das|les|las", "conjunctions": "and|und|et", "prepositions": "(of|to|von) "}


@query("select doc_id, topic, n from (select doc_id, " + ", ".join(f"len(regexp_extract_all(text, '(?i){p}')) as {k}" for k, p in WORDS.items()) + " from documents) unpivot (n for topic in (" + ", ".join(WORDS) + ")) where n > 0")
def topic_counts(spark, sf):
    counts = metadata.topic_counts(F.col("text"), WORDS, {})
    return docs(spark, sf).select("doc_id", F.explode(counts).alias("topic", "n")).withColumn("n", F.col("n").cast("long"))


@query(f"select doc_id, array_to_string(list_filter([{', '.join(f'''case when c{i} >= 3 and c{i} * 1000 / greatest(tokens, 1) >= 60 then '{k}' end''' for i, k in enumerate(WORDS))}], lambda x: x is not null), ',') as topics from (select doc_id, len({TOKENS}) as tokens, " + ", ".join(f"len(regexp_extract_all(text, '(?i){p}')) as c{i}" for i, p in enumerate(WORDS.values())) + " from documents)")
def doc_topics(spark, sf):
    counts = metadata.topic_counts(F.col("text"), WORDS, {})
    return docs(spark, sf).select("doc_id", F.array_join(metadata.document_topics(counts, F.size(T.tokens(F.col("text"))), 3, 60), ",").alias("topics"))


@query("select doc_id, array_to_string(list_filter([case when regexp_matches(text, '(?i) in the ') then 'in' end, case when regexp_matches(text, '(?i) de la ') and regexp_matches(text, '(?i) que ') then 'romance' end], lambda x: x is not null), ',') as kinds from documents")
def problem_types(spark, sf):
    kinds = metadata.problem_types(F.col("text"), {"in": [" in the "], "romance": [" de la ", " que "]})
    return docs(spark, sf).select("doc_id", F.array_join(kinds, ",").alias("kinds"))


@query("with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents) select trim(regexp_replace(lower(line), '[0-9]+', '#', 'g')) as key, count(distinct doc_id) as documents from l where line <> '' group by 1 having count(distinct doc_id) >= 3")
def repeated_lines(spark, sf):
    lines = docs(spark, sf).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    key = F.trim(F.regexp_replace(F.lower("line"), "[0-9]+", "#"))
    return lines.select("doc_id", key.alias("key")).groupBy("key").agg(F.count_distinct("doc_id").alias("documents")).where("documents >= 3")


@query("select doc_id as document_id, word, count(*) as n from (select doc_id, unnest(regexp_extract_all(lower(text), '[A-Za-z]+(?:-[A-Za-z]+)*')) as word from documents) group by all")
def word_vocabulary(spark, sf):
    return clean.vocabulary(docs(spark, sf).withColumnRenamed("doc_id", "document_id"))


@query(r"select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, cast(length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) as int) as chars from pages")
def page_title_text(spark, sf):
    bare = T.squeeze(F.regexp_replace("html", "<[^>]*>", " "))
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.char_length(bare).alias("chars"))


def lines_of(spark, sf):
    """Documents as extracted lines: the first line of every seventh document is a heading."""
    rows = docs(spark, sf).select(F.concat(F.lit("d"), F.col("doc_id")).alias("document_id"), "doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    head = (F.col("line") == 0) & (F.col("doc_id") % 7 == 0)
    return rows.select("document_id", F.lit(0).alias("unit"), F.lit("section").alias("unit_kind"), "line", "text", F.when(head, "heading").otherwise("text").alias("kind"), F.when(head, 1).otherwise(0).alias("level"), F.lit("para").alias("para_break"), *[F.lit(None).cast("double").alias(c) for c in ("top", "bottom", "x0", "cw")], F.lit(None).cast("string").alias("error"))


@query()
def chunk_documents(spark, sf):
    return chunk.chunk(clean.clean(lines_of(spark, sf))).drop("section_path")


# ---------------------------------------------------------------- dialogue and assessment
def turns(spark, sf):
    """Assistant turns by position in the conversation."""
    kinds = F.element_at(F.array(*map(F.lit, ("DIAGNOSE", "EXPLAIN", "CHECK", "WRAP_UP"))), (F.col("turn") / 2 % 4).cast("int") + 1)
    return table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", kinds.alias("kind"), F.col("text").alias("message"), F.lit(3).alias("n_sources"))


_CHECKS = r"""checks as (select conv_id, turn, kind, cast(case when trim(m, e' \t\n\r') = '' then 0 else len(regexp_split_to_array(trim(m, e' \t\n\r'), '[ \t\n\r]+')) end as bigint) as words,
  regexp_matches(m, '(?i)\b(the (course )?context|instructions|the conversation)\b') as leak, len(list_filter(c, lambda n: try_cast(n as int) is null or try_cast(n as int) not between 1 and 3)) = 0 as citations_valid,
  case when kind in ('DIAGNOSE', 'CHECK') then q = 1 end as one_question, case when kind = 'WRAP_UP' then q = 0 end as no_question, case when kind in ('EXPLAIN', 'WRAP_UP', 'ANSWER') then len(c) > 0 end as cites_source
  from (select conv_id, turn, ['DIAGNOSE', 'EXPLAIN', 'CHECK', 'WRAP_UP'][cast(turn // 2 % 4 + 1 as int)] as kind, coalesce(text, '') as m, regexp_extract_all(coalesce(text, ''), '\[S(\d+)\]', 1) as c, length(coalesce(text, '')) - length(replace(coalesce(text, ''), '?', '')) as q from conversations where role = 'assistant'))"""


@query(f"with {_CHECKS} select conv_id, turn, kind, words, words <= 120 as within_120_words, leak, citations_valid, one_question, no_question, cites_source from checks")
def turn_checks(spark, sf):
    return dialogue.turn_checks(turns(spark, sf)).drop("message", "n_sources", "ends_with_question")


_RATES = ("within_120_words", "leak", "citations_valid", "one_question", "no_question", "cites_source")


@query(f"with {_CHECKS}, x as ({' union all '.join(f'''select '{c}' as check, {'words <= 120' if c.startswith('within') else c} as v from checks''' for c in _RATES)}) select check, count(*) filter (v) as passed, count(v) as applicable, round(count(*) filter (v) / count(v), 4) as share from x where v is not null group by check".replace("check,", '"check",').replace("as check", 'as "check"').replace("group by check", 'group by "check"'))
def turn_rate_summary(spark, sf):
    return dialogue.rates(dialogue.turn_checks(turns(spark, sf)), _RATES)


# openings in turn: what asks, what asks at length, what demands the answer, what is none of these
OPENINGS = ("", "Why ", "ok, but can you ", "explain ", "Just tell me the answer ", "matlab kya ", "skip ", "I think that ")
_TURNS = f"(select conv_id, turn, trim({list(OPENINGS)}[cast((conv_id + turn) % {len(OPENINGS)} + 1 as int)] || substr(coalesce(text, ''), 1, 10 * (turn % 12))) as t from conversations)"
_WORDS = r"case when trim(t, e' \t\n\r') = '' then 0 else len(regexp_split_to_array(trim(t, e' \t\n\r'), '[ \t\n\r]+')) end"
_LEAD = dialogue.LEAD.replace("'", "''")


@query(f"""select conv_id, turn, case when t = '' or regexp_matches(t, '(?i){dialogue.WANTS_ANSWER}') then false when regexp_matches(t, '(?i){dialogue.HINGLISH_ASK}') then true
else (regexp_matches(t, '(?i){_LEAD}{dialogue.ASK_START.replace("'", "''")}') or regexp_matches(t, '(?i){_LEAD}{dialogue.ASK_VERB}')) and ({_WORDS} <= 12 or contains(t, '?')) end as is_new_question from {_TURNS}""")
def new_questions(spark, sf):
    opening = F.element_at(F.array(*map(F.lit, OPENINGS)), ((F.col("conv_id") + F.col("turn")) % len(OPENINGS) + 1).cast("int"))
    text = F.concat(opening, F.substring(F.coalesce("text", F.lit("")), F.lit(1), (10 * (F.col("turn") % 12)).cast("int")))
    return table(spark, sf, "conversations").select("conv_id", "turn", dialogue.is_new_question(text).alias("is_new_question"))


_CITED = f"(select conv_id, turn, text || ' [S' || turn + 1 || ', S9] [Wikipedia] . x[S9, S1] y [S2,3] [S7]!' as t from conversations)"


@query(rf"""with p as (select conv_id, turn, string_split(coalesce(t, ''), ']') as ps from {_CITED}),
q as (select conv_id, turn, array_to_string(list_transform(ps, lambda p, i: case when i = len(ps) then p when not regexp_matches(p, '\[S\d+(\s*,\s*S?\d+)*$') then p || ']'
  else regexp_replace(p, '\[S\d+(\s*,\s*S?\d+)*$', '') || array_to_string(list_transform(regexp_extract_all(regexp_extract(p, '\[S[^\[]*$'), '\d+'), lambda n: case when cast(n as int) between 1 and 3 then '[S' || n || ']' else '' end), ' ') end), '') as t from p)
select conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(t, '(?i){dialogue.FAKE_CITE}', '', 'g'), '[ \t]{{2,}}', ' ', 'g'), ' +([.,;:!?])', '\1', 'g'), e' \t\n\r') as text from q""")
def validated_citations(spark, sf):
    cited = F.concat("text", F.lit(" [S"), F.col("turn") + 1, F.lit(", S9] [Wikipedia] . x[S9, S1] y [S2,3] [S7]!"))
    return table(spark, sf, "conversations").select("conv_id", "turn", dialogue.validated(cited, F.lit(3)).alias("text"))


def replies(spark, sf):
    """User turns; a level by the length of the reply, short ones are asides."""
    n = F.char_length("text")
    level = F.when(n % 3 == 0, "solid").when(n % 3 == 1, "misconception").otherwise("unclear")
    return table(spark, sf, "conversations").where("role = 'user'").select(F.col("conv_id").alias("session_id"), "turn", (n % 7 == 0).alias("aside"), level.alias("level"))


_STATES = """with recursive r as (select conv_id as session_id, turn, length(text) % 7 = 0 as aside, length(text) % 3 = 0 as solid, row_number() over (partition by conv_id order by turn) as i from conversations where role = 'user'),
s as (select session_id, cast(0 as bigint) as i, cast(-1 as bigint) as turn, 'DIAGNOSE' as stage, 0 as rounds, '' as kind from (select distinct session_id from r)
union all select session_id, i, turn, case kind when 'CHECK' then 'CHECK' when 'EXPLAIN' then 'EXPLAIN' when 'WRAP_UP' then 'DONE' when 'ANSWER' then 'DONE' else stage end, rounds + case when kind = 'EXPLAIN' then 1 else 0 end, kind
  from (select r.session_id, r.i, r.turn, s.stage, s.rounds, case when s.stage = 'DONE' then 'ERROR' when aside then 'ASIDE' when solid and s.stage = 'DIAGNOSE' then 'CHECK' when solid then 'WRAP_UP' when s.rounds < 2 then 'EXPLAIN' else 'ANSWER' end as kind
    from s join r on r.session_id = s.session_id and r.i = s.i + 1))
select session_id, turn, stage, rounds, kind from s where i > 0"""


@query(_STATES)
def dialogue_states(spark, sf):
    return dialogue.dialogue_states(replies(spark, sf))


@query("select event_type as kind, round(median(value), 4) as median, max(value) as max, count(*) as calls from events group by event_type")
def latency_by_kind(spark, sf):
    return dialogue.latency(table(spark, sf, "events").select(F.col("event_type").alias("kind"), F.col("value").alias("seconds")))


_GRADES = "select event_type as kind, cast(event_id % 3 as int) as correct, cast(floor(value) % 3 as int) as grounded from events"


@query(f"with g as ({_GRADES}), x as (select kind, 'correct' as dimension, correct as g from g union all select kind, 'grounded', grounded from g) select kind, dimension, round(avg(g), 4) as mean, count(*) filter (g = 2) as n2, count(*) filter (g = 1) as n1, count(*) filter (g = 0) as n0, count(*) as n from x group by all")
def rubric_histogram(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("kind"), (F.col("event_id") % 3).cast("int").alias("correct"), (F.floor("value") % 3).cast("int").alias("grounded"))
    return dialogue.rubric(rows, ("correct", "grounded"), ("kind",))


def assessed(spark, sf):
    """Customers are participants; their orders are scores: priority is the item, odd orders are the post form."""
    priority = F.substring("o_orderpriority", 1, 1)
    form = F.when(F.col("o_orderkey") % 2 == 0, "pre").otherwise("post")
    scores = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("participant_id"), form.alias("form"), priority.alias("item_id")).agg(F.least(F.count(F.lit(1)), F.lit(4)).alias("points"))
    rows = [(f, str(i), f"LO{i % 2}", 4) for f in ("pre", "post") for i in range(1, 6)]
    bank = spark.createDataFrame(rows, "form string, item_id string, objective_id string, max_score int")
    return bank, scores, table(spark, sf, "customer").select(F.col("c_custkey").alias("participant_id"), F.col("c_mktsegment").alias("condition"))


_SCORES = """bank as (select form, cast(i as varchar) as item_id, 'LO' || i % 2 as lo from (select unnest(['pre', 'post']) as form) a, (select unnest([1, 2, 3, 4, 5]) as i) b),
sc as (select o_custkey as pid, case when o_orderkey % 2 = 0 then 'pre' else 'post' end as form, substr(o_orderpriority, 1, 1) as item_id, least(count(*), 4) as points from orders group by all),
p as (select c_custkey as pid, c_mktsegment as condition, {lo} 100 * coalesce(sum(points) filter (b.form = 'pre'), 0) / (4 * count(*) filter (b.form = 'pre')) as pre, 100 * coalesce(sum(points) filter (b.form = 'post'), 0) / (4 * count(*) filter (b.form = 'post')) as post
  from customer, bank b left join sc on sc.pid = c_custkey and sc.form = b.form and sc.item_id = b.item_id group by all),
g as (select pid, condition, {lo} round(pre, 2) as pre, round(post, 2) as post, round(post - pre, 2) as absolute_gain, case when pre < 100 then round((post - pre) / (100 - pre), 4) end as normalized_gain from p)"""
_CLASS = "round(avg(pre), 2) as pre, round(avg(post), 2) as post, round(avg(post) - avg(pre), 2) as absolute_gain, case when avg(pre) < 100 then round((avg(post) - avg(pre)) / (100 - avg(pre)), 4) end as normalized_gain, round(avg(normalized_gain), 4) as mean_individual_normalized_gain"


@query(f"with {_SCORES.format(lo='')} select pid as participant_id, pre, post, absolute_gain, normalized_gain from g")
def learning_gain(spark, sf):
    return assessment.participant_gains(*assessed(spark, sf))


@query(f"with {_SCORES.format(lo='')} select condition, count(*) as n, {_CLASS} from g group by condition")
def class_gain(spark, sf):
    bank, scores, people = assessed(spark, sf)
    rows = assessment.participant_gains(bank, scores, people).join(people, "participant_id").where("condition is not null")
    return assessment.class_gains(rows, "condition")


@query(f"with {_SCORES.format(lo='lo,')} select lo as objective_id, count(*) as n, {_CLASS} from g group by lo")
def gain_by_objective(spark, sf):
    return assessment.class_gains(assessment.participant_gains(*assessed(spark, sf), by_objective=True), "objective_id")
