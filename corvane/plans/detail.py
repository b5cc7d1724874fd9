"""Queries for single rules, with their SQL: inputs are made from the driver's tables so that every branch fires."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import clean, dialogue, metadata, metrics, retrieval
from corvane.plans import queries as base
from corvane.plans.queries import BASE, LABELLED, Query, dense_queries, docs, measured, metrics_sql, qrels, run, table, vectors

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
COLUMNS = ("hit_5", "mrr_10", "ndcg_10")


def query(sql: str):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def picked(name: str, values: tuple[str, ...]):
    """One of the values by the id in column ``name``."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(name) % len(values) + 1).cast("int"))


# ---------------------------------------------------------------- two runs side by side
_B = metrics_sql("run_b").replace("ideal as", "ideal_b as").replace("join ideal ", "join ideal_b ").replace("met as", "mb as")
_TWO = f"{BASE}, {metrics_sql('run_a')}, ma as (select * from met), {_B}"
_MEANS = ", ".join(f"round(avg(ma.{c}), 4) as a_{c}, round(avg(mb.{c}), 4) as b_{c}" for c in COLUMNS)


def both(spark, sf):
    return measured(spark, sf), measured(spark, sf, 32)


@query(f"""with {_TWO}, g as (select query_id, unnest(['topic', 'difficulty', 'query_type']) as grouping, unnest([topic, difficulty, query_type]) as value from dq)
select grouping, value, min(query_id) as first, count(*) as queries, {_MEANS} from g join ma using (query_id) join mb using (query_id) group by grouping, value""")
def run_groups(spark, sf):
    return metrics.two_run_groups(*both(spark, sf), dense_queries(spark, sf), ("topic", "difficulty", "query_type"), COLUMNS)


@query(f"""with {_TWO}, x as (select query_id, unnest([5, 10, 20]) as cut, unnest([ma.hit_5, ma.hit_10, ma.hit_20]) as x, unnest([mb.hit_5, mb.hit_10, mb.hit_20]) as y from ma join mb using (query_id))
select cut, query_id, case when x = 0 and y = 0 then 'both' when x = 0 then 'a' else 'b' end as fails from x where x = 0 or y = 0""")
def failure_sets(spark, sf):
    return metrics.failure_sets(*both(spark, sf))


@query(f"""with {_TWO}, x as (select unnest([1, 3, 5, 10]) as cut, unnest([ma.hit_1, ma.hit_3, ma.hit_5, ma.hit_10]) as x, unnest([mb.hit_1, mb.hit_3, mb.hit_5, mb.hit_10]) as y from ma join mb using (query_id))
select cut, count(*) filter (x > 0) as a, count(*) filter (y > 0) as b from x group by cut""")
def hit_counts(spark, sf):
    return metrics.hit_counts(*both(spark, sf))


@query(f"""with {BASE}, c as (select unnest([10, 20]) as cut)
select cut, round((select count(*) from run_a a join run_b b using (query_id, doc_id) where a.rank <= cut and b.rank <= cut) / (select count(*) from dq), 2) as mean_shared from c""")
def shared_results(spark, sf):
    return metrics.shared_results(run(spark, sf), run(spark, sf, 32), dense_queries(spark, sf))


@query(f"""with {BASE}, x as (select r.*, grade from run_a r left join qrels using (query_id, doc_id) where rank <= 5), y as (select r.*, grade from run_b r left join qrels using (query_id, doc_id) where rank <= 3)
select query_id, rank, x.doc_id as a, x.grade as a_grade, y.doc_id as b, y.grade as b_grade from x full join y using (query_id, rank)""")
def side_by_side(spark, sf):
    """The second list ends at rank 3."""
    return metrics.side_by_side(run(spark, sf), run(spark, sf, 32).where("rank <= 3"), qrels(spark, sf), 5)


@query(f"""with {BASE}, {LABELLED.format('run_a')}, c as (select unnest([5, 10]) as cut)
select cut, 'label' || label as category, count(*) filter (grade > 0) as relevant, count(*) filter (grade = 0) as zero, count(*) filter (grade is null) as unjudged from c join lab_run_a l on rank <= cut join embeddings e on e.vec_id = l.doc_id group by cut, label""")
def category_counts_by_cut(spark, sf):
    rows = run(spark, sf).join(vectors(spark, sf).select("doc_id", "label"), "doc_id")
    five, ten = (metrics.categories(rows, qrels(spark, sf), F.concat(F.lit("label"), F.col("label")), k).withColumn("cut", F.lit(k)) for k in (5, 10))
    return five.unionByName(ten)


# ---------------------------------------------------------------- evaluation: every tag, histograms
_TAGS = f"""{BASE}, {LABELLED.format('run_a')},
m as (select vec_id as doc_id, label, vec_id // 10 as d, vec_id % 10 as c, vec_id % 7 as sec, case when vec_id % 2 = 0 then vec_id % 3 end as cls, vec_id % 11 = 0 as img from embeddings),
five as (select * from lab_run_a join m using (doc_id) where rank <= 5),
nb as (select distinct query_id, d, c from qrels join m using (doc_id) where grade > 0),
tags as (select w.query_id, w.doc_id, w.rank, list_filter([case when sec = 1 then 'reference_list' end, case when sec in (2, 3) then 'exercise_section' end,
  case when exists (select 1 from five o where o.query_id = w.query_id and o.doc_id <> w.doc_id and o.cls = w.cls) then 'duplicate_result' end,
  case when exists (select 1 from nb where nb.query_id = w.query_id and nb.d = w.d and abs(nb.c - w.c) = 1) then 'neighboring_chunk' end,
  case when w.label = dq.label then 'topically_related_unjudged' end, case when img then 'image_only_unit' end], lambda x: x is not null) as tags from five w join dq using (query_id) where not rel)"""


def tagged(spark, sf):
    """Ten ids in a row are one document's chunks; sections, classes of copies and pictures by the id."""
    i = F.col("doc_id")
    section = F.when(i % 7 == 1, "7 References").when(i % 7 == 2, "Homework 3").when(i % 7 == 3, "Questions").when(i % 7 == 4, "Preferences")
    meta = vectors(spark, sf).select("doc_id", F.expr("doc_id div 10").alias("document_id"), (i % 10).alias("chunk_index"), section.alias("section"), F.array("label").alias("subtopics"), F.when(i % 2 == 0, i % 3).alias("class_id"), (i % 11 == 0).alias("image_only"))
    return metrics.error_tags(run(spark, sf), qrels(spark, sf), meta, dense_queries(spark, sf).select("query_id", F.array("label").alias("subtopics")))


@query(f"with {_TAGS} select query_id, doc_id, rank, array_to_string(tags, ',') as tags from tags")
def error_tags_all(spark, sf):
    return tagged(spark, sf).withColumn("tags", F.array_join("tags", ","))


@query(f"with {_TAGS} select 'tags' as grouping, key, count(*) as n from (select unnest(tags) as key from tags) group by key")
def error_tag_counts(spark, sf):
    return metrics.label_counts(tagged(spark, sf), "tags")


@query(f"with f as ({base.SQL['failure_categories']}) select 'categories' as grouping, key, count(*) as n from (select unnest(string_split(categories, ',')) as key from f) group by key")
def failure_counts(spark, sf):
    return metrics.label_counts(base.failure_categories(spark, sf).withColumn("categories", F.split("categories", ",")), "categories")


@query(f"with d as ({base.SQL['exact_duplicates']}) select 'duplicate_type' as grouping, duplicate_type as key, count(*) as n from d group by duplicate_type")
def duplicate_kind_counts(spark, sf):
    return metrics.label_counts(base.exact_duplicates(spark, sf), "duplicate_type")


# ---------------------------------------------------------------- margins, paragraphs, display
_LINES = "select doc_id, line, line // 5 as unit, case when line % 5 = 0 then 'Course ' || (line // 5) || ' of ' || (doc_id % 3) when line % 5 = 4 then 'Page ' || (line // 5) when line % 5 = 3 and doc_id % 4 = 0 then 'Answer: 7' else t end as text, (line % 5) / 5 + 0.06 * (line % 5 = 4)::int as top from (select doc_id, unnest(string_split(text, chr(10))) as t, cast(generate_subscripts(string_split(text, chr(10)), 1) - 1 as int) as line from documents)"


@query(f"""with l as ({_LINES}), z as (select *, trim(regexp_replace(lower(text), '[0-9]+', '#', 'g')) as key from l where top < 0.12 or top > 0.85),
p as (select doc_id, count(distinct unit) as pages from l group by doc_id), o as (select doc_id, key, count(distinct unit) as n from z group by all)
select 'd' || doc_id as document_id, unit, line from z join p using (doc_id) join o using (doc_id, key) where (pages >= 3 and n >= greatest(3, 0.3 * pages)) or regexp_matches(trim(text), '{clean.PAGE_NUMBER}')""")
def margin_lines(spark, sf):
    """Five lines a page: a running header on top, a page number at the bottom."""
    rows = docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).withColumn("unit", F.expr("line div 5").cast("int"))
    at, page = F.col("line") % 5, F.col("unit").cast("string")
    text = F.when(at == 0, F.concat(F.lit("Course "), page, F.lit(" of "), F.col("doc_id") % 3)).when(at == 4, F.concat(F.lit("Page "), page)).when((at == 3) & (F.col("doc_id") % 4 == 0), "Answer: 7").otherwise(F.col("t"))
    return clean.margin_lines(rows.select(F.concat(F.lit("d"), "doc_id").alias("document_id"), "unit", "line", text.alias("text"), (at / 5 + F.when(at == 4, 0.06).otherwise(0)).alias("top")))


_BOXES = "select doc_id, line, line // 6 as unit, t, 100 + 40 * ((line + doc_id) % 3 = 1)::int as x0, 500 - 60 * (line % 5) as x1, 20 * line + 30 * (line % 4 = 3)::int as y0, 20 * line + 30 * (line % 4 = 3)::int + 15 as y1, doc_id % 5 = 0 as slides from (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line from documents)"


@query(f"""with b as ({_BOXES}), w as (select *, lag(y1) over u as py, lag(x0) over u as px, lag(x1) over u as pr, regexp_matches(rtrim(lag(t) over u), '[.:?!]$') as ended, max(x1) over (partition by doc_id, unit) as r from b window u as (partition by doc_id, unit order by line))
select doc_id, cast(line as int) as line, case when py is null or abs(y0 - py) > 6 then 'para' when slides then 'wrap' when ended and x0 > px + 10 then 'para' when pr < 0.75 * r or (ended and pr < 0.9 * r) then 'line' else 'wrap' end as para_break from w""")
def paragraph_breaks(spark, sf):
    """Six lines a page in boxes of several indents and widths, some with a gap above; every fifth document is slides."""
    rows = docs(spark, sf).select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    i = F.col("line")
    y = 20 * i + F.when(i % 4 == 3, 30).otherwise(0)
    boxes = rows.withColumns({"unit": F.expr("line div 6"), "x0": 100 + F.when((i + F.col("document_id")) % 3 == 1, 40).otherwise(0), "x1": 500 - 60 * (i % 5), "y0": y, "y1": y + 15, "size": F.lit(10), "slides": F.col("document_id") % 5 == 0})
    return clean.paragraph_breaks(boxes).select(F.col("document_id").alias("doc_id"), "line", "para_break")


@query(r"""select doc_id, case when doc_id % 3 = 0 then 'p.' || doc_id when doc_id % 3 = 1 then 'slide ' || doc_id end as location, case when length(t) > 160 then substr(t, 1, 160) || '...' else t end as snippet
from (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as t from documents)""")
def result_display(spark, sf):
    i = F.col("doc_id")
    return docs(spark, sf).select("doc_id", retrieval.location(F.when(i % 3 == 0, i), F.when(i % 3 == 1, i)).alias("location"), retrieval.snippet(F.col("text")).alias("snippet"))


# ---------------------------------------------------------------- dialogue
# replies of a model and what they mean
REPLIES = (
    ('{"level": "solid", "gap": ""}', "solid", ""),
    ('Sure: {"level": "misconception", "gap": "order"} .', "misconception", "order"),
    ('{"level": "perfect", "gap": "none"}', "unclear", "none"),
    ('{"level": "solid"} then {"level": "partial"}', "unclear", ""),
    ('{"level": "partial", "gap": ', "unclear", ""),
    ("no idea", "unclear", ""),
    ('{"gap": "a\\nb", "level": "partial"}', "partial", "a\nb"),
)
_MEANT = ", ".join("({}, '{}', '{}')".format(i, level, gap.replace("\n", "' || chr(10) || '")) for i, (_, level, gap) in enumerate(REPLIES))


@query(f"select conv_id, turn, level, gap from conversations join (values {_MEANT}) v(i, level, gap) on (conv_id + turn) % {len(REPLIES)} = i")
def parsed_replies(spark, sf):
    reply = F.element_at(F.array(*[F.lit(r) for r, _, _ in REPLIES]), ((F.col("conv_id") + F.col("turn")) % len(REPLIES) + 1).cast("int"))
    return table(spark, sf, "conversations").select("conv_id", "turn", dialogue.analysis(reply).alias("a")).select("conv_id", "turn", "a.*")


@query(f"with s as ({base.SQL['dialogue_states']}), l as (select conv_id as session_id, turn, length(text) % 3 = 0 as solid from conversations) select session_id, turn, case when stage <> 'DONE' then stage when solid then 'WRAP_UP' else 'ANSWER' end as kind from s join l using (session_id, turn)")
def turn_kinds(spark, sf):
    levels = base.replies(spark, sf).select("session_id", "turn", "level")
    return dialogue.dialogue_states(base.replies(spark, sf)).join(levels, ["session_id", "turn"]).select("session_id", "turn", dialogue.turn_kind(F.col("stage"), F.col("level")).alias("kind"))


@query(f"with {BASE} select query_id as session_id, rank, 'S' || rank as ref, case when doc_id % 3 = 0 then 'p.' || doc_id when doc_id % 3 = 1 then 'slide ' || doc_id end as location from run_a where rank <= 5")
def source_refs(spark, sf):
    i = F.col("doc_id")
    context = run(spark, sf).where("rank <= 5").select(F.col("query_id").alias("session_id"), "rank", F.when(i % 3 == 0, i).alias("page_start"), F.when(i % 3 == 1, i).alias("slide_start"))
    return dialogue.source_refs(context).select("session_id", "rank", "ref", "location")


# ---------------------------------------------------------------- metadata of documents
# file name, layout, first text, raw text, master text, code share; then source, professor, semester, module, document type
PROFILES = (
    (("FALLSEM2024-25_ABC_CSE303L_12_TH_2024-08-01_notes.pdf", "pages", "Threads", "Threads", "", 0.0), ("VIT", None, "FALLSEM2024-25", None, "notes")),
    (("Module-3 locks.pptx", "slides", "Locks", "Locks", "Silberschatz, Galvin", 0.0), ("unknown", None, None, "Module 3", "lecture")),
    (("chapter.pdf", "pages", "Concurrency", "OPERATING SYSTEMS\nWWW.OSTEP.ORG", "", 0.0), ("OSTEP (Operating Systems: Three Easy Pieces)", None, None, None, "textbook")),
    (("week.pdf", "pages", "Lecture 4\nProf. Ada Lovelace, CSE, IIT Bombay", "x", "", 0.0), ("IIT Bombay", "Ada Lovelace", None, None, "lecture")),
    (("quiz 2.pdf", "pages", "Module 5: Semaphores", "x", "", 0.0), ("unknown", None, None, "Module 5", "question_paper")),
    (("a.c", "pages", "int main", "x", "", 0.75), ("unknown", None, None, None, "programming_examples")),
    (("lab-1.pdf", "pages", "Practice problems", "x", "", 0.75), ("unknown", None, None, None, "practice_problems")),
    (("readme.txt", "pages", "Hello", "x", "", 0.25), ("unknown", None, None, None, "unknown")),
)
_WANTED = ", ".join("({})".format(", ".join([str(i), *["null" if v is None else f"'{v}'" for v in out]])) for i, (_, out) in enumerate(PROFILES))


@query(f"select doc_id, v.source, professor, semester, module, document_type, if(i = 1, 'Silberschatz, Galvin', null) as derived_from from documents join (values {_WANTED}) v(i, source, professor, semester, module, document_type) on doc_id % {len(PROFILES)} = i")
def document_profiles(spark, sf):
    """Every document has one of the profiles' file names and first texts."""
    own = [picked("doc_id", tuple(given[k] for given, _ in PROFILES)) for k in range(6)]
    rows = docs(spark, sf).select("doc_id", F.concat(F.lit("d"), "doc_id").alias("document_id"), *[c.alias(n) for c, n in zip(own, ("filename", "layout", "first_text", "raw_text", "master_text"), strict=False)], F.lit("x" * 100).alias("clean_text"), (100 * own[5]).alias("code_chars"), F.lit(25).alias("tokens"))
    return metadata.classify(rows).select("doc_id", "source", "professor", "semester", "module", "document_type", "derived_from")


_UNITS = "select 'd' || vec_id // 10 as document_id, cast(vec_id % 10 + 1 as int) as number, label % 3 as images, vec_id % 30 as body_tokens from embeddings"


@query(f"select document_id, string_agg(number, ',' order by number) as image_only_units from ({_UNITS}) where images > 0 and body_tokens < 15 and number <> 1 group by document_id")
def image_only_units(spark, sf):
    i = F.col("doc_id")
    units = vectors(spark, sf).select(F.concat(F.lit("d"), F.expr("doc_id div 10")).alias("document_id"), (i % 10 + 1).cast("int").alias("number"), (F.col("label") % 3).alias("images"), (i % 30).alias("body_tokens"))
    return metadata.image_only_units(units).withColumn("image_only_units", F.array_join(F.col("image_only_units").cast("array<string>"), ","))


@query("select 'd' || vec_id // 10 as document_id, arg_min('h' || vec_id, (label % 4) * 1000 + vec_id % 10) as title from embeddings group by 1")
def document_titles(spark, sf):
    i = F.col("doc_id")
    return metadata.titles(vectors(spark, sf).select(F.concat(F.lit("d"), F.expr("doc_id div 10")).alias("document_id"), (i % 10).alias("pos"), (F.col("label") % 4).alias("level"), F.concat(F.lit("h"), i).alias("text")))
