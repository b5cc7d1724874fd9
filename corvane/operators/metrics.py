"""Graded retrieval metrics for whole runs: run(query_id, rank, doc_id), qrels(query_id, doc_id, grade), queries(query_id)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECALL, HIT, PRECISION, MRR, NDCG, MAP = (1, 3, 5, 10), (1, 3, 5, 10), (5,), (5, 10), (5, 10), (5,)


def judged(qrels: DataFrame, pairs: DataFrame) -> DataFrame:
    """The judgments of pairs(query_id, doc_id).  Results are few and judgments may be many: the pairs are sent to them, and
    only what judges one of them is moved."""
    return qrels.join(F.broadcast(pairs.select("query_id", "doc_id").distinct()), ["query_id", "doc_id"], "left_semi")


def labelled(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """run plus grade: the judged grade (0 where judged not relevant), null where unjudged."""
    return run.join(judged(qrels.select("query_id", "doc_id", "grade"), run), ["query_id", "doc_id"], "left")


def names(depth: int) -> list[str]:
    more = {"precision": (10,), "hit": (20,)} if depth >= 20 else {}
    table = {"recall": RECALL, "hit": HIT, "precision": PRECISION, "mrr": MRR, "ndcg": NDCG, "map": MAP}
    return [f"{m}_{k}" for m, ks in table.items() for k in (*ks, *more.get(m, ()))]


def per_query(run: DataFrame, qrels: DataFrame, queries: DataFrame, depth: int = 10) -> DataFrame:
    """All metrics of each query, rounded to 6 digits; a query without results or relevant documents has zeros.

    A document that a list repeats counts once for recall, at its first rank.
    """
    rel = F.coalesce(F.col("grade"), F.lit(0)) > 0
    by = Window.partitionBy("query_id").orderBy("rank")
    seen = labelled(run, qrels).withColumn("again", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("rank")) > 1)
    seen = seen.withColumn("hits", F.sum(F.when(rel, 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    gain = lambda g, r: g / F.log2(r + 1)
    # the best list needs how many judgments there are of each grade, not the judgments in order
    before = F.coalesce(F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("grade")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ideal = qrels.where("grade > 0").groupBy("query_id", "grade").agg(F.count(F.lit(1)).alias("n")).withColumn("before", before)
    part = lambda k: F.when(F.col("before") < k, F.aggregate(F.sequence(F.col("before") + 1, F.least(F.col("before") + F.col("n"), F.lit(k))), F.lit(0.0), lambda a, p: a + gain(F.col("grade"), p)))
    best = ideal.groupBy("query_id").agg(F.sum("n").alias("n_rel"), *[F.sum(part(k)).alias(f"ideal_{k}") for k in NDCG])
    within = lambda k, c: F.when(rel & (F.col("rank") <= k), c)
    sums = []
    for name in names(depth):
        kind, k = name.split("_")[0], int(name.split("_")[1])
        sums.append({
            "recall": F.count(F.when(~F.col("again"), within(k, F.lit(1)))), "hit": F.max(within(k, F.lit(1))), "precision": F.count(within(k, F.lit(1))),
            "mrr": F.min(within(k, F.col("rank"))), "ndcg": F.sum(within(k, gain(F.col("grade"), F.col("rank")))), "map": F.sum(within(k, F.col("hits") / F.col("rank"))),
        }[kind].alias(name))
    joined = queries.select("query_id").join(seen.groupBy("query_id").agg(*sums), "query_id", "left").join(best, "query_id", "left")

    def final(name: str) -> Column:
        kind, k = name.split("_")[0], int(name.split("_")[1])
        value = {"recall": F.col(name) / F.col("n_rel"), "hit": F.col(name).cast("double"), "precision": F.col(name) / F.lit(k), "mrr": 1 / F.col(name), "ndcg": F.col(name) / F.col(f"ideal_{k}") if kind == "ndcg" else None, "map": F.col(name) / F.col("n_rel")}[kind]
        return F.round(F.coalesce(value, F.lit(0.0)), 6).alias(name)

    return joined.select("query_id", *[final(n) for n in names(depth)])


def grouped(metrics: DataFrame, queries: DataFrame, groups: list[str], columns: list[str]) -> DataFrame:
    """(grouping, value, queries, metric means rounded to 4): overall and by each group, in one pass over the rows."""
    joined = metrics.join(queries.select("query_id", *groups), "query_id")
    rows = joined.groupingSets([[], *[[g] for g in groups]], *groups).agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(c), 4).alias(c) for c in columns], F.grouping_id().alias("gid"))
    n = len(groups)
    label, value = F.lit("overall"), F.lit(None).cast("string")
    for i, g in enumerate(groups):
        own = F.col("gid") == (1 << n) - 1 - (1 << (n - 1 - i))
        label, value = F.when(own, g).otherwise(label), F.when(own, F.col(g).cast("string")).otherwise(value)
    return rows.select(label.alias("grouping"), value.alias("value"), "queries", *columns)


def coverage(run: DataFrame, qrels: DataFrame, queries: DataFrame, cuts: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """(cut, unjudged, retrieved, share, mean): how much of the top of the lists nobody judged."""
    n = queries.agg(F.count(F.lit(1)).alias("n"))
    flat = labelled(run, qrels).select("rank", F.col("grade").isNull().cast("int").alias("u"), F.explode(F.array(*map(F.lit, cuts))).alias("cut")).where("rank <= cut")
    return flat.groupBy("cut").agg(F.sum("u").alias("unjudged"), F.count(F.lit(1)).alias("retrieved")).crossJoin(F.broadcast(n)).select("cut", "unjudged", "retrieved", F.round(F.col("unjudged") / F.col("retrieved"), 4).alias("share"), F.round(F.col("unjudged") / F.col("n"), 4).alias("mean"))


def condensed(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """The run without unjudged results, ranked anew."""
    kept = labelled(run, qrels).where(F.col("grade").isNotNull())
    return kept.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).alias("rank"))


def duplicate_pairs(run: DataFrame, classes: DataFrame, most: int) -> DataFrame:
    """(query_id, a, b): results of one list that are copies of each other, by class(doc_id, class_id), earlier first."""
    own = run.where(F.col("rank") <= most).join(classes, "doc_id").select("query_id", "class_id", "rank", "doc_id")
    a, b = (own.select("query_id", "class_id", F.col("rank").alias(f"r{x}"), F.col("doc_id").alias(x)) for x in "ab")
    return a.join(b, ["query_id", "class_id"]).where("ra < rb").select("query_id", "a", "b")


def error_tags(run: DataFrame, qrels: DataFrame, meta: DataFrame, queries: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, doc_id, rank, tags) of results up to ``most`` that are not relevant.

    meta(doc_id, document_id, chunk_index, section, subtopics, class_id, image_only), queries(query_id, subtopics).
    """
    wrong = labelled(run, qrels).where((F.col("rank") <= most) & (F.coalesce("grade", F.lit(0)) == 0)).join(meta, "doc_id").join(queries.select("query_id", F.col("subtopics").alias("asked")), "query_id")
    # the neighbours of wrong results are few; those that are relevant are found among the judgments
    at = wrong.select("query_id", "document_id", "chunk_index").distinct()
    around = at.select("*", F.explode(F.array(F.col("chunk_index") - 1, F.col("chunk_index") + 1)).alias("other"))
    around = around.join(meta.select("doc_id", "document_id", F.col("chunk_index").alias("other")), ["document_id", "other"])
    relevant = judged(qrels.where("grade > 0").select("query_id", "doc_id"), around)
    beside = around.join(relevant, ["query_id", "doc_id"]).select("query_id", "document_id", "chunk_index").distinct().withColumn("near", F.lit(True))
    pairs = duplicate_pairs(run, meta.where(F.col("class_id").isNotNull()).select("doc_id", "class_id"), most)
    double = pairs.select("query_id", F.explode(F.array("a", "b")).alias("doc_id")).distinct().withColumn("double", F.lit(True))
    every = wrong.join(beside, ["query_id", "document_id", "chunk_index"], "left").join(double, ["query_id", "doc_id"], "left")
    section = F.coalesce("section", F.lit(""))
    tags = [("reference_list", section.rlike(r"\bReferences\b")), ("exercise_section", section.rlike(r"\b(Homework|Questions)\b")), ("duplicate_result", F.col("double").isNotNull()), ("neighboring_chunk", F.col("near").isNotNull()), ("topically_related_unjudged", F.arrays_overlap("subtopics", "asked")), ("image_only_unit", F.coalesce("image_only", F.lit(False)))]
    return every.select("query_id", "doc_id", "rank", F.array_compact(F.array(*[F.when(test, name) for name, test in tags])).alias("tags"))


def failures(metrics: DataFrame, run: DataFrame, queries: DataFrame, texts: DataFrame, qrels: DataFrame, image_only: DataFrame) -> DataFrame:
    """(query_id, categories) of queries with no relevant result in the top 5 or 10.

    queries(query_id, text); texts(doc_id, text); image_only(doc_id): units that are images.
    """
    idents = F.array_except(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b[a-z]+_[a-z_]+\b|\b\w+\(\)|\b[A-Z]{2,}\b"), F.lit(0))), F.array(*map(F.lit, ("CPU", "OS", "N", "M"))))
    asked = queries.select("query_id", F.explode(idents).alias("ident"))
    tops = run.where("rank <= 5").join(texts.select("doc_id", F.lower("text").alias("t")), "doc_id")
    hit = asked.join(tops, "query_id").groupBy("query_id").agg(F.max(F.col("t").contains(F.lower("ident"))).alias("named"))
    named = asked.select("query_id").distinct().join(hit, "query_id", "left").select("query_id", F.coalesce("named", F.lit(False)).alias("named"))
    picture = qrels.where("grade > 0").join(image_only, "doc_id", "left_semi").select("query_id").distinct().withColumn("picture", F.lit(True))
    rows = metrics.join(named, "query_id", "left").join(picture, "query_id", "left")
    five, ten = F.col("hit_5") == 0, F.col("hit_10") == 0
    miss, image = five & (F.col("named") == F.lit(False)), five & F.col("picture").isNotNull()
    parts = [("no_relevant_in_top5", five), ("exact_terminology_miss", F.coalesce(miss, F.lit(False))), ("relevant_near_image_only_unit", image), ("semantic_mismatch", five & ~F.coalesce(miss, F.lit(False)) & ~image), ("no_relevant_in_top10", ten)]
    return rows.where(five | ten).select("query_id", F.array_compact(F.array(*[F.when(test, name) for name, test in parts])).alias("categories"))


def validate_benchmark(queries: DataFrame, qrels: DataFrame, chunks: DataFrame, kinds: dict[str, tuple[str, ...]]) -> DataFrame:
    """(query_id, problem): repeated ids, empty or unknown fields, no relevant chunk, bad grades, unknown or twice judged chunks."""
    said = lambda rows, text: rows.select(F.col("query_id").cast("string").alias("query_id"), F.lit(text).alias("problem"))
    found = [
        said(queries.groupBy("query_id").count().where("count > 1"), "duplicate query_id"),
        said(queries.where("coalesce(trim(query), '') = ''"), "empty query"),
        said(queries.join(qrels.where("grade > 0").select("query_id").distinct(), "query_id", "left_anti"), "no relevant chunks"),
        said(qrels.where("grade not in (0, 1, 2) or grade is null"), "bad relevance grade"),
        said(qrels.join(qrels.select("doc_id").distinct().join(chunks.select("doc_id"), "doc_id", "left_anti"), "doc_id", "left_semi"), "unknown chunk"),
        said(qrels.where("doc_id is null"), "unknown chunk"),
        said(qrels.groupBy("query_id", "doc_id").count().where("count > 1"), "chunk judged twice"),
        said(qrels.select("query_id").distinct().join(queries, "query_id", "left_anti"), "judgment of an unknown query"),
        *[said(queries.where(F.col(c).isNull() | ~F.col(c).isin(list(values))), f"unknown {c}") for c, values in kinds.items()],
    ]
    out = found[0]
    for other in found[1:]:
        out = out.unionAll(other)
    return out.distinct()


def compare(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Per metric: both means and the mean difference b - a over common queries, rounded to 4."""
    both = a.select("query_id", *[F.col(c).alias(f"a_{c}") for c in columns]).join(b.select("query_id", *[F.col(c).alias(f"b_{c}") for c in columns]), "query_id")
    one = both.agg(*[F.avg(f"{s}_{c}").alias(f"{s}_{c}") for c in columns for s in "ab"])
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"a_{c}").alias("a"), F.col(f"b_{c}").alias("b")) for c in columns])
    return one.select(F.explode(rows).alias("r")).select("r.metric", F.round("r.a", 4).alias("mean_a"), F.round("r.b", 4).alias("mean_b"), F.round(F.col("r.b") - F.col("r.a"), 4).alias("delta"))


def overlap(a: DataFrame, b: DataFrame, qrels: DataFrame, cut: int) -> DataFrame:
    """Per query: common results in the top ``cut``, and relevant ones that both, only a, or only b found."""
    side = lambda run, name: run.where(F.col("rank") <= cut).select("query_id", "doc_id").distinct().withColumn(name, F.lit(1))
    found = side(a, "in_a").join(side(b, "in_b"), ["query_id", "doc_id"], "full_outer")
    both = found.join(judged(qrels.where("grade > 0").select("query_id", "doc_id", F.lit(1).alias("rel")), found), ["query_id", "doc_id"], "left")
    both_in, only_a, only_b = F.col("in_a").isNotNull() & F.col("in_b").isNotNull(), F.col("in_b").isNull(), F.col("in_a").isNull()
    rel = F.col("rel").isNotNull()
    return both.groupBy("query_id").agg(F.count_if(both_in).alias("common"), F.count_if(both_in & rel).alias("rel_both"), F.count_if(only_a & rel).alias("rel_a_only"), F.count_if(only_b & rel).alias("rel_b_only"))


def label_counts(rows: DataFrame, *labels: str) -> DataFrame:
    """(grouping, key, n) of each column of labels; a list counts each of its labels."""
    each = []
    for name in labels:
        many = rows.schema[name].dataType.typeName() == "array"
        flat = rows.select((F.explode(name) if many else F.col(name)).alias("key"))
        each.append(flat.select(F.lit(name).alias("grouping"), F.col("key").cast("string").alias("key")).where("key is not null"))
    return reduce(DataFrame.unionAll, each).groupBy("grouping", "key").agg(F.count(F.lit(1)).alias("n"))


def _both(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    side = lambda x, name: x.select("query_id", *[F.col(c).alias(f"{name}_{c}") for c in columns])
    return side(a, "a").join(side(b, "b"), "query_id")


def two_run_groups(a: DataFrame, b: DataFrame, queries: DataFrame, groups: Sequence[str], columns: Sequence[str], place: str = "query_id") -> DataFrame:
    """(grouping, value, first, queries, a_*, b_*): both runs' means by group; ``first`` is where a group appears first."""
    flat = queries.select("query_id", F.col(place).alias("__place"), F.explode(F.array(*[F.struct(F.lit(g).alias("grouping"), F.col(g).cast("string").alias("value")) for g in groups])).alias("g"))
    means = [F.round(F.avg(f"{s}_{c}"), 4).alias(f"{s}_{c}") for c in columns for s in "ab"]
    rows = _both(a, b, columns).join(flat.select("query_id", "__place", "g.*"), "query_id")
    return rows.groupBy("grouping", "value").agg(F.min("__place").alias("first"), F.count(F.lit(1)).alias("queries"), *means)


def failure_sets(a: DataFrame, b: DataFrame, cuts: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """(cut, query_id, fails): queries without a relevant result in the top ``cut`` of run a, b or both."""
    hits = _both(a, b, [f"hit_{k}" for k in cuts])
    flat = hits.select("query_id", F.explode(F.array(*[F.struct(F.lit(k).alias("cut"), F.col(f"a_hit_{k}").alias("x"), F.col(f"b_hit_{k}").alias("y")) for k in cuts])).alias("h")).select("query_id", "h.*")
    said = F.when((F.col("x") == 0) & (F.col("y") == 0), "both").when(F.col("x") == 0, "a").when(F.col("y") == 0, "b")
    return flat.select("cut", "query_id", said.alias("fails")).where("fails is not null")


def hit_counts(a: DataFrame, b: DataFrame, cuts: Sequence[int] = HIT) -> DataFrame:
    """(cut, a, b): how many queries have a relevant result in the top ``cut``, common queries alone."""
    one = _both(a, b, [f"hit_{k}" for k in cuts]).agg(*[F.count_if(F.col(f"{s}_hit_{k}") > 0).alias(f"{s}_{k}") for k in cuts for s in "ab"])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("cut"), F.col(f"a_{k}").alias("a"), F.col(f"b_{k}").alias("b")) for k in cuts])).alias("r")).select("r.*")


def shared_results(a: DataFrame, b: DataFrame, queries: DataFrame, cuts: Sequence[int] = (10, 20)) -> DataFrame:
    """(cut, mean_shared): results that both runs have in the top ``cut``, a mean over all queries."""
    cut = F.explode(F.array(*map(F.lit, cuts))).alias("cut")
    tops = [run.select("query_id", "doc_id", "rank", cut).where("rank <= cut").select("cut", "query_id", "doc_id").distinct() for run in (a, b)]
    common = tops[0].join(tops[1], ["cut", "query_id", "doc_id"]).groupBy("cut").agg(F.count(F.lit(1)).alias("n"))
    every = queries.agg(F.count(F.lit(1)).alias("__all")).select("__all", cut)
    return every.join(common, "cut", "left").select("cut", F.round(F.coalesce("n", F.lit(0)) / F.col("__all"), 2).alias("mean_shared"))


def side_by_side(a: DataFrame, b: DataFrame, qrels: DataFrame, cut: int) -> DataFrame:
    """(query_id, rank, a, a_grade, b, b_grade): the two lists rank by rank; null where a list has ended or nobody judged."""
    side = lambda run, name: labelled(run, qrels).where(F.col("rank") <= cut).select("query_id", "rank", F.col("doc_id").alias(name), F.col("grade").alias(f"{name}_grade"))
    return side(a, "a").join(side(b, "b"), ["query_id", "rank"], "full_outer")


def first_relevant(run: DataFrame, qrels: DataFrame, queries: DataFrame) -> DataFrame:
    found = labelled(run, qrels).where("grade > 0").groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return queries.select("query_id").join(found, "query_id", "left")


def containing_all(run: DataFrame, wanted: DataFrame, key: str, cut: int = 10) -> DataFrame:
    """Queries whose top ``cut`` has every value of wanted(key): division by counting distinct matches."""
    need = wanted.select(key).distinct()
    n = need.agg(F.count(F.lit(1)).alias("n"))
    got = run.where(F.col("rank") <= cut).join(need, key).groupBy("query_id").agg(F.count_distinct(key).alias("found"))
    return got.crossJoin(F.broadcast(n)).where("found = n").select("query_id")


def categories(run: DataFrame, qrels: DataFrame, category: Column, cut: int = 10) -> DataFrame:
    """(category, relevant, zero, unjudged) of results in the top ``cut``."""
    rows = labelled(run, qrels).where(F.col("rank") <= cut).withColumn("category", category)
    return rows.groupBy("category").agg(F.count_if(F.col("grade") > 0).alias("relevant"), F.count_if(F.col("grade") == 0).alias("zero"), F.count_if(F.col("grade").isNull()).alias("unjudged"))


def check_comparable(a: dict, b: dict, keys: tuple[str, ...] = ("benchmark", "corpus", "queries", "top_k", "metrics")) -> None:
    """Raise unless two runs agree on what they were measured on."""
    if wrong := [k for k in keys if a.get(k) != b.get(k)]:
        raise ValueError(f"runs differ in {wrong}")
