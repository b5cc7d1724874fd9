"""Document dedup: exact in two passes, near duplicates by shingles, duplicate chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import content_hash, plain_form, shingle_hashes
from corvane.operators import overlaps
from corvane.sources.files import stored

NEAR, OVERLAP = 0.8, 0.5


def canonical(docs: DataFrame, key: str, rank: list) -> DataFrame:
    """docs plus __first, the id of the first document (by rank) with the same key; null keys match nothing.

    The first of each key is an aggregate that is combined before the shuffle, joined back: no group is sorted.
    """
    first = docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by("doc_id", F.struct(*rank)).alias("__first"))
    return docs.join(first, key, "left")


def exact_duplicates(docs: DataFrame, name_col: str | None = None) -> DataFrame:
    """(doc_id, duplicate_of, duplicate_type): equal texts first, then equal plain forms among the rest.

    Originals come first in corpus order, but names that contain "copy" come last; blank texts are skipped in pass 2.
    """
    copy = F.lower(F.col(name_col)).contains("copy") if name_col else F.lit(False)
    rank = [F.col("__copy"), F.col("doc_id")]
    # written once: both passes read the keys twice, and neither a text again
    base = stored(docs.select("doc_id", F.coalesce(copy, F.lit(False)).alias("__copy"), F.sha2("text", 256).alias("__file"), F.when(F.trim("text") != "", content_hash(F.col("text"))).alias("__plain")))
    one = canonical(base, "__file", rank).withColumn("__dup", F.when(F.col("__first") != F.col("doc_id"), F.col("__first"))).drop("__first")
    rest = canonical(one.where(F.col("__dup").isNull()), "__plain", rank).where(F.col("__first") != F.col("doc_id"))
    found = one.where(F.col("__dup").isNotNull()).select("doc_id", F.col("__dup").alias("duplicate_of"), F.lit("exact_file").alias("duplicate_type"))
    return found.unionAll(rest.select("doc_id", F.col("__first").alias("duplicate_of"), F.lit("identical_text").alias("duplicate_type")))


def duplicate_chunks(chunks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, duplicate_of): later chunks with the plain form of an earlier one; texts without a-z and 0-9 are equal."""
    keyed = chunks.select(F.col(id_col).alias("doc_id"), content_hash(F.col(text_col)).alias("__key"))
    return canonical(keyed, "__key", [F.col("doc_id")]).where(F.col("__first") != F.col("doc_id")).select("doc_id", F.col("__first").alias("duplicate_of"))


def shingle_sets(docs: DataFrame, k: int = 5) -> overlaps.Sets:
    """The shingles of documents, written once, for the operators that read them; texts without shingles are left out."""
    return overlaps.shingle_sets(docs, k)


def near_duplicate_pairs(docs: DataFrame, k: int = 5, near: float = NEAR, overlap: float = OVERLAP, sets: overlaps.Sets | None = None) -> DataFrame:
    """(a, b, relation, jaccard, containment) of classes of equal shingle sets, a < b; no pairs within a class.

    A class is represented by its smallest id, and ``shingle_classes`` says who belongs to it; ``sets`` are those of
    ``shingle_sets``, if at hand.  Pairs come from where two blocks of sets are compared (``overlaps``): none is shuffled.
    """
    found = overlaps.overlapping(shingle_sets(docs, k) if sets is None else sets, near, overlap).where("a <> b")
    scored = found.withColumns({"j": F.col("i") / (F.col("na") + F.col("nb") - F.col("i")), "c": F.col("i") / F.least("na", "nb")})
    return scored.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("j") >= near, "near_duplicate").otherwise("overlap").alias("relation"), F.round("j", 3).alias("jaccard"), F.round("c", 3).alias("containment"))


def pair_counts(docs: DataFrame, k: int = 5, near: float = NEAR, overlap: float = OVERLAP, sets: overlaps.Sets | None = None) -> DataFrame:
    """(n): numbers whose sum is the pairs of documents in two near classes, for ``count_pairs``; no pair leaves its block."""
    return overlaps.overlapping(shingle_sets(docs, k) if sets is None else sets, near, overlap, "counts")


def shingle_classes(docs: DataFrame, k: int = 5, sets: overlaps.Sets | None = None) -> DataFrame:
    """(doc_id, class_id): documents with equal shingle sets share a class, named by its smallest id."""
    if sets is None:
        own = docs.where(plain_form(F.col("text")) != "").select("doc_id", shingle_hashes(F.col("text"), k).alias("s"))
        keyed = stored(own.select("doc_id", F.struct(F.size("s").alias("n"), F.xxhash64("s").alias("h"), F.xxhash64(F.lit(1), "s").alias("i")).alias("key")))
    else:
        keyed = sets.texts.select("doc_id", F.struct("n", "h", "i").alias("key"))
    return keyed.join(keyed.groupBy("key").agg(F.min("doc_id").alias("class_id")), "key").select("doc_id", "class_id")


def adjacency(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_near_duplicates, near_duplicates): one row a document that has a near duplicate.

    pairs are of classes, members(doc_id, class_id) tells who belongs to them.  Neighbours are classes by their smallest id,
    the document's own class among them if it has another member, each with the documents that it adds; so an identical
    twin has the links of its class, and a large class is never expanded into pairs.
    """
    sizes = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    ways = F.array(*[F.struct(F.col(x).alias("class_id"), F.col(y).alias("other")) for x, y in ("ab", "ba")])  # pairs are worked out once
    links = pairs.select(F.explode(ways).alias("w"), "relation", "jaccard", "containment").select("w.*", "relation", "jaccard", "containment").join(sizes.withColumnRenamed("class_id", "other"), "other")
    own = sizes.where("n > 1").select(F.col("class_id").alias("other"), "class_id", F.lit("near_duplicate").alias("relation"), F.lit(1.0).alias("jaccard"), F.lit(1.0).alias("containment"), (F.col("n") - 1).alias("n"))
    every = links.unionByName(own).select("class_id", "n", F.struct(F.col("other").alias("document_id"), "relation", "jaccard", "containment", F.col("n").alias("documents")).alias("e"))
    lists = every.groupBy("class_id").agg(F.sum("n").alias("n_near_duplicates"), F.array_sort(F.collect_list("e")).alias("near_duplicates"))
    return members.join(lists, "class_id").select("doc_id", "class_id", "n_near_duplicates", "near_duplicates")


def near_adjacency(docs: DataFrame, k: int = 5, near: float = NEAR, overlap: float = OVERLAP, sets: overlaps.Sets | None = None) -> DataFrame:
    """What ``adjacency`` gives of ``near_duplicate_pairs``, in one shuffle of lists of neighbours instead of rows of pairs."""
    sets = shingle_sets(docs, k) if sets is None else sets
    one = lambda c, kind: F.array(F.col(c).cast(kind))
    own = overlaps.classes_of(sets).where("m > 1").select("id", "n", F.array("id").alias("others"), one("n", "int").alias("sizes"), F.array((F.col("m") - 1).cast("int")).alias("texts"), one("n", "int").alias("both"))
    held = F.struct("others", "sizes", "texts", "both")
    # a class's rows stay as they are until its documents have joined: an entry as a struct is several times as large
    rows = overlaps.overlapping(sets, near, overlap, "lists").unionByName(own).groupBy(F.col("id").alias("class_id")).agg(F.max("n").alias("n"), F.collect_list(held).alias("rows"))
    found = shingle_classes(docs, k, sets).join(rows, "class_id")

    def link(x: Column) -> Column:
        j, c = x["both"] / (F.col("n") + x["sizes"] - x["both"]), x["both"] / F.least(F.col("n"), x["sizes"])
        return F.struct(x["others"].alias("document_id"), F.when(j >= near, "near_duplicate").otherwise("overlap").alias("relation"), F.round(j, 3).alias("jaccard"), F.round(c, 3).alias("containment"), x["texts"].cast("long").alias("documents"))

    links = F.transform(F.flatten(F.transform("rows", lambda r: F.arrays_zip(*[r[c].alias(c) for c in ("others", "sizes", "texts", "both")]))), link)
    total = F.aggregate("near_duplicates", F.lit(0).cast("long"), lambda t, x: t + x["documents"])
    return found.select("doc_id", "class_id", F.array_sort(links).alias("near_duplicates")).select("doc_id", "class_id", total.alias("n_near_duplicates"), "near_duplicates")


def count_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """One row near_duplicate_pairs: the unordered pairs of documents, those within a class included, without listing them.

    pairs are of classes, or what ``pair_counts`` gives.
    """
    sizes = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    if pairs.columns == ["n"]:
        between = pairs
    else:
        a, b = (sizes.select(F.col("class_id").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
        between = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(a, "a").join(b, "b").select((F.col("na") * F.col("nb")).alias("n"))
    return between.unionAll(sizes.select(F.expr("n * (n - 1) div 2"))).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("near_duplicate_pairs"))
