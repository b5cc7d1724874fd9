"""SimHash near-dedup at a word-shingle similarity: SimHash blocks first, then a prefix filter for what bits cannot promise.

SimHash bits cannot promise similarity 0.8 (about 10 of 64 bits differ there).  So the SimHash operator's pigeonhole blocks
(simhash.fingerprint_links) link what is close in bits, each link checked exactly, and the sets themselves give the other
candidates: two sets with Jaccard >= NEAR share one of their first n - ceil(NEAR n) + 1 shingles in any common order,
so every such pair meets in the bucket of a shingle; size and position bounds drop pairs that cannot reach NEAR, a parity
signature (which bounds how many shingles differ) drops most others, and the rest are checked on their whole sets.  The
order is common shingles last, as counted in a bounded sample of texts, then by hash: the sample decides how large
buckets are, never which pairs are found.

Rows with equal sets are one class from the start, and pairs that are connected already are not looked at again.  A bucket
over CAP members first links its members to one of them alone; then those left are met with all members, in chunks of
bounded size, so no task ever holds a whole large bucket.  Texts are met only by the pairs that are left.

Defined cases: words are runs without ASCII white space, A-Z are lower-cased; fewer words than a shingle make one
shingle of all words; texts without words are one class and near no other; sets are read by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._shared import materialise, small_batches
from corvane.llm.components import connected_components
from corvane.llm.simhash import fingerprint_links

NEAR, SHINGLE = 0.8, 5
CAP, CHUNK = 256, 4096
SAMPLE, COMMON = 16_384, 200_000
SEED = 42


def shingle_set(data: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles."""
    words = (data or b"").lower().split()
    grams = map(b" ".join, zip(*(islice(words, i, None) for i in range(min(shingle, len(words)))), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64).view(np.int64))


def reaches(common: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, near: float) -> np.ndarray | bool:
    """Is common / (a + b - common) at least near, for sets of a and b shingles?"""
    return common >= near * (a + b - common) - 1e-9


def common_shingles(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are common in a sample of texts, sorted, and how many texts have them."""
    rows = max(1, docs.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 0, 1 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingle_set(t.as_py(), shingle) for t in batch.column(0)]))], ["g"])

    drawn = docs.where(F.pmod(F.xxhash64(F.lit(SEED), "hash"), F.lit(rows)) < SAMPLE).select("t")
    counts = drawn.mapInArrow(run, "g long").groupBy("g").count().where("count > 2").orderBy(F.desc("count"), "g").limit(COMMON).toArrow()
    keys, n = (np.asarray(counts.column(k).to_pylist(), np.int64) for k in ("g", "count"))
    order = np.argsort(keys)
    return keys[order], n[order]


def set_print(own: np.ndarray) -> int:
    """The SimHash of a set of shingles: a bit is 1 if set in over half of their hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(own), 1 << 16):
        part = own[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(len(part), 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(own), bitorder="little").view(np.int64)[0])


def parity(own: np.ndarray) -> bytes:
    """Bit i tells whether an odd number of shingles have i as their hash's last bits; as many bits as shingles, or more."""
    width = max(256, 1 << max(0, len(own) - 1).bit_length())
    return np.packbits((np.bincount(own & (width - 1), minlength=width) & 1).astype(bool), bitorder="little").tobytes()


def differing(x: bytes, y: bytes) -> int:
    """At least so many shingles are in one of two sets alone, by their parities; a longer one folds onto the shorter."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) != len(b):
        a, b = (b, a) if len(a) < len(b) else (a, b)
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def shingle_sets(docs: DataFrame, shingle: int = SHINGLE, near: float = NEAR) -> DataFrame:
    """docs(id, hash, t) -> (id, hash, node, n, fp, odd, prefix): node stands for the set, n is its size."""
    keys, seen = common_shingles(docs, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2, 1 << 20):
            nodes, sizes, prints, odd, prefixes = [], [], [], [], []
            for t in batch.column(2):
                own = shingle_set(t.as_py(), shingle)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63))
                sizes.append(len(own))
                prints.append(set_print(own))
                odd.append(parity(own))
                at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
                often = np.where(keys[at] == own, seen[at], 0) if len(keys) else np.zeros(len(own), np.int64)
                prefixes.append(own[np.lexsort((own, often))][: len(own) - math.ceil(near * len(own) - 1e-9) + 1] if len(own) else own)
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes)))
            columns = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), pa.array(odd, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "hash", "node", "n", "fp", "odd", "prefix"])

    return docs.select("id", "hash", "t").mapInArrow(run, "id long, hash long, node long, n int, fp long, odd binary, prefix array<long>")


def may_reach(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], i: int, near: float) -> np.ndarray:
    """Which of ``right`` (n, at, c) are of another component than left's row i and may reach near with it."""
    (size, place, part), (sizes, places, parts) = left, right
    upto = np.minimum(size[i] - place[i], sizes - places)
    return (parts != part[i]) & reaches(upto, size[i], sizes, near)


def candidates(buckets: DataFrame, near: float) -> DataFrame:
    """buckets(m: list of (node, n, at, c), CAP at most) -> pairs (a, b) of different c that may reach near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members, ends = batch.column(0), batch.column(0).offsets.to_numpy()
            node, n, at, c = (members.values.field(k).to_numpy() for k in ("node", "n", "at", "c"))
            out_a, out_b, held = [], [], 0
            for s, e in zip(ends, ends[1:], strict=False):
                order = s + np.argsort(node[s:e])
                own, rest = node[order], tuple(x[order] for x in (n, at, c))
                for i in range(e - s - 1):
                    found = own[i + 1 :][may_reach(rest, tuple(x[i + 1 :] for x in rest), i, near)]
                    out_a.append(np.full(len(found), own[i]))
                    out_b.append(found)
                    held += len(found)
                if held > 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_a, out_b)], ["a", "b"])
                    out_a, out_b, held = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_a, out_b)], ["a", "b"])

    return buckets.select("m").mapInArrow(run, "a long, b long").distinct()


def star(large: DataFrame, near: float) -> DataFrame:
    """Pairs (a, b) of a bucket's smallest node and its members that may reach near with it."""
    first = large.groupBy("g").agg(F.min(F.struct("node", "n", "at", "c")).alias("f"))
    upto = F.least(F.col("f.n") - F.col("f.at"), F.col("n") - F.col("at"))
    fit = large.join(first, "g").where((F.col("f.c") != F.col("c")) & (upto >= near * (F.col("f.n") + F.col("n") - upto) - 1e-9))
    return fit.select(F.col("f.node").alias("a"), F.col("node").alias("b")).distinct()


def remaining(large: DataFrame, near: float) -> DataFrame:
    """Pairs (a, b) of members of large buckets that are not in the component of its smallest node, with all other members."""
    main = large.groupBy("g").agg(F.min(F.struct("node", "c")).getField("c").alias("main"))
    marked = large.join(main, "g").withColumn("left", F.col("c") != F.col("main"))
    sizes = marked.groupBy("g").agg(F.sum(F.col("left").cast("long")).alias("few"), F.count(F.lit(1)).alias("all")).where("few > 0")
    dealt = materialise(marked.drop("main").join(sizes.select("g", F.expr(f"(few + {CHUNK - 1}) div {CHUNK}").alias("x"), F.expr(f"(all + {CHUNK - 1}) div {CHUNK}").alias("y")), "g"))
    deal = lambda rows, own, other: rows.withColumns({own: F.pmod(F.xxhash64("node"), own)}).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
    block, held = ["g", "x", "y"], ["node", "n", "at", "c", "left"]
    few = deal(dealt.where("left"), "x", "y").select(*block, *held)
    every = deal(dealt, "y", "x").select(*block, *[F.col(c).alias(f"{c}_") for c in held])  # two sides of one table need names of their own

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:  # an empty side has no columns
            return pa.table({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        own, *mine = (left.column(k).to_numpy() for k in held[:4])
        other, *theirs, both = (right.column(f"{k}_").to_numpy() for k in held)
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(len(own)):
            found = other[may_reach(mine, theirs, i, near) & ~(both & (other <= own[i]))]
            out_a.append(np.full(len(found), own[i]))
            out_b.append(found)
        return pa.table({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    pairs = few.groupBy(*block).cogroup(every.groupBy(*block)).applyInArrow(run, "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def not_unlike(pairs: DataFrame, classes: DataFrame, near: float) -> DataFrame:
    """The pairs whose sets may have Jaccard >= near by their parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.asarray(batch.column(2)) + np.asarray(batch.column(3))
            apart = np.array([differing(x.as_py(), y.as_py()) for x, y in zip(batch.column(4), batch.column(5), strict=True)], np.int64)
            fit = pa.array(apart <= (1 - near) / (1 + near) * both + 1e-6)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(fit), batch.column(1).filter(fit)], ["a", "b"])

    for k in "ab":
        pairs = pairs.join(classes.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("odd").alias(f"o{k}")), k)
    return pairs.select("a", "b", "na", "nb", "oa", "ob").mapInArrow(run, "a long, b long")


def similar(pairs: DataFrame, texts: DataFrame, shingle: int, near: float) -> DataFrame:
    """The pairs (a, b) whose sets have Jaccard >= near; texts(node, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2, 1 << 20):
            keep, last, left = [], None, None
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, left = a, shingle_set(x.as_py(), shingle)
                right = shingle_set(y.as_py(), shingle)
                keep.append(bool(reaches(len(np.intersect1d(left, right, assume_unique=True)), len(left), len(right), near)))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in (0, 1)], ["a", "b"])

    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("t").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("t").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, near: float = NEAR, distance: int = 3) -> DataFrame:
    """docs(id, hash, t: binary) -> (id, hash, component, first): one row a document; documents linked by Jaccard >= near
    share a component, and ``first`` (id, hash) is the smallest of it."""
    sets = materialise(shingle_sets(docs, shingle, near))
    # a class is read from its smallest row
    classes = materialise(sets.groupBy("node").agg(F.min(F.struct("id", "hash")).alias("first"), *[F.first(c).alias(c) for c in ("n", "fp", "odd", "prefix")]))

    def checked(pairs: DataFrame) -> DataFrame:
        pairs = materialise(not_unlike(pairs, classes, near))
        wanted = materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes.select("node", "first.id", "first.hash"), "node"))
        texts = materialise(docs.join(wanted, ["id", "hash"]).dropDuplicates(["node"]).select("node", "t"))
        return materialise(similar(pairs, texts, shingle, near))

    prints = materialise(classes.groupBy("fp").agg(F.min("node").alias("node")))
    alike = classes.select("fp", F.col("node").alias("b")).join(prints, "fp").where("b <> node").select(F.col("node").alias("a"), "b")
    links = checked(fingerprint_links(prints, distance).unionAll(alike))

    keyed = classes.select("node", "n", F.posexplode("prefix").alias("at", "g"))
    shared = materialise(keyed.groupBy("g").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))
    members = materialise(keyed.join(shared, "g"))
    large = members.where(F.col("k") > CAP)

    def joined(rows: DataFrame) -> DataFrame:
        return rows.join(reach, "node", "left").select("g", "node", "n", "at", F.coalesce("component", "node").alias("c"))

    def connected(found: DataFrame, new: DataFrame) -> DataFrame:
        """The components found so far with new links: they are stars already, so only what is linked anew takes rounds."""
        return found if new.isEmpty() else materialise(connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(new)))

    reach = materialise(connected_components(links))
    small = joined(members.where(F.col("k") <= CAP)).groupBy("g").agg(F.collect_list(F.struct("node", "n", "at", "c")).alias("m"))
    crowded = not large.isEmpty()
    pairs = candidates(small, near)
    reach = connected(reach, checked(pairs.unionAll(star(joined(large), near)).distinct() if crowded else pairs))
    if crowded:
        reach = connected(reach, checked(remaining(joined(large), near)))
    named = classes.join(reach, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    firsts = named.groupBy("component").agg(F.min("first").alias("first"))
    return sets.select("id", "hash", "node").join(named.drop("first"), "node").join(firsts, "component").select("id", "hash", "component", "first")
