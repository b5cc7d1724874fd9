"""Phrase collocations by contiguous pattern growth in the manner of PrefixSpan, per language.

1. Words are counted.  2. Pairs of neighbours whose words are both frequent are counted by hash: an upper bound, enough to
tell where no frequent phrase can start or go on.  3. From each place where one can start, the words up to LONGEST, as
far as every pair may be frequent, form a window; equal windows become one row with a count, before the shuffle and
after.  A window is what an occurrence pointer points at: its prefixes are the phrases that start there.
4. Windows are dealt out by prefix, and the task of a prefix extends it to the right, depth first: it projects the
prefix's pointers by their next word and goes on with those words that keep the support.  A prefix with more than POINTERS
distinct windows is split into its extensions, and those again, so no task holds a common word's whole projection.
5. The score of a cut needs the counts of its two parts, which are frequent phrases or words themselves.

The filters of steps 2 and 3 are bit maps of FILTER_BITS at most, a bit for each key's hash: a false hit costs
work in step 4, which counts the phrases themselves; it changes no result.  Beyond some tens of millions of frequent
keys they let more pass, never less.

Scores are exact: products are taken in 38 decimal digits, which hold 1000 * a * n up to 10^17 words of a language.

Defined cases: a null text is empty and a null language is ``und`` (one with the language of that name); empty texts and
pieces give no words; rows that repeat an id or a text each count; ties of a cut go to the shorter first part, of the
score to the higher count, then to the phrase in byte order; an empty table, or one without a frequent phrase, gives no
rows; the id and other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from corvane.llm._shared import materialise, small_batches

SUPPORT, LONGEST, TOP = 100, 5, 2000
#: Windows of a prefix that one task takes whole; bits of a filter at most, and for each frequent key.
POINTERS, FILTER_BITS, BITS_A_KEY = 200_000, 1 << 28, 16
TEXT_BYTES = 8 << 20

_KIND = np.zeros(256, np.uint8)  # 1: white space in a piece, 2: the end of a piece
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_SEED = 42  # of Spark's xxhash64


class Words:
    """The words of some texts of one language: codes into ``names``, and which have their right neighbour in the piece."""

    def __init__(self, texts: list[bytes]) -> None:
        held = _LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
        kind = _KIND[held]
        inside = np.concatenate([[False], kind == 0, [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edge[0::2], edge[1::2]
        bytes_ = held[kind == 0]
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(bytes_)])
        coded = words.dictionary_encode()
        self.names, self.codes = coded.dictionary, np.asarray(coded.indices, np.int64)
        piece = np.cumsum(kind == 2)[starts] if len(starts) else np.zeros(0, np.int64)
        self.joined = piece[1:] == piece[:-1]

    def hashes(self, lang: str) -> np.ndarray:
        """What Spark's xxhash64(lang, word) gives, for each name."""
        seed = xxhash.xxh64_intdigest(lang, _SEED)
        return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.names.to_pylist()), np.uint64, len(self.names))


def _pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = (first * np.uint64(0x9E3779B97F4A7C15)) ^ (second + np.uint64(0x7F4A7C15) + (first >> np.uint64(29)))
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(33))


class BitFilter:
    """Membership by one hash; sent to the executors as a broadcast of FILTER_BITS bits at most."""

    def __init__(self, keys: DataFrame, hash_: Column, n: int) -> None:
        self.bits = 1 << 15
        while self.bits < FILTER_BITS and self.bits < n * BITS_A_KEY:
            self.bits *= 2
        at = keys.select(F.shiftrightunsigned(hash_, 64 - (self.bits.bit_length() - 1)).alias("at"))
        parts = at.groupBy(F.shiftright("at", 15).alias("part")).agg(F.bitmap_construct_agg((F.col("at") % 32768)).alias("bits")).toArrow()
        held = np.zeros((self.bits >> 15, 4096), np.uint8)
        if parts.num_rows:
            held[parts.column("part").to_numpy()] = np.stack([np.frombuffer(b, np.uint8) for b in parts.column("bits").to_pylist()])
        self.sent = keys.sparkSession.sparkContext.broadcast(held.ravel())

    def __getstate__(self) -> dict:
        return {"bits": self.bits, "sent": self.sent}

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> np.uint64(64 - (self.bits.bit_length() - 1))).astype(np.int64)
        return (self.sent.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text.alias("text"))


def _by_language(read: Callable[[str, Words], list[pa.Array]], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function: ``read`` makes columns (after lang) of the words of each language of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1, TEXT_BYTES):
            texts = defaultdict(list)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts[lang].append(text)
            for lang, own in texts.items():
                columns = read(lang, Words(own))
                if len(columns[0]):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(columns[0]), pa.string()), *columns], names=["lang", *names])
            pa.default_memory_pool().release_unused()

    return run


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, f): the occurrences of every word, and under a null phrase those of all words of the language."""

    def read(lang: str, words: Words) -> list[pa.Array]:
        counts = np.bincount(words.codes, minlength=len(words.names))
        return [pa.concat_arrays([words.names, pa.nulls(1, pa.string())]), pa.array(np.append(counts, counts.sum()))]

    found = _texts(docs, text_col, lang_col).mapInArrow(_by_language(read, ["phrase", "f"]), "lang string, phrase string, f long")
    return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _pair_counts(docs: DataFrame, words: BitFilter, text_col: str, lang_col: str) -> DataFrame:
    """(h, f): upper bounds of the occurrences of pairs of frequent words, by hash."""

    def read(lang: str, found: Words) -> list[pa.Array]:
        h = found.hashes(lang)
        fit = words.has(h)[found.codes]
        at = np.flatnonzero(fit[1:] & fit[:-1] & found.joined)
        pair, counts = np.unique(_pair_hash(h[found.codes[at]], h[found.codes[at + 1]]), return_counts=True)
        return [pa.array(pair.view(np.int64)), pa.array(counts)]

    found = _texts(docs, text_col, lang_col).mapInArrow(_by_language(read, ["h", "f"]), "lang string, h long, f long")
    return found.groupBy("h").agg(F.sum("f").alias("f"))


def windows(docs: DataFrame, pairs: BitFilter, longest: int, text_col: str, lang_col: str) -> DataFrame:
    """(lang, window, f): the words from every place on, while each pair may be frequent; two at least."""

    def read(lang: str, found: Words) -> list[pa.Array]:
        h, codes, n = found.hashes(lang), found.codes, len(found.names) + 1
        on = np.zeros(len(codes), np.int64)
        near = np.flatnonzero(found.joined)
        on[near] = pairs.has(_pair_hash(h[codes[near]], h[codes[near + 1]]))
        at = np.flatnonzero(on)
        going, rows = np.ones(len(at), bool), [codes[at]]
        key = codes[at]
        for step in range(1, longest):
            going &= on[np.minimum(at + step - 1, len(on) - 1)] == 1
            own = np.where(going, codes[np.minimum(at + step, len(codes) - 1)], -1)
            rows.append(own)
            _, key = np.unique(key * n + own + 1, return_inverse=True)
        _, first, counts = np.unique(key, return_index=True, return_counts=True)
        table = np.stack(rows, 1)[first]
        fit = table >= 0
        ends = np.concatenate([[0], np.cumsum(fit.sum(1))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), found.names.take(pa.array(table[fit])))
        return [pc.binary_join(lists, " "), pa.array(counts)]

    found = _texts(docs, text_col, lang_col).mapInArrow(_by_language(read, ["window", "f"]), "lang string, window string, f long")
    return found.groupBy("lang", "window").agg(F.sum("f").alias("f"))


def grow(prefix: tuple[str, ...], pointers: list[tuple[list[str], int]], support: int) -> Iterator[tuple[str, int]]:
    """(phrase, f) of the prefix and all its frequent extensions to the right; pointers are its windows with counts."""
    f = sum(n for _, n in pointers)
    if f < support:
        return
    if len(prefix) > 1:
        yield " ".join(prefix), f
    projected: dict[str, list[tuple[list[str], int]]] = defaultdict(list)
    for pointer in pointers:
        if len(pointer[0]) > len(prefix):
            projected[pointer[0][len(prefix)]].append(pointer)
    for word, own in projected.items():
        yield from grow((*prefix, word), own, support)


def _split(found: DataFrame, longest: int, pointers: int) -> tuple[DataFrame, list[DataFrame]]:
    """(windows with the ``prefix`` of their task, counts of the prefixes of two words and more that were split)."""
    dealt, counted = found.withColumns({"prefix": F.substring_index("window", " ", 1), "depth": F.lit(1)}), []
    for depth in range(1, longest):
        sizes = dealt.where(F.col("depth") == depth).groupBy("lang", "prefix").agg(F.count(F.lit(1)).alias("n"), F.sum("f").alias("f"))
        hot = materialise(sizes.where(F.col("n") > pointers).select("lang", "prefix", "f"))
        if hot.isEmpty():
            break
        if depth > 1:
            counted.append(hot.withColumnRenamed("prefix", "phrase"))
        dealt = dealt.join(hot.select("lang", "prefix", F.lit(True).alias("hot")), ["lang", "prefix"], "left")
        longer = F.col("hot") & (F.col("prefix") != F.col("window"))
        dealt = dealt.select("lang", "window", "f", F.when(longer, F.substring_index("window", " ", depth + 1)).otherwise(F.col("prefix")).alias("prefix"), F.when(longer, depth + 1).when(F.col("hot"), 0).otherwise(F.col("depth")).alias("depth"))
    # a window that ends with a split prefix is in that prefix's count already
    return dealt.where("depth > 0"), counted


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang", pointers: int = POINTERS) -> DataFrame:
    """(lang, phrase, f), written: all phrases of 2 to ``longest`` words and all words with f >= support; phrase null: all words."""
    if support < 1 or longest < 2:
        raise ValueError("support must be 1 at least and longest 2")
    words = materialise(word_counts(docs, text_col, lang_col).where(F.col("phrase").isNull() | (F.col("f") >= support)))
    known = words.where("phrase is not null")
    seen = BitFilter(known, F.xxhash64("lang", "phrase"), known.count())
    pairs = materialise(_pair_counts(docs, seen, text_col, lang_col).where(F.col("f") >= support).select("h"))
    linked = BitFilter(pairs, F.col("h"), pairs.count())
    dealt, counted = _split(materialise(windows(docs, linked, longest, text_col, lang_col)), longest, pointers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def grown(key: tuple[str, str], own: list) -> Iterator[tuple[str, str, int]]:
            return ((key[0], phrase, f) for phrase, f in grow(tuple(key[1].split(" ")), own, support))

        def rows() -> Iterator[tuple[str, str, int]]:
            at, own = None, []
            for batch in batches:
                for lang, prefix, window, f in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if (lang, prefix) != at:
                        if own:
                            yield from grown(at, own)
                        at, own = (lang, prefix), []
                    own.append((window.split(" "), f))
            if own:
                yield from grown(at, own)

        held: list[tuple[str, str, int]] = []
        for row in rows():
            held.append(row)
            if len(held) == 10_000:
                yield pa.RecordBatch.from_pydict(dict(zip(("lang", "phrase", "f"), map(list, zip(*held, strict=True)), strict=True)))
                held = []
        if held:
            yield pa.RecordBatch.from_pydict(dict(zip(("lang", "phrase", "f"), map(list, zip(*held, strict=True)), strict=True)))

    found = dealt.select("lang", "prefix", "window", "f").repartition("lang", "prefix").sortWithinPartitions("lang", "prefix").mapInArrow(run, "lang string, phrase string, f long")
    for own in counted:
        found = found.unionByName(own.where(F.col("f") >= support))
    return materialise(words.unionByName(found))


def _part(words: Column, start: Column | int, n: Column) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, top: int = TOP, share: int = 100, text_col: str = "text", lang_col: str = "lang", pointers: int = POINTERS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases by their lowest-scoring cut.

    A phrase inside a longer one that has at least ``share`` hundredths of its occurrences is dropped.
    """
    known = frequent_phrases(docs, support, longest, text_col, lang_col, pointers)
    total = known.where("phrase is null").select("lang", F.col("f").alias("n"))
    known = known.where("phrase is not null")
    phrases = known.withColumn("w", F.split("phrase", " ")).withColumn("m", F.size("w")).where("m > 1").withColumnRenamed("f", "a")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("m") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("m") - size + 1), lambda i: _part(F.col("w"), i, size))))
    longer = phrases.where("m > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = phrases.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    cuts = kept.select("lang", "phrase", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.col("w"), F.lit(1), F.col("k")).alias("first"), _part(F.col("w"), F.col("k") + 1, F.col("m") - F.col("k")).alias("rest"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    scored = cuts.join(total, "lang").withColumn("score", F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n"), wide("l") * wide("r")))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    lowest = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # a language is first cut to its best in each of some buckets, so none is sorted whole in one task
    dealt = lowest.withColumn("b", F.pmod(F.xxhash64("phrase"), F.lit(256))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "b").orderBy(*order))).where(F.col("rank") <= top)
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
words as (select lang, w from (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces) where len(w) > 0),
grams as (
  select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, m
  from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from words, (select unnest(range(1, 6)) as m) where len(w) >= m)),
counted as (select lang, phrase, m, count(*) as f from grams group by all),
total as (select lang, sum(f)::hugeint as n from counted where m = 1 group by lang),
known as (select lang, phrase, m, f, string_split(phrase, ' ') as w from counted where f >= 100),
longer as (
  select lang, array_to_string(w[i:i + s - 1], ' ') as phrase, max(f) as longer
  from (select lang, w, f, s, unnest(range(1, m - s + 2)) as i from (select lang, w, f, m, unnest(range(2, m)) as s from known where m > 2)) group by 1, 2),
kept as (select k.* from known k left join longer g on g.lang = k.lang and g.phrase = k.phrase where k.m > 1 and (g.longer is null or g.longer < k.f)),
cuts as (select lang, phrase, f as a, k, array_to_string(w[1:k], ' ') as first, array_to_string(w[k + 1:m], ' ') as rest from (select *, unnest(range(1, m)) as k from kept)),
scored as (
  select c.lang, c.phrase, c.a, c.k, l.f as l, r.f as r, t.n, (1000::hugeint * c.a * t.n) // (l.f::hugeint * r.f) as score
  from cuts c join known l on l.lang = c.lang and l.phrase = c.first join known r on r.lang = c.lang and r.phrase = c.rest join total t on t.lang = c.lang),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from lowest)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from ranked where rank <= 2000
"""
