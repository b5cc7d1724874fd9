"""Retrieval for whole batches of queries: BM25, exact cosine, reciprocal rank fusion, filters, payloads."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import TOKEN, text_hash, tokens
from corvane.sources.shared import small_arrow, stored

K1, B = 1.2, 0.75
RRF_K, CANDIDATES = 60, 50
# The payload fields that a filter may name.
FILTERABLE = ("topic_area", "document_type", "source", "professor", "module", "semester", "content_type", "chunk_type", "course", "document_id", "filename", "subtopics", "problem_types")
BLOCK = 4096
#: Queries of a block that are compared at once: a slice's scores are all that a Python worker holds of them.
SLICE = 128
#: Documents of a block of BM25, cells of its matrix of documents and terms that are held at once, and terms of queries that
#: are sent to the scan.
DOCS, CELLS, SENT = 2048, 1 << 21, 200_000
#: Lower case of bytes that are in terms, all others as a space; the letters beyond ASCII whose lower case has one within it.
PLAIN = bytes(ord(c) if (c := chr(i).lower()) in "abcdefghijklmnopqrstuvwxyz0123456789_" else 32 for i in range(128)) + b" " * 128
CAPITALS = {"\u0130".encode(): b"i\xcc\x87", "\u212a".encode(): b"k"}


def check_top_k(top_k: int) -> int:
    if isinstance(top_k, bool) or not isinstance(top_k, int) or top_k < 1:
        raise ValueError("top_k must be a positive integer")
    return top_k


def check_filters(filters: Mapping[str, str | Sequence[str]] | None, allowed: Sequence[str] = FILTERABLE) -> dict[str, list[str]]:
    """Filters as lists of values; raises on unknown fields and on empty, null or non-string values."""
    out: dict[str, list[str]] = {}
    for field, given in (filters or {}).items():
        if field not in allowed:
            raise ValueError(f"unknown filter field {field!r}; filterable: {list(allowed)}")
        values = list(given) if isinstance(given, list | tuple) else [given]
        if not values or not all(isinstance(v, str) and v for v in values):
            raise ValueError(f"filter {field!r} needs non-empty string values")
        out[field] = values
    return out


def parse_filters(arguments: Sequence[str]) -> dict[str, list[str]]:
    """field=value arguments; a repeated field lists its values."""
    out: dict[str, list[str]] = {}
    for argument in arguments:
        field, sign, value = argument.partition("=")
        if not sign:
            raise ValueError(f"{argument!r} is not field=value")
        out.setdefault(field, []).append(value)
    return out


def filter_rows(table: DataFrame, filters: Mapping[str, str | Sequence[str]] | None, allowed: Sequence[str] = FILTERABLE) -> DataFrame:
    """Rows that match every field (any of its values; arrays: any element), to be applied before ranking."""
    for field, values in check_filters(filters, allowed).items():
        if table.schema[field].dataType.typeName() == "array":
            table = table.where(F.arrays_overlap(field, F.array(*map(F.lit, values))))
        else:
            table = table.where(F.col(field).isin(values))
    return table


def top(scored: DataFrame, k: int, query: str = "query_id", pos: str = "doc_id", score: str = "score") -> DataFrame:
    """Rank by rounded score, ties in corpus order; Spark prunes to k rows a query before the shuffle."""
    order = Window.partitionBy(query).orderBy(F.col(score).desc(), pos)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= check_top_k(k))


def term_counts(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.select(id_col, F.explode(tokens(F.col("text"))).alias("term")).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def lengths(docs: DataFrame) -> DataFrame:
    """Tokens of every document, in place: no shuffle."""
    return docs.select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("dl"))


def inverse_frequency(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, df, idf) over the collection."""
    each = docs.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("term", "df", inverse_frequency(F.col("df"), F.col("n")).alias("idf"))


def index_stats(docs: DataFrame) -> DataFrame:
    """(documents, vocabulary, avgdl): one row."""
    size = lengths(docs).agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg("dl"), 4).alias("avgdl"))
    words = docs.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).agg(F.count_distinct("term").alias("vocabulary"))
    return size.crossJoin(words).select("documents", "vocabulary", "avgdl")


def counted(docs: DataFrame, words: frozenset[bytes] | None = None) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, dl, terms, tfs): each document's terms with their counts, or those of ``words``.

    One row a row of docs, counted where it is read and written once; a null text has no length and no terms.
    """
    pattern = re.compile(TOKEN.encode())

    def found_in(text: bytes) -> list[bytes]:
        for capital, small in CAPITALS.items():
            text = text.replace(capital, small)
        words = text.translate(PLAIN).split()  # a term is in one of these, and is it unless there is a low line
        return words if b"_" not in text else [t for w in words for t in (pattern.findall(w) if b"_" in w else (w,))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends, terms, tfs = [], [0], [], []
            for text in batch.column(1).to_pylist():
                found = Counter(() if text is None else found_in(text))
                sizes.append(None if text is None else found.total())
                own = found if words is None else {t: found[t] for t in found.keys() & words}
                terms.extend(own)
                tfs.extend(own.values())
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (pa.array(terms, pa.binary()).cast(pa.string()), pa.array(tfs, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], ["doc_id", "dl", "terms", "tfs"])

    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    with small_arrow(docs.sparkSession):
        return stored(texts.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, dl long, terms array<string>, tfs array<int>"))


def merged(rows: DataFrame) -> DataFrame:
    """Rows of ``counted`` that have terms; those that repeat an id and a length are one document."""
    full = rows.where(F.size("terms") > 0)
    again = stored(full.groupBy("doc_id", "dl").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("__id"), F.col("dl").alias("__dl")))
    if again.isEmpty():
        return full
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("dl") == F.col("__dl"))
    each = full.join(again, same, "left_semi").select("doc_id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("x"))
    sums = each.groupBy("doc_id", "dl", F.col("x.terms").alias("term")).agg(F.sum("x.tfs").cast("int").alias("tf"))
    one = sums.groupBy("doc_id", "dl").agg(F.collect_list(F.struct("term", "tf")).alias("x")).select("doc_id", "dl", F.col("x.term").alias("terms"), F.col("x.tf").alias("tfs"))
    return full.join(again, same, "left_anti").unionByName(one)


def impact(tf, dl, avgdl: float, k1: float, b: float):
    """A term's share of a score without the query's weight, of columns or of arrays."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def bm25(docs: DataFrame, queries: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """docs(doc_id, text), queries(query_id, text) -> (query_id, rank, doc_id, score); repeated query tokens count.

    Texts are read once; only terms that occur in some query leave the scan, unless there are more than SENT.  Documents
    and queries meet in blocks of DOCS and BLOCK rows, a matrix product for each SLICE of the queries, so no (query,
    document) pair is shuffled but the k best of a block.
    """
    check_top_k(k)
    asked = stored(queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")))
    words = asked.select("term").distinct().limit(SENT + 1).collect()
    rows = counted(docs, frozenset(r[0].encode() for r in words) if len(words) <= SENT else None)
    n, avgdl = rows.agg(F.count(F.lit(1)), F.avg("dl")).first()
    found = merged(rows)
    df = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = asked.join(df, "term").select("query_id", F.struct("term", (F.col("qtf") * inverse_frequency(F.col("df"), F.lit(n))).alias("w")).alias("x"))
    lists = weighed.groupBy("query_id").agg(F.collect_list("x").alias("x")).select("query_id", F.col("x.term").alias("words"), F.col("x.w").alias("ws"))
    parts = [max(1, -(-n // DOCS)), max(1, -(-asked.select("query_id").distinct().count() // BLOCK))]
    deal = lambda t, i, x: t.withColumn(x, F.pmod(F.xxhash64(i), F.lit(parts["pq".index(x)])))
    every = lambda t, x: t.withColumn(x, F.explode(F.sequence(F.lit(0), F.lit(parts["pq".index(x)] - 1)).cast("array<bigint>")))
    left, right = every(deal(found, "doc_id", "p"), "q"), every(deal(lists, "query_id", "q"), "p")

    def block(x: pa.Table, y: pa.Table) -> pa.Table:
        x = x.take(pc.sort_indices(x, sort_keys=[("doc_id", "ascending")], null_placement="at_start"))
        ids = pa.concat_arrays(x.column("doc_id").chunks).dictionary_encode("encode") if len(x) else None
        out = [(y.column("query_id").slice(0, 0), x.column("doc_id").slice(0, 0), np.zeros(0))]
        if len(x) and len(y):
            terms, tf = (pa.concat_arrays(x.column(c).chunks) for c in ("terms", "tfs"))
            row = np.repeat(np.arange(len(x)), terms.value_lengths().to_numpy())
            own = impact(tf.flatten().to_numpy().astype(float), x.column("dl").to_numpy()[row], avgdl, k1, b)
            doc, terms = ids.indices.to_numpy()[row], terms.flatten()
            for i in range(0, len(y), SLICE):
                some = y.slice(i, SLICE)
                q, d, s = ranked(doc, len(ids.dictionary), terms, own, pa.concat_arrays(some.column("words").chunks), pa.concat_arrays(some.column("ws").chunks))
                out.append((some.column("query_id").take(pa.array(q)), ids.dictionary.take(pa.array(d)), s))
        return pa.table({c: pa.chunked_array([z for v in part for z in (v.chunks if isinstance(v, pa.ChunkedArray) else [pa.array(v) if isinstance(v, np.ndarray) else v])], type=t) for c, part, t in zip(("query_id", "doc_id", "score"), zip(*out, strict=True), (y.schema.field("query_id").type, x.schema.field("doc_id").type, pa.float64()), strict=True)})

    def ranked(doc: np.ndarray, docs_: int, terms: pa.Array, own: np.ndarray, words_: pa.ListArray, ws: pa.ListArray) -> list[np.ndarray]:
        known = words_.flatten().unique()
        weights = np.zeros((len(known), len(words_)))
        weights[pc.index_in(words_.flatten(), known).to_numpy(), np.repeat(np.arange(len(words_)), words_.value_lengths().to_numpy())] = ws.flatten().to_numpy()
        at = pc.fill_null(pc.index_in(terms, known), -1).to_numpy()
        doc, own, at = doc[at >= 0], own[at >= 0], at[at >= 0]  # rows come by document
        s, some = np.empty((docs_, len(words_))), max(1, CELLS // len(known))
        for j in range(0, docs_, some):
            to = min(j + some, docs_)
            lo, hi = np.searchsorted(doc, (j, to))
            shares = np.bincount((doc[lo:hi] - j) * len(known) + at[lo:hi], own[lo:hi], (to - j) * len(known))
            s[j:to] = shares.reshape(to - j, -1) @ weights
        s = np.where(s > 0, np.floor(s * 1e6 + 0.5) / 1e6, -np.inf).T
        order = np.argsort(-s, axis=1, kind="stable")[:, :k]
        q = np.repeat(np.arange(len(s)), order.shape[1])
        best = s[q, order.ravel()]
        return [q[np.isfinite(best)], order.ravel()[np.isfinite(best)], best[np.isfinite(best)]]

    kind = {c: t.schema[c].dataType.simpleString() for t, c in ((queries, "query_id"), (docs, "doc_id"))}
    scored = left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInArrow(block, f"query_id {kind['query_id']}, doc_id {kind['doc_id']}, score double")
    return top(scored, k).select("query_id", "rank", "doc_id", "score")


def norms(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    square = F.aggregate(vector_col, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return vectors.select(id_col, F.round(F.sqrt(square), 6).alias("norm"))


def cosine(vectors: DataFrame, queries: DataFrame, k: int, dims: int | None = None) -> DataFrame:
    """vectors(doc_id, v), queries(query_id, v) -> (query_id, rank, doc_id, score): exact, the query's own id left out.

    Queries and vectors meet in blocks of BLOCK rows, a matrix product for each
    SLICE of its queries; a block returns k rows a query at most.
    """
    check_top_k(k)
    parts = [max(1, -(-t.count() // BLOCK)) for t in (vectors, queries)]
    cut = (lambda c: F.slice(c, 1, dims)) if dims else F.col
    deal = lambda t, i, n: t.withColumn("p", F.pmod(F.xxhash64(i), F.lit(n)))
    left = deal(vectors.select("doc_id", cut("v").alias("v")), "doc_id", parts[0]).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(parts[1] - 1)).cast("array<bigint>")))
    right = deal(queries.select("query_id", cut("v").alias("v")), "query_id", parts[1]).withColumnRenamed("p", "q").withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts[0] - 1)).cast("array<bigint>")))

    def block(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, asked = a.column("doc_id").to_numpy(), b.column("query_id").to_numpy()
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if len(ids) and len(asked):
            x, y = (np.array(t.column("v").to_pylist(), np.float64) for t in (a, b))
            parts = [ranked(ids, x, asked[i : i + SLICE], y[i : i + SLICE]) for i in range(0, len(asked), SLICE)]
            out = [np.concatenate(c) for c in zip(*parts, strict=True)]
        return pa.table(dict(zip(("query_id", "doc_id", "score"), out, strict=True)))

    def ranked(ids: np.ndarray, x: np.ndarray, asked: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        s = y @ x.T / (np.sqrt((y * y).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None])
        s = np.floor(np.abs(s) * 1e6 + 0.5) / 1e6 * np.sign(s)
        s[asked[:, None] == ids[None]] = -np.inf
        order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
        i = np.repeat(np.arange(len(asked)), order.shape[1])
        found = s[i, order.ravel()]
        fit = np.isfinite(found)
        return [asked[i][fit], ids[order.ravel()][fit], found[fit]]

    found = left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInArrow(block, "query_id long, doc_id long, score double")
    return top(found, k).select("query_id", "rank", "doc_id", "score")


def rrf(runs: Mapping[str, DataFrame], k: int, constant: int = RRF_K) -> DataFrame:
    """Fuse runs(query_id, rank, doc_id) by reciprocal rank -> (query_id, rank, doc_id, score, one rank column a run).

    Each list is cut to max(k, 50) first; ties go by corpus order.
    """
    most = max(check_top_k(k), CANDIDATES)
    ranked = [run.where(F.col("rank") <= most).select("query_id", "doc_id", F.lit(name).alias("system"), "rank") for name, run in runs.items()]
    every = ranked[0]
    for other in ranked[1:]:
        every = every.unionAll(other)
    ranks = [F.max(F.when(F.col("system") == name, F.col("rank"))).alias(f"{name}_rank") for name in runs]
    fused = every.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.lit(1.0) / (constant + F.col("rank"))), 6).alias("score"), *ranks)
    return top(fused, k).select("query_id", "rank", "doc_id", "score", *[f"{name}_rank" for name in runs])


def payload(chunks: DataFrame, documents: DataFrame, fields: Mapping[str, str], key: str = "document_id") -> DataFrame:
    """Chunks without their text, with document fields beside them (missing document: null)."""
    own = documents.select(F.col(key), *[F.col(c).alias(name) for name, c in fields.items()])
    return chunks.drop("text").join(own, key, "left")


def orphans(chunks: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    return chunks.join(documents.select(key).distinct(), key, "left_anti")


def verified(results: DataFrame, text_col: str = "text", hash_col: str = "text_hash") -> Column:
    return text_hash(F.col(text_col)) == F.col(hash_col)


def location(page: Column, slide: Column) -> Column:
    """p.N or slide N, null where a chunk has neither."""
    return F.when(page.isNotNull(), F.concat(F.lit("p."), page)).when(slide.isNotNull(), F.concat(F.lit("slide "), slide))


def snippet(text: Column, most: int = 160) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.char_length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("..."))).otherwise(flat)
