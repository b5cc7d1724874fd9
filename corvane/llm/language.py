"""Language ID by Bayesian evidence fusion.

* Text: naive Bayes over hashed letter trigrams of the whole text, fitted here on a bounded sample of labelled rows
  (SAMPLE rows in all, chosen by a hash of the id, and about EACH of any language that would have fewer; a language
  needs LEAST rows in the whole table).  Trigrams of one text depend on each
  other, so n of them weigh as n / (1 + n / EVIDENCE).  A background model, letters drawn independently, stands for
  text in no known language (``und``).
* Declared language: P(declared | language), from soft counts over all rows, grouped by the declared value.
* Address: priors smoothed down a hierarchy - all rows, address suffix, domain, host - each level's counts added to
  its parent's distribution with weight KAPPA.

A row's own text is taken out of all these counts, so it counts once: a host or a declared value met once says nothing.

Counts are sums of text posteriors over all rows, by grouped aggregation that is combined before the shuffle; rows
meet them in ordinary joins on small rows (no text), whose large partitions Spark can split.

A row is accepted unless its text has no letter trigram or ``und`` is the most probable.  Defined cases: a null or
empty text is ``und``, not accepted; a null declared language, url or host is a value of its own; rows that repeat an
id are rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm._shared import materialise, small_batches

SAMPLE, EACH, LEAST = 4000, 150, 20
CODES = 1 << 16
EVIDENCE = 200.0
KAPPA = 20.0
UND_PRIOR = 0.01
PIECE = 1 << 20
REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?")
#: Bytes that are not letters are read as a space; bytes of other characters than ASCII count as letters.
LETTERS = bytes(i if i >= 128 or 97 <= i <= 122 else 32 for i in range(256))


def trigrams(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(codes, bytes, text position) of all letter trigrams: three bytes, not all spaces, in one text; a MB of text at a time."""
    pieces: list[tuple[int, bytes]] = []
    held = 0
    for i, text in enumerate(texts):
        clean = b" " + (text or b"").decode().lower().encode().translate(LETTERS) + b" "
        for at in range(0, len(clean) - 2, PIECE):
            pieces.append((i, clean[at : at + PIECE + 2]))
            held += len(pieces[-1][1])
            if held >= PIECE:
                yield _codes(pieces)
                pieces, held = [], 0
    if pieces:
        yield _codes(pieces)


def _codes(pieces: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.fromiter((len(x) for _, x in pieces), np.int64, len(pieces))
    raw = np.frombuffer(b"".join(x for _, x in pieces), np.uint8).astype(np.uint32)
    piece = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
    code = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    fit = (piece[:-2] == piece[2:]) & (raw[1:-1] != 32)
    mixed = (code[fit] * np.uint32(0x9E3779B1)) >> np.uint32(16)
    whose = np.array([i for i, _ in pieces], np.int32)
    return mixed.astype(np.int64), raw[1:-1][fit].astype(np.int64), whose[piece[:-2][fit]]


class TrigramModel:
    """Log-probabilities of codes in each language, and of letters in the background model."""

    def __init__(self, languages: list[str], tables: np.ndarray, letters: np.ndarray) -> None:
        self.languages = languages
        smooth = 0.5
        self.logs = np.log((tables + smooth) / (tables.sum(1, keepdims=True) + smooth * CODES)).astype(np.float32)
        p = (letters + 1.0) / (letters.sum() + 256.0)
        self.letter = np.log(p)
        self.around = float((p * self.letter).sum())

    def scores(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Weighted log-likelihoods (texts x languages and und last), and trigrams of each text."""
        n, out = np.zeros(len(texts)), np.zeros((len(texts), len(self.languages) + 1))
        for code, letter, whose in trigrams(texts):
            n += np.bincount(whose, minlength=len(texts))
            for k, log in enumerate(self.logs):
                out[:, k] += np.bincount(whose, weights=log[code], minlength=len(texts))
            out[:, -1] += np.bincount(whose, weights=self.letter[letter] + 2 * self.around, minlength=len(texts))
        return out / np.maximum(n, 1)[:, None] * (n / (1 + n / EVIDENCE))[:, None], n


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE) -> TrigramModel:
    """Fit on about ``sample`` labelled rows and EACH of every language (or all it has), drawn by id and text, so ids that
    are null or repeat do not matter; wholly equal rows are one.  The driver gets counts, bounded by codes and languages,
    never texts."""
    labelled = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.lower(F.col(label_col).cast("string")).alias("lang"), F.col(text_col).cast("string").alias("t"), F.xxhash64(F.lit(23), id_col, F.col(text_col).cast("string")).alias("h"))
    counts = materialise(labelled.groupBy("lang").agg(F.count(F.lit(1)).cast("double").alias("n")))
    rows = max(1, int(counts.agg(F.sum("n")).first()[0] or 0))
    enough = counts.where(F.col("n") >= min(LEAST, max(1, rows // 50)))
    languages = sorted(r[0] for r in enough.select("lang").collect())
    drawn = materialise(labelled.join(F.broadcast(enough), "lang").where(F.pmod("h", F.lit(rows)) < F.greatest(F.lit(float(sample)), EACH * F.lit(float(rows)) / F.col("n"))).dropDuplicates(["lang", "h"]).select("lang", "t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1, 1 << 20):
            own = np.array(batch.column(0).to_pylist(), dtype=object)
            for lang in sorted(set(own) & set(languages)):
                counts, letters = np.zeros(CODES, np.int64), np.zeros(256, np.int64)
                for code, letter, _ in trigrams(batch.column(1).filter(pa.array(own == lang)).to_pylist()):
                    counts += np.bincount(code, minlength=CODES)
                    letters += np.bincount(letter, minlength=256)
                at, to = np.flatnonzero(counts), np.flatnonzero(letters)
                keys = np.concatenate([at, CODES + to])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(np.concatenate([counts[at], letters[to]]))], ["lang", "code", "n"])

    table = drawn.select("lang", F.col("t").cast("binary").alias("t")).mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted({*languages} & set(table.column("lang").to_pylist()))  # one that drew no trigram has no model, and none is accepted as it
    counts, letters = np.zeros((len(languages), CODES)), np.zeros(256)
    lang, code, n = (np.array(table.column(k).to_pylist()) for k in ("lang", "code", "n"))
    for k, name in enumerate(languages):
        own = lang == name
        counts[k][code[own & (code < CODES)].astype(int)] = n[own & (code < CODES)]
        np.add.at(letters, code[own & (code >= CODES)].astype(int) - CODES, n[own & (code >= CODES)])
    return TrigramModel(languages, counts, letters)


def identify(rows: DataFrame, model: TrigramModel) -> DataFrame:
    """rows(id, text, declared, suffix, domain, host) -> (id, n, lang, probability, accepted); n are trigrams."""
    names = [*model.languages, "und"]
    each = range(len(names))
    levels = ["suffix", "domain", "host"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1, 1 << 20):
            scores, n = model.scores(batch.column(1).to_pylist())
            alike = scores + np.log([(1 - UND_PRIOR) / max(1, len(names) - 1)] * (len(names) - 1) + [UND_PRIOR])
            soft = np.exp(alike - alike.max(1, keepdims=True))
            soft /= soft.sum(1, keepdims=True)
            rest = [batch.column(k) for k in range(2, 6)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *rest, pa.array(n.astype(np.int64)), *[pa.array(x[:, k]) for x in (scores, soft) for k in each]], schema=None, names=["id", "declared", *levels, "n", *[f"s{k}" for k in each], *[f"p{k}" for k in each]])

    kinds = ", ".join(f"{x}{k} double" for x in "sp" for k in each)
    text = F.col("text").cast("string").cast("binary").alias("t")
    plain = [F.coalesce(F.lower(F.col(c).cast("string")), F.lit("")).alias(c) for c in ("declared", *levels)]
    scored = materialise(rows.select(F.col("id").cast("long").alias("id"), text, *plain).mapInArrow(run, f"id long, declared string, suffix string, domain string, host string, n long, {kinds}"))
    sums = lambda by, mark: scored.groupBy(*by).agg(F.count(F.lit(1)).alias(f"{mark}n"), *[F.sum(f"p{k}").alias(f"{mark}{k}") for k in each])
    whole = sums([], "a").first()
    count = max(1, whole["an"])
    # priors down the hierarchy: a table of hosts with the counts of their domain and suffix beside them
    host = sums(["suffix", "domain", "host"], "h")
    domain = host.groupBy("suffix", "domain").agg(F.sum("hn").alias("dn"), *[F.sum(f"h{k}").alias(f"d{k}") for k in each])
    suffix = domain.groupBy("suffix").agg(F.sum("dn").alias("xn"), *[F.sum(f"d{k}").alias(f"x{k}") for k in each])
    prior = materialise(host.join(domain, ["suffix", "domain"]).join(suffix, "suffix"))
    said = materialise(sums(["declared"], "c"))
    joined = scored.join(prior, ["suffix", "domain", "host"]).join(said, "declared")
    for k in each:
        rest = lambda mark, k=k: F.greatest(F.col(f"{mark}{k}") - F.col(f"p{k}"), F.lit(0.0))
        all_k = F.lit(float(whole[f"a{k}"] or 0.0)) - F.col(f"p{k}")
        own = (F.greatest(all_k, F.lit(0.0)) + 1.0) / (count - 1 + len(names))
        for mark in "xdh":
            own = (rest(mark) + KAPPA * own) / (F.col(f"{mark}n") - 1 + KAPPA)
        says = (rest("c") + 0.5) / (F.greatest(all_k, F.lit(0.0)) + 50.0)
        joined = joined.withColumn(f"l{k}", F.col(f"s{k}") + F.log(F.greatest(own, F.lit(1e-12))) + F.log(says))
    top = F.greatest(*[F.col(f"l{k}") for k in each]) if len(names) > 1 else F.col("l0")
    odds = joined.withColumn("top", top)
    total = sum((F.exp(F.col(f"l{k}") - F.col("top")) for k in each), F.lit(0.0))
    lang = F.coalesce(*[F.when(F.col(f"l{k}") == F.col("top"), F.lit(name)) for k, name in enumerate(names)])
    known = F.col("n") > 0
    return odds.select("id", "n", F.when(known, lang).otherwise("und").alias("lang"), F.when(known, 1 / total).otherwise(0.0).alias("probability")).withColumn("accepted", F.col("lang") != "und")


def page_evidence(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Evidence of web pages: text without markup, the language that <html> declares, and the parts of the address."""
    from corvane.llm.html_extract import host_of

    page = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(page, r"(?is)<(script|style)\b.*?(</\1\s*>|$)|<!--.*?(-->|$)", " "), r"<[^>]*>?", " ")
    host = host_of(F.col(url_col))
    found = pages.select(F.col(id_col).cast("long").alias("id"), bare.cast("binary").alias("text"), F.regexp_extract(page, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]+)", 1).alias("declared"), F.regexp_extract(host, r"([^.]*)$", 1).alias("suffix"), F.regexp_extract(host, r"([^.]*\.[^.]*)$", 1).alias("domain"), host.alias("host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1, 1 << 20):
            texts = pa.array([decoded(t.decode()) for t in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, *batch.columns[2:]], batch.schema.names)

    return found.mapInArrow(run, "id long, text string, declared string, suffix string, domain string, host string")


def decoded(text: str) -> str:
    """Text with its character references as the letters they stand for; references to other characters are a space."""
    return REFERENCE.sub(_letters, text) if "&" in text else text


def _letters(found: re.Match) -> str:
    return "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in html.unescape(found[0]))


def document_evidence(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Evidence of plain documents: the stated language, and the source in place of a host; there is no address."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(declared_col).alias("declared"), F.lit("").alias("suffix"), F.lit("").alias("domain"), F.col(source_col).alias("host"))
