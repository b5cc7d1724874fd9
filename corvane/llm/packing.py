"""Packing by power-of-two decomposition: no padding, and no sequence crosses documents.

A document's n ids are cut, from its start, into as many pieces of the full length as fit and then into the powers of
two of the rest's binary form, largest first.  Pieces of equal length form a bucket; each piece is a sequence of its
bucket, whose length is a power of two, so batches drawn from one bucket need no padding at all.

Ids come from a tokenizers file whose pre-tokeniser never joins text across ASCII white space, so a document's ids are
those of its white-space-separated parts in order; each distinct part is encoded once for many documents.  Texts go
through the encoder some megabytes at a time (one whole text at least).

Defined cases: a null or empty text has the end id alone (one piece of length 1); rows that repeat an id are packed as
rows of their own; a null id stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import gc
import os
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._shared import buckets_for, materialise, ranked, small_batches

LENGTH = 2048
END_ID = 1
KEPT_PARTS = 400_000
#: Marks that may follow a word.
MARKS = '.,;:!?"#$%&)*'


class PartEncoder:
    """Encodes texts part by part and remembers parts as a stem and a tail of marks, whose ids are those of both.

    The pre-tokeniser always cuts between a letter and a mark, and lower-cases, so parts that differ in capitals or in
    the marks after the word share their stem's ids.  A stem of letters that the normaliser leaves as it is goes to
    the tokenizer's model directly, in its byte alphabet.  What is remembered is bounded: beyond KEPT_PARTS parts, those
    met in the most slices stay (half of the bound at most, no part met once) and the others are forgotten.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        spare = iter(range(256, 512))  # the alphabet: printable Latin-1 bytes stand for themselves
        own = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.alphabet = {i: chr(i if i in own else next(spare)) for i in range(256)}
        self._clear()

    def _clear(self) -> None:
        self.parts: dict[str, int] = {}
        self.pairs = np.zeros((0, 2), np.int64)  # of each part: its stem and its tail
        self.units: dict[str, int] = {"": 0}
        self.ids, self.starts = np.zeros(0, np.uint32), np.zeros(2, np.int64)
        self.met = np.zeros(0, np.int32)  # of each part: slices that had it

    def _forget(self) -> None:
        least = 2
        while (stay := self.met >= least).sum() > KEPT_PARTS // 2:
            least += 1
        used, pairs = np.unique(np.append(self.pairs[stay].ravel(), 0), return_inverse=True)
        keep = np.zeros(len(self.units), bool)
        keep[used] = True
        sizes = np.diff(self.starts)
        self.parts = {p: i for i, p in enumerate(compress(self.parts, stay))}
        self.units = {u: i for i, u in enumerate(compress(self.units, keep))}
        self.pairs, self.met = pairs[:-1].reshape(-1, 2), np.ones(len(self.parts), np.int32)
        self.ids, self.starts = self.ids[np.repeat(keep, sizes)], np.concatenate([[0], np.cumsum(sizes[keep])])

    @staticmethod
    def _cut(part: str) -> tuple[str, str]:
        stem = part.rstrip(MARKS)
        if not stem or len(stem) == len(part):
            return part, ""
        last = stem[-1]
        if not last.isascii():  # what the normaliser makes of the last letter must end with a letter
            last = unicodedata.normalize("NFC", last).lower()[-1]
        return (stem, part[len(stem) :]) if last.isalpha() else (part, "")

    def _ids(self, units: list[str]) -> list[list[int]]:
        found: list = [None] * len(units)
        rest = []
        for i, u in enumerate(units):
            if u.isalpha() and (u.isascii() or unicodedata.is_normalized("NFC", u)) and u == u.lower():
                found[i] = [t.id for t in self.model.tokenize(u if u.isascii() else u.encode().decode("latin-1").translate(self.alphabet))]
            else:
                rest.append(i)
        for i, x in zip(rest, self.tokenizer.encode_batch_fast([units[i] for i in rest], add_special_tokens=False), strict=True):
            found[i] = x.ids
        return found

    def _learn(self, parts: list[str]) -> None:
        cuts = [self._cut(p) for p in parts]
        new = list(dict.fromkeys(u for c in cuts for u in c if u not in self.units))
        found = self._ids(new)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.units.update(zip(new, range(len(self.units), len(self.units) + len(new)), strict=True))
        pairs = np.fromiter(map(self.units.__getitem__, chain.from_iterable(cuts)), np.int64, 2 * len(cuts))
        self.pairs = np.concatenate([self.pairs, pairs.reshape(-1, 2)])
        self.met = np.concatenate([self.met, np.zeros(len(parts), np.int32)])
        self.parts.update(zip(parts, range(len(self.parts), len(self.parts) + len(parts)), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the position at which each text's ids end."""
        texts = texts.fill_null("")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # a special token's string is told by its case
            texts = pc.ascii_lower(texts)
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.parts) > KEPT_PARTS:
            self._forget()
        gc.disable()  # many small objects that all stay
        try:
            if new := [p for p in distinct if p not in self.parts]:
                self._learn(new)
        finally:
            gc.enable()
        own = np.fromiter(map(self.parts.__getitem__, distinct), np.int64, len(distinct))
        self.met[own] += 1
        units = self.pairs[own[coded.indices.to_numpy()]].ravel()
        starts = self.starts[units]
        sizes = self.starts[units + 1] - starts
        ends = np.cumsum(sizes)
        where = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)
        offsets = split.offsets.to_numpy()
        return self.ids[where], np.concatenate([[0], ends])[2 * (offsets[1:] - offsets[0])]


@lru_cache(maxsize=1)
def encoder_for(path: str) -> PartEncoder:
    """One encoder a Python worker, which serves task after task."""
    return PartEncoder(path)


def binary_lengths(n: int, longest: int) -> list[int]:
    rest = n % longest
    return [longest] * (n // longest) + [1 << i for i in range(longest.bit_length() - 1, -1, -1) if rest >> i & 1]


def pieces(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", longest: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): the binary-length pieces of every document."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(vocab_path)
        for batch in small_batches(batches, 1, 2 << 20):
            ids, ends = encoder.encode(batch.column(1).cast(pa.string()))
            rows: list[tuple[int, int, int, int, int]] = []
            held, at = [], 0
            for i, to in enumerate(ends.tolist()):
                own = np.append(ids[at:to], np.uint32(end_id)).astype("<u4")
                at, start = to, 0
                for n in binary_lengths(len(own), longest):
                    piece = own[start : start + n]
                    rows.append((i, start, n, zlib.crc32(piece.tobytes()), len(own)))
                    if with_ids:
                        held.append(piece.astype(np.int32))
                    start += n
            table = np.array(rows, np.int64).reshape(-1, 5)
            columns = [batch.column(0).take(pa.array(table[:, 0])), *[pa.array(table[:, k]) for k in range(1, 5)]]
            if with_ids:
                columns.append(pa.array(held, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(zip([x.split()[0] for x in schema.split(", ")], [c.type for c in columns], strict=True))))
            pa.default_memory_pool().release_unused()

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").cast("binary").alias("t")).mapInArrow(run, schema)


def pack(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", longest: int = LENGTH, end_id: int = END_ID, seed: int = 5, with_ids: bool = False) -> DataFrame:
    """pieces() plus sequence_id and offset: sequences are numbered from 0, longest bucket first, seeded order within."""
    found = materialise(pieces(docs, vocab_path, id_col, text_col, longest, end_id, with_ids))
    buckets = buckets_for(found.count())
    hashed = found.withColumn("__h", F.xxhash64(F.lit(seed), "doc_id", "start")).withColumns({"__shorter": -F.col("length"), "__bucket": F.pmod("__h", F.lit(buckets))})
    placed = ranked(hashed, [], ["__shorter", "__bucket"], [F.col("__h"), F.col("doc_id"), F.col("start"), F.col("ids_crc32")])
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("__rank").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *["ids"] * with_ids)
