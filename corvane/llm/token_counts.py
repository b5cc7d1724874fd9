"""Token counts by offset-mapped attribution.

A whole document is encoded once.  The pieces of a byte-level vocabulary, joined, are the document's bytes, so running
sums of piece lengths are the tokens' spans; an interval join (binary search of the span ends in the section ends)
brings each token to its section.  A token over a boundary goes by RULE: ``largest`` - to the section with most of
its bytes, the earlier on a tie (default); ``first`` or ``last`` - to that of its first or last byte.

Sections are the document's lines, each with its line end, unless a column of (name, start, end) character spans is
given; spans are sorted, don't overlap, and what they leave out is counted under the section -1.

Defined cases: a null or empty text has one empty line with no tokens; rows that repeat an id are rows of their own; a
null id stays null; strings that name special tokens are ordinary text; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._shared import small_batches

RULES = ("largest", "first", "last")


class ByteEncoder:
    """A tiktoken vocabulary with the byte length of every piece."""

    def __init__(self, path: str, pattern: str) -> None:
        import base64

        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.lengths[list(ranks.values())] = list(map(len, ranks))

    def ends(self, text: str) -> np.ndarray:
        """The byte position at which each token of text ends."""
        return np.cumsum(self.lengths[np.array(self.encoding.encode_ordinary(text), np.int64)])


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens by their ends, sections by theirs (both from byte 0) -> tokens and crossing tokens of each section."""
    starts = np.concatenate([[0], ends])[:-1]
    first, last = np.searchsorted(bounds, starts, side="right"), np.searchsorted(bounds, ends - 1, side="right")
    cross = np.flatnonzero(first != last)
    to = (last if rule == "last" else first).copy()
    if rule == "largest":
        for t in cross.tolist():
            edges = np.clip(np.concatenate([[starts[t]], bounds[first[t] : last[t]], [ends[t]]]), starts[t], ends[t])
            to[t] = first[t] + int(np.argmax(np.diff(edges)))
    return np.bincount(to, minlength=len(bounds)), np.bincount(to[cross], minlength=len(bounds))


def count_tokens(docs: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None, rule: str = "largest") -> DataFrame:
    """(doc_id, section, start, end, tokens, crossing): one row a section; start and end count characters."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def spans(data: bytes, given: list | None) -> tuple[list[str] | range, np.ndarray, np.ndarray]:
        """Names, and the byte and character ends of contiguous sections; gaps are sections of their own."""
        raw = np.frombuffer(data, np.uint8)
        chars = np.flatnonzero((raw & 0xC0) != 0x80)  # the byte at which each character starts
        if given is None:
            ends = np.append(np.flatnonzero(raw == 10) + 1, len(raw))
            return range(len(ends)), ends, np.searchsorted(chars, ends)
        names, ends, at = [], [], 0
        for x in sorted((x for x in given if x is not None), key=lambda x: (x["start"], x["end"])):
            start, end = max(at, x["start"]), min(len(chars), max(at, x["end"]))
            if start > at:
                names.append("-1")
                ends.append(start)
            names.append(str(x["name"]))
            ends.append(end)
            at = end
        if at < len(chars) or not names:
            names.append("-1")
            ends.append(len(chars))
        where = np.array(ends, np.int64)
        return names, np.append(chars, len(raw))[where], where

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteEncoder(vocab_path, pattern)
        for batch in small_batches(batches, 1, 2 << 20):
            rows, names, columns = [], [], [[], [], [], []]
            given = batch.column(2).to_pylist() if sections_col else [None] * batch.num_rows
            for i, (data, own) in enumerate(zip(batch.column(1).to_pylist(), given, strict=True)):
                data = data or b""
                labels, at, chars = spans(data, (own or []) if sections_col else None)
                counts, crossing = attribute(encoder.ends(data.decode()), at, rule)
                rows.append(np.full(len(at), i))
                names += map(str, labels)
                for out, x in zip(columns, (np.concatenate([[0], chars[:-1]]), chars, counts, crossing), strict=True):
                    out.append(x)
            ids = batch.column(0).take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(names, pa.string()), *[pa.array(np.concatenate(x).astype(np.int64)) for x in columns]], ["doc_id", "section", "start", "end", "tokens", "crossing"])

    inputs = [F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").cast("binary").alias("t"), *([F.col(sections_col).alias("s")] if sections_col else [])]
    return docs.select(*inputs).mapInArrow(run, "doc_id long, section string, start long, end long, tokens long, crossing long")
