"""Token ids in binary files of directly addressable codes.

An id is split into chunks, lowest bits first.  Level 1 of a file holds the first chunk of every id, and a bit map says
which ids go on; level 2 holds the second chunks of those, again with a bit map, and so on; the last level needs none.  A
rank directory (the bits set before each block of BLOCK bits) turns a position of one level into that of the next, so the
id at any position, or the ids of any range, are read without decoding what lies before.  Chunk widths are even, at most
16 bits, and chosen for each file by its ids' bit lengths: the smallest sum of chunks and bit maps over all splits.

A file holds whole documents in ascending (id, text hash) order with an index of ids and ends, and a checksum.  Layout, all
little-endian: HEAD (magic, documents, tokens, levels), for each level its width and length, the document ids (int64, NULL_ID
for null), their ends in the file (int64), for each level its chunks, and but for the last its bit map (bytes, low bit
first) and rank directory (int64); CRC-32 of all before.

Spark sorts the documents by ranges of ids; each task encodes its range and writes files of about FILE_TOKENS ids (a longer
document alone) below the shared folder.  Names are of one attempt each: a task that runs twice leaves a file that nothing
names, for the manifest, a table that Spark commits, lists each file once, with the ids before it.

Defined cases: a null or empty text has the end id alone; rows that repeat an id are documents of their own, by the hash of
their text; a null id comes last; strings that name special tokens are special tokens, as the tokenizers library
reads them; an empty table gives an empty manifest and no file; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm._shared import NULL_ID, id_column, materialise, shared_dir, small_batches
from corvane.llm.packing import encoder_for
from corvane.sources.listing import file_system

END_ID = 2
MAGIC = b"TOKDAC01"
HEAD, LEVEL, BLOCK, WIDEST = struct.Struct("<8sqqi"), struct.Struct("<iq"), 512, 16
FILE_TOKENS, RANGE_BYTES, TEXT_BYTES, RUN = 4 << 20, 8 << 20, 8 << 20, 1 << 18


def _pack(values: np.ndarray, width: int) -> bytes:
    """Values below 2^width, four at a time in width / 2 bytes."""
    groups = np.zeros((-(-len(values) // 4), 4), np.uint64)
    groups.ravel()[: len(values)] = values
    word = groups[:, 0].copy()
    for j in range(1, 4):
        word |= groups[:, j] << np.uint64(j * width)
    return word.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : width // 2].tobytes()


def _unpack(data: np.ndarray, width: int, start: int, end: int) -> np.ndarray:
    """Values start to end of packed bytes."""
    low, high = start // 4, -(-end // 4)
    wide = np.zeros((high - low, 8), np.uint8)
    wide[:, : width // 2] = data[low * (width // 2) : high * (width // 2)].reshape(-1, width // 2)
    word = wide.view("<u8").ravel()
    mask = np.uint64((1 << width) - 1)
    out = np.stack([(word >> np.uint64(j * width)) & mask for j in range(4)], 1).ravel()
    return out[start - 4 * low : end - 4 * low]


def widths_for(lengths: np.ndarray) -> list[int]:
    """Chunk widths of the smallest code, given how many ids have each bit length (0 counts as 1)."""
    going = np.append(np.cumsum(lengths[::-1])[::-1], 0)  # ids of at least so many bits
    longest = max(1, int(np.flatnonzero(lengths).max(initial=1)))
    best: dict[int, tuple[float, list[int]]] = {}
    for at in range(longest - 1, -1, -1):
        here = going[at + 1] if at else going[0]
        options = []
        for width in range(2, WIDEST + 1, 2):
            rest = best.get(at + width, (0, []))
            options.append((here * (width + (1 + 64 / BLOCK if at + width < longest else 0)) + rest[0], [width, *rest[1]]))
        best[at] = min(options)
    return best[0][1]


def encode(doc_ids: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> bytes:
    """A file of the documents whose ids end at ``ends``."""
    if len(ids) and ids.max() < 1 << 20:  # lengths of the few different ids
        lengths = np.bincount(np.frexp(np.arange(1 << 20, dtype=np.float64))[1], np.bincount(ids, minlength=1 << 20), minlength=33)
    else:
        lengths = np.bincount(np.frexp(ids.astype(np.float64))[1], minlength=33).astype(float)
    lengths[1] += lengths[0]
    lengths[0] = 0
    rest, levels = ids, []
    widths = widths_for(lengths)
    for i, width in enumerate(widths):
        chunks, rest = rest & np.uint32((1 << width) - 1), rest >> np.uint32(width)
        parts = [_pack(chunks, width)]
        if i < len(widths) - 1:
            on = rest > 0
            padded = np.zeros(-(-len(on) // BLOCK) * BLOCK, bool)
            padded[: len(on)] = on
            ranks = np.concatenate([[0], np.cumsum(padded.reshape(-1, BLOCK).sum(1))])
            parts += [np.packbits(padded, bitorder="little").tobytes(), ranks.astype("<i8").tobytes()]
            rest = rest[on]
        levels.append((width, len(chunks), parts))
    out = [HEAD.pack(MAGIC, len(doc_ids), len(ids), len(levels)), *[LEVEL.pack(w, n) for w, n, _ in levels]]
    out += [doc_ids.astype("<i8").tobytes(), ends.astype("<i8").tobytes(), *[p for _, _, parts in levels for p in parts]]
    body = b"".join(out)
    return body + struct.pack("<I", zlib.crc32(body))


class TokenFile:
    """A file's bytes (or a memory map of it), read in place."""

    def __init__(self, data: bytes | memoryview, check: bool = True) -> None:
        held = np.frombuffer(data, np.uint8)
        if len(held) < HEAD.size + 4 or bytes(held[:8]) != MAGIC:
            raise ValueError("not a token file")
        if check and zlib.crc32(held[:-4]) != struct.unpack("<I", held[-4:].tobytes())[0]:
            raise ValueError("the token file is damaged")
        _, documents, self.tokens, levels = HEAD.unpack(held[: HEAD.size].tobytes())
        at = HEAD.size
        sizes = [LEVEL.unpack(held[at + i * LEVEL.size : at + (i + 1) * LEVEL.size].tobytes()) for i in range(levels)]
        at += levels * LEVEL.size

        def take(n: int, kind: str = "u1") -> np.ndarray:
            nonlocal at
            part = held[at : at + n]
            at += n
            return part if kind == "u1" else np.frombuffer(part.tobytes(), kind)

        self.doc_ids, self.ends = take(8 * documents, "<i8"), take(8 * documents, "<i8")
        self.levels = []
        for i, (width, n) in enumerate(sizes):
            chunks, last, blocks = take(-(-n // 4) * (width // 2)), i == levels - 1, -(-n // BLOCK)
            self.levels.append((width, chunks, None if last else take(blocks * BLOCK // 8), None if last else take(8 * (blocks + 1), "<i8")))

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, at: int) -> int:
        """Bits set before position ``at``."""
        block = at // BLOCK
        inside = np.unpackbits(bits[block * BLOCK // 8 : -(-at // 8)], bitorder="little")[: at - block * BLOCK]
        return int(ranks[block]) + int(inside.sum())

    def token(self, at: int) -> int:
        """The id at a position."""
        if not 0 <= at < self.tokens:
            raise IndexError(at)
        out = shift = 0
        for width, chunks, bits, ranks in self.levels:
            out |= int(_unpack(chunks, width, at, at + 1)[0]) << shift
            if bits is None or not bits[at >> 3] >> (at & 7) & 1:
                break
            at, shift = self._rank(bits, ranks, at), shift + width
        return out

    def range(self, start: int, end: int) -> np.ndarray:
        """The ids at positions start to end."""
        if not 0 <= start <= end <= self.tokens:
            raise IndexError((start, end))
        out, where, shift = np.zeros(end - start, np.uint32), None, 0
        for width, chunks, bits, ranks in self.levels:
            if start == end:
                break
            found = _unpack(chunks, width, start, end).astype(np.uint32) << np.uint32(shift)
            if where is None:
                out = found
            else:
                out[where] |= found
            if bits is None:
                break
            on = np.unpackbits(bits[start >> 3 : -(-end // 8)], bitorder="little")[start & 7 :][: end - start].view(bool)
            where = np.flatnonzero(on) if where is None else where[on]
            start = self._rank(bits, ranks, start)
            end, shift = start + int(on.sum()), shift + width
        return out

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(document id, position, ids) of each document; neighbours are read together, some RUN ids at a time."""
        first = 0
        while first < len(self.ends):
            at = start = int(self.ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(self.ends, start + RUN, side="right")))
            held = self.range(start, int(self.ends[last - 1]))
            for doc, end in zip(self.doc_ids[first:last].tolist(), self.ends[first:last].tolist(), strict=True):
                yield doc, at, held[at - start : end - start]
                at = end
            first = last


def _read(uri: str, check: bool = True) -> TokenFile:
    store, path = file_system(uri)
    with store.open_input_file(path) as source:
        return TokenFile(source.read(), check)


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Record batches put together to about ``most`` bytes: words that they share are looked up once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= most:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def write_files(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, folder: str | None = None, file_tokens: int = FILE_TOKENS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Write the files and return their manifest, itself written: (part, number, path, start, documents, tokens)."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/corvane/tokens-{uuid.uuid4().hex}"
    rows = docs.select(id_column(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("t"))
    held = rows.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    hashed = rows.withColumn("h", F.xxhash64("t"))
    sorted_ = hashed.repartitionByRange(max(1, -(-held // range_bytes)), "id", "h").sortWithinPartitions("id", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(folder)
        encoder, part, number = encoder_for(vocab_path), TaskContext.get().partitionId(), 0
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal number, kept
            docs_, sizes, ids = (np.concatenate(x) for x in zip(*kept, strict=True))
            name = f"{part:06d}-{number:06d}-{uuid.uuid4().hex}.tok"
            store.create_dir(base, recursive=True)
            with store.open_output_stream(f"{base}/{name}") as out:
                out.write(encode(docs_, np.cumsum(sizes), ids))
            row = {"part": [part], "number": [number], "path": [f"{folder}/{name}"], "documents": [len(docs_)], "tokens": [len(ids)]}
            kept, number = [], number + 1
            return pa.RecordBatch.from_pydict(row)

        for batch in small_batches(gathered(batches, TEXT_BYTES), 1, TEXT_BYTES):
            ids, ends = encoder.encode(batch.column(1).cast(pa.string()))
            closed = np.insert(ids, ends, np.uint32(end_id))
            kept.append((batch.column(0).to_numpy(), np.diff(ends, prepend=0) + 1, closed))
            if sum(len(x[2]) for x in kept) >= file_tokens:
                yield flush()
            pa.default_memory_pool().release_unused()
        if kept:
            yield flush()

    files = materialise(sorted_.select("id", "t").mapInArrow(run, "part long, number long, path string, documents long, tokens long"))
    # a row for each range first, so that no task sums over all files
    ranges = files.groupBy("part").agg(F.sum("tokens").alias("n"))
    before = ranges.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("tokens").over(Window.partitionBy("part").orderBy("number")) - F.col("tokens")
    return materialise(files.join(before, "part").select("part", "number", "path", (F.col("before") + inside).alias("start"), "documents", "tokens"))


def read_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files, a file at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = _read(path)
                rows: list[tuple[int, int, int]] = []
                held = []
                for _, at, ids in file.documents():
                    rows.append((start + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if with_ids:
                        held.append(ids.astype(np.int32))
                table = np.array(rows, np.int64).reshape(-1, 3)
                columns = [pa.array(file.doc_ids, mask=file.doc_ids == NULL_ID), *[pa.array(table[:, k]) for k in range(3)]]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(held, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return manifest.select("path", "start").repartition(manifest.count() or 1, F.xxhash64("path")).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def token_range(manifest: DataFrame, start: int, end: int) -> np.ndarray:
    """The ids at global positions start to end, read from the files that hold them alone (a loader's view)."""
    if not 0 <= start <= end:
        raise IndexError((start, end))
    found = manifest.where((F.col("start") < end) & (F.col("start") + F.col("tokens") > start)).orderBy("start").select("path", "start", "tokens").collect()
    parts = [_read(f.path, check=False).range(max(0, start - f.start), min(f.tokens, end - f.start)) for f in found]
    return np.concatenate([np.zeros(0, np.uint32), *parts])
