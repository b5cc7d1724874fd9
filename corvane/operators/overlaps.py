"""Sets of shingles that overlap, without a shuffle of all rows of shingles or of any pair.

Texts are hashed where they are read.  Their shingles are dealt out by ranges of the hash in packed form: of a sorted run
the steps from one to the next, of some 6 bytes, and 2 bytes for the text within its run.  Where a range comes together, shingles
of one text alone go.  Others that are in the same texts are one group with a weight, so a copied passage is one row, not
one for each of its shingles.

A set can only be the smaller of a pair if its groups weigh ``least`` of it.  Such sets, in blocks, meet blocks of all sets
as a Cartesian product of files, and a pair of blocks gives its pairs with exact overlaps.  A block holds a bounded number of
rows, and the work grows with the pairs that there are.  Groups of a set count in the order of how many texts have them:
if none of the rarest, of which one must be shared, is in a block, the set has no pair there.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.retrieval import CAPITALS
from corvane.sources.shared import fresh_path, small_arrow, stored

#: Bytes that are in words, as lower case; all others as a space.
PLAIN = bytes(ord(c) if (c := chr(i).lower()) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for i in range(128)) + b" " * 128
#: Shingles of a run, texts of it at most, shingles of a range, rows and sets of a block, blocks of a file, and incidences up
#: to which a set's are sorted with others' instead of counted over the block.
RUN, TEXTS, RANGE, ROWS, SETS, FILE_BLOCKS, FEW = 1 << 20, 1 << 16, 1 << 20, 1 << 19, 1 << 15, 2, 256
#: Incidences and sums of a stretch of sets that are counted at once, and those of one group that are counted by themselves.
CELLS, LONG = 1 << 19, 1024
#: Beyond all places of texts, so that no place has 0 as its share of a list's hash.
SALTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    for by in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64 bits of each word data[start : start + size]; up to 8 bytes no two are alike.  16 more bytes follow the last word."""

    def eight(at: np.ndarray, n: np.ndarray) -> np.ndarray:
        held = np.lib.stride_tricks.sliding_window_view(data, 8)[at].view(np.uint64).ravel()
        return np.where(n >= 8, held, held & ((np.uint64(1) << (np.minimum(n, 7) * 8).astype(np.uint64)) - np.uint64(1)))

    out = mixed(eight(start, size))
    longer = np.flatnonzero(size > 8)
    out[longer] = mixed(out[longer] + np.uint64(0x9E3779B97F4A7C15) * mixed(eight(start[longer] + 8, size[longer] - 8) + np.uint64(1)))
    for i in np.flatnonzero(size > 16):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : start[i] + size[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def shingle_hashes(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text) of the runs of k words of each text's plain form, repeated ones included; fewer words are one run."""
    plain = []
    for text in texts:
        for capital, small in CAPITALS.items():
            if capital in text:
                text = text.replace(capital, small)
        plain.append(text.translate(PLAIN))
    data = np.frombuffer(b" " + b" ".join(plain) + b" " * 24, np.uint8)
    word = data != 32
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    start, size = edge[0::2], edge[1::2] - edge[0::2]
    of = np.searchsorted(np.cumsum([len(p) + 1 for p in plain]), start, side="left")
    words = np.bincount(of, minlength=len(texts))
    at = np.arange(len(of)) - (np.cumsum(words) - words)[of]
    first = np.flatnonzero(at <= np.maximum(words[of] - k, 0))
    own, held = words[of[first]], np.concatenate([word_hashes(data, start, size), np.zeros(k, np.uint64)])
    by = mixed(np.arange(1, k + 2, dtype=np.uint64)) | np.uint64(1)
    out = np.minimum(own, k).astype(np.uint64) * by[k]
    for j in range(k):
        out += np.where(own > j, held[first + j] * by[j], np.uint64(0))
    return mixed(out), of[first]


def packed(g: np.ndarray, text: np.ndarray) -> bytes:
    """Sorted hashes with the texts that have them: steps of as many bytes as the longest needs, and 2 for the text."""
    step = np.diff(g, prepend=np.uint64(0))
    first, step[0] = step[0], 0
    wide = max(1, -(-int(step.max()).bit_length() // 8))
    return b"%c" % wide + first.tobytes() + text.astype("<u2").tobytes() + np.ascontiguousarray(step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide]).tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    wide, n = data[0], (len(data) - 9) // (data[0] + 2)
    step = np.zeros((n, 8), np.uint8)
    step[:, :wide] = np.frombuffer(data, np.uint8, n * wide, 9 + 2 * n).reshape(n, wide)
    return np.cumsum(step.view("<u8").ravel()) + np.frombuffer(data, "<u8", 1, 1), np.frombuffer(data, "<u2", n, 9)


@dataclass
class Sets:
    """texts(loc, doc_id, n, h, i): a row a text with shingles, n of them, h and i a key of equal sets; groups(sid, w, df,
    locs): w shingles that are in the same df texts."""

    texts: DataFrame
    groups: DataFrame


def shingle_sets(docs: DataFrame, k: int) -> Sets:
    """The sets of shingles of docs(doc_id, text), written once; texts without words are left out."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", F.col("text").cast("binary").alias("t")).where("t is not null")
    size = read.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    ranges, run_of, texts_of = max(1, min(1 << 16, math.ceil(size / 6 / RANGE))), RUN, TEXTS
    columns = ["part", "run", "data", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, hashes, of = TaskContext.get().partitionId() << 20, [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, ids, hashes, of
            held, g, text = pa.chunked_array(ids), np.concatenate(hashes), np.concatenate(of)
            order = np.argsort(g, kind="stable")  # texts stay in order, so what a text repeats is side by side
            g, text = g[order], text[order]
            new = np.concatenate([[True], (g[1:] != g[:-1]) | (text[1:] != text[:-1])])
            g, text = g[new], text[new]
            n, keys = np.bincount(text, minlength=len(held)), np.zeros((2, len(held)), np.uint64)
            for j in (0, 1):
                np.add.at(keys[j], text, mixed(g + np.uint64(j + 1)))
            some = np.flatnonzero(n)
            said = np.concatenate([x.view(np.int64) for x in (n[some].astype(np.int64), keys[0][some], keys[1][some], some)])
            yield batch_of(ranges + number % ranges, said.tobytes(), held.take(pa.array(some)))
            part = ((g >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            edge = np.flatnonzero(np.diff(part, prepend=np.uint64(1 << 40)))
            for a, b in zip(edge, [*edge[1:], len(g)], strict=True):
                yield batch_of(int(part[a]), packed(g[a:b], text[a:b]), None)
            number, ids, hashes, of = number + 1, [], [], []

        def batch_of(part: int, data: bytes, held: pa.ChunkedArray | None) -> pa.RecordBatch:
            every = pa.array([None], pa.list_(ids[0].type)) if held is None else pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), pa.concat_arrays(held.chunks))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([data], pa.binary()), every], columns)

        for batch in batches:
            for m in range(0, batch.num_rows, 2048):
                part = batch.slice(m, 2048)
                g, text = shingle_hashes([t.as_py() for t in part.column(1)], k)
                if ids and (sum(map(len, hashes)) + len(g) > run_of or sum(map(len, ids)) + part.num_rows > texts_of) and sum(map(len, hashes)):
                    yield from flush()
                elif ids and sum(map(len, ids)) + part.num_rows > texts_of:
                    ids, hashes, of = [], [], []  # texts without words alone
                hashes.append(g)
                of.append(text + sum(map(len, ids)))
                ids.append(part.column(0))
        if sum(map(len, hashes)):
            yield from flush()

    def meet(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        if part >= ranges:
            rows = []
            for number, data, held in zip(table.column("run"), table.column("data"), table.column("ids"), strict=True):
                n, h, i, at = np.frombuffer(data.as_py(), np.int64).reshape(4, -1)
                rows.append(pa.table({"loc": (number.as_py() << 16) + at, "doc_id": held.values, "n": n, "h": h, "i": i}))
            out = pa.concat_tables(rows)
            size = len(out)
            return pa.table({"k1": out["loc"], "k2": np.full(size, -1), "df": np.zeros(size, np.int64), "w": out["n"], "locs": pa.nulls(size, pa.binary()), "doc_id": out["doc_id"], "h": out["h"], "i": out["i"]})
        found = [(*unpacked(data.as_py()), number.as_py()) for number, data in zip(table.column("run"), table.column("data"), strict=True)]
        g, loc = np.concatenate([x[0] for x in found]), np.concatenate([(x[2] << 16) + x[1].astype(np.int64) for x in found])
        del found
        order = np.argsort(g)
        g, loc = g[order], loc[order]
        same = np.concatenate([[False], g[1:] == g[:-1], [False]])
        shared = same[1:] | same[:-1]
        g, loc = g[shared], loc[shared]
        order = np.lexsort((loc, g))
        g, loc = g[order], loc[order]
        edge = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
        df = np.diff(edge, append=len(g))
        one, two = ((np.add.reduceat(mixed(loc.view(np.uint64) ^ np.uint64(salt)), edge) if len(edge) else np.zeros(0, np.uint64)) for salt in SALTS)
        order = np.lexsort((two, one))
        new = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])]) if len(order) else np.zeros(0, bool)
        first, w = order[new], np.diff(np.flatnonzero(new), append=len(order))
        lists = [loc[a : a + n].tobytes() for a, n in zip(edge[first].tolist(), df[first].tolist(), strict=True)]
        none = len(first)
        return pa.table({"k1": one[first].view(np.int64), "k2": two[first].view(np.int64) & (2**63 - 1), "df": df[first], "w": w, "locs": pa.array(lists, pa.binary()), "doc_id": pa.nulls(none, table.schema.field("ids").type.value_type), "h": pa.nulls(none, pa.int64()), "i": pa.nulls(none, pa.int64())})

    with small_arrow(spark):
        dealt = read.mapInArrow(run, f"part int, run long, data binary, ids array<{kind}>")
        met = dealt.groupBy("part").applyInArrow(meet, f"k1 long, k2 long, df long, w long, locs binary, doc_id {kind}, h long, i long")
        # a group's parts, and each text alone: k2 of a text is -1
        made = stored(met.groupBy("k1", "k2").agg(F.max("df").alias("df"), F.sum("w").alias("w"), *[F.first(c).alias(c) for c in ("locs", "doc_id", "h", "i")]))
    return Sets(made.where("k2 = -1").select(F.col("k1").alias("loc"), "doc_id", F.col("w").alias("n"), "h", "i"), made.where("k2 >= 0").select(F.col("k1").alias("sid"), "w", "df", "locs"))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """groups -> a row for each text of each."""
    for batch in batches:
        df, loc = batch.column("df").to_numpy(), np.frombuffer(b"".join(x.as_py() for x in batch.column("locs")), np.int64)
        yield pa.RecordBatch.from_pydict({"loc": loc, **{c: np.repeat(batch.column(c).to_numpy(), df) for c in ("sid", "w", "df")}})


def _blocks(sets: DataFrame, by_group: bool) -> DataFrame:
    """sets(id, loc, n, m, gs) in blocks of bounded size, a row each; entries in the order of groups, or of sets and df."""
    kind, spark = sets.schema["id"].dataType.simpleString(), sets.sparkSession
    rows_of, sets_of, path = ROWS, SETS, fresh_path(sets.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        rows = 0

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(kept).combine_chunks()
            gs = table.column("gs").combine_chunks()
            sizes = np.diff(gs.offsets.to_numpy())
            entry, of = gs.flatten(), np.repeat(np.arange(len(sizes)), sizes)
            df, sid, w = (entry.field(c).to_numpy() for c in ("df", "sid", "w"))
            order = np.argsort(sid, kind="stable") if by_group else np.lexsort((sid, df, of))
            row = {"of": of.astype(np.int32), "sid": sid, "w": w.astype(np.int32), **{c: table.column(c).to_numpy() for c in ("loc", "n", "m")}}
            binary = {c: pa.array([(x[order] if c in ("of", "sid", "w") else x).tobytes()], pa.binary()) for c, x in row.items()}
            ids = table.column("id").combine_chunks()
            return pa.RecordBatch.from_pydict({"ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), **binary})

        for batch in batches:
            at = 0
            ends = np.cumsum(np.diff(batch.column("gs").offsets.to_numpy()))
            while at < batch.num_rows:
                base = ends[at - 1] if at else 0
                to = max(at + 1, min(int(np.searchsorted(ends, base + rows_of - rows, side="right")), at + sets_of - sum(b.num_rows for b in kept)))
                kept.append(batch.slice(at, to - at))
                rows, at = rows + int(ends[to - 1] - base), to
                if rows >= rows_of or at < batch.num_rows or sum(b.num_rows for b in kept) >= sets_of:
                    yield block()
                    kept, rows = [], 0
        if kept:
            yield block()

    made = sets.select("id", "loc", "n", "m", "gs").mapInArrow(run, f"ids array<{kind}>, of binary, sid binary, w binary, loc binary, n binary, m binary")
    with small_arrow(spark):
        made.write.option("maxRecordsPerFile", FILE_BLOCKS).parquet(path)  # a reader holds the blocks of a file at once
    return spark.read.schema(made.schema).parquet(path)


class Block:
    """A block read: sets with their ids, places, sizes and members, and entries with the set, group and weight of each."""

    def __init__(self, columns: list[pa.Scalar]) -> None:
        self.ids = columns[0].values
        self.of, self.sid, self.w, self.loc, self.n, self.m = (np.frombuffer(x.as_py(), np.int32 if k in (0, 2) else np.int64) for k, x in enumerate(columns[1:]))


class Small(Block):
    """A block of sets that can be the smaller: the groups that it has, and which entries are a set's rarest."""

    def __init__(self, columns: list[pa.Scalar], least: float) -> None:
        super().__init__(columns)
        self.groups, self.group = np.unique(self.sid, return_inverse=True)
        self.need = np.ceil(self.n * least - 1e-9)
        self.rare = _rarest(self.of, self.w, self.need)


def _rarest(of: np.ndarray, w: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Which entries are the rarest of their set: a set that has ``need`` of its shingles has one of them."""
    total = np.bincount(of, w, len(need))
    before = np.cumsum(w, dtype=np.int64) - w
    start = np.searchsorted(of, np.arange(len(need)))
    return before - before[start[of]] < (total - need + 1)[of]


def block_pairs(a: Small, b: Block, near: float, overlap: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of a, row of b, shingles in both) of similar sets, where a is the smaller (or, as large, the first)."""
    edge = np.flatnonzero(np.concatenate([[True], b.sid[1:] != b.sid[:-1]]))
    names, sizes = b.sid[edge], np.diff(edge, append=len(b.sid))
    found = np.minimum(np.searchsorted(names, a.groups), len(names) - 1)
    size = np.where(names[found] == a.groups, sizes[found], 0)[a.group]
    low = edge[found][a.group]
    active = np.zeros(len(a.n), bool)
    active[a.of[a.rare & (size > 0)]] = True
    at = np.flatnonzero(active[a.of] & (size > 0))
    of, low, size, w = a.of[at], low[at], size[at], a.w[at]
    met = np.bincount(of, size, len(a.n)).astype(np.int64)

    def kept(p: np.ndarray, q: np.ndarray, both: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fits = (a.n[p] < b.n[q]) | ((a.n[p] == b.n[q]) & (a.loc[p] < b.loc[q]))
        fits &= (both / (a.n[p] + b.n[q] - both) >= near) | (both / a.n[p] >= overlap)
        return p[fits], q[fits], both[fits]

    def spread(k: slice | np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = size[k]
        where = np.repeat(low[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(row, n), b.of[where], np.repeat(w[k], n)

    start, many, width = np.searchsorted(of, np.arange(len(a.n) + 1)), np.flatnonzero(met > FEW), len(b.n)
    cost, m = np.cumsum(met[many] + width), 0
    while m < len(many):  # counted over the block, some sets at a time
        to = max(m + 1, int(np.searchsorted(cost, (cost[m - 1] if m else 0) + CELLS, side="right")))
        sets = many[m:to]
        k = np.concatenate([np.arange(start[p], start[p + 1]) for p in sets])
        row = np.repeat(np.arange(len(sets)), start[sets + 1] - start[sets]) * width
        long = size[k] > LONG
        p, q, v = spread(k[~long], row[~long])
        both = np.bincount(p + q, v, len(sets) * width)
        for at, base in zip(k[long].tolist(), row[long].tolist(), strict=True):
            both[b.of[low[at] : low[at] + size[at]] + base] += w[at]  # a set has a group once
        hit = np.flatnonzero((both.reshape(-1, width) >= np.maximum(a.need[sets], 1)[:, None]).ravel())
        yield kept(sets[hit // width], hit % width, both[hit])
        m = to
    few = np.flatnonzero(met[of] <= FEW)
    of, low, size, w = of[few], low[few], size[few], w[few]
    ends = np.cumsum(size)
    m = 0
    while m < len(of):  # whole sets, about a million incidences at a time
        to = int(np.searchsorted(ends, (ends[m - 1] if m else 0) + (1 << 20), side="right"))
        to = int(np.searchsorted(of, of[min(max(to, m), len(of) - 1)], side="right"))
        p, q, v = spread(slice(m, to), of[m:to].astype(np.int64) * width)
        key = p + q
        order = np.argsort(key)
        key = key[order]
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        both = np.add.reduceat(v[order], edge)
        yield kept(*np.divmod(key[edge], width), both)
        m = to


def classes_of(sets: Sets) -> DataFrame:
    """(id, loc, n, m): classes of equal sets by their smallest id, with n shingles and m texts."""
    classes = sets.texts.where("doc_id is not null").groupBy("n", "h", "i").agg(F.min(F.struct("doc_id", "loc")).alias("f"), F.count(F.lit(1)).alias("m"))
    return classes.select(F.col("f.doc_id").alias("id"), F.col("f.loc").alias("loc"), "n", "m")


def _lists(own: Block, other: Block, x: np.ndarray, y: np.ndarray, both: np.ndarray) -> pa.RecordBatch:
    """The pairs x, y as a row for each x, with lists of its y's ids, shingles, texts and shingles in both."""
    order = np.argsort(x, kind="stable")
    x, y, both = x[order], y[order], both[order]
    edge = np.flatnonzero(np.diff(x, prepend=-1))
    ends = pa.array(np.append(edge, len(x)).astype(np.int32))
    held = {"others": other.ids.take(pa.array(y)), **{c: pa.array(v.astype(np.int32)) for c, v in (("sizes", other.n[y]), ("texts", other.m[y]), ("both", both))}}
    return pa.RecordBatch.from_pydict({"id": own.ids.take(pa.array(x[edge])), "n": own.n[x[edge]], **{c: pa.ListArray.from_arrays(ends, v) for c, v in held.items()}})


def gathered(found: Iterator[tuple], most: int = 1 << 20) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs of rows put together up to ``most`` and more, so that lists are long."""
    held: list[tuple] = []
    for x in found:
        held.append(x)
        if sum(len(p) for p, _, _ in held) >= most:
            yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
            held = []
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def overlapping(sets: Sets, near: float, overlap: float, form: str = "pairs") -> DataFrame:
    """(a, na, b, nb, i): pairs of classes of equal sets, with their shingles and those in both, where Jaccard is ``near`` or
    ``overlap`` of the smaller one is in both; each pair once.

    form "counts": (n), counts whose sum is their pairs of texts; form "lists": (id, n, others, sizes, texts, both), some rows
    of a class, each with a list of others, so that a pair takes a few bytes where a class's rows come together.
    """
    kind, least = sets.texts.schema["doc_id"].dataType.simpleString(), min(near, overlap)
    named = classes_of(sets)
    with small_arrow(sets.groups.sparkSession):
        entries = sets.groups.mapInArrow(_listed, "loc long, sid long, w long, df long")
        held = stored(entries.join(named, "loc").groupBy("loc", "id", "n", "m").agg(F.collect_list(F.struct("df", "sid", "w")).alias("gs"), F.sum("w").alias("total")))
    small, every = _blocks(held.where(F.col("total") >= F.ceil(F.col("n") * F.lit(least) - 1e-9)), False), _blocks(held, True)
    side = lambda t, x: t.select(*[F.col(c).alias(x + c) for c in t.columns])
    met = side(small, "a").crossJoin(side(every, "b").hint("shuffle_replicate_nl"))
    width = len(small.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple = (None, None)  # the last block: the next pairs of a task have the same one
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                key = row[4].as_py()  # a set is in one block
                if seen[0] != key:
                    seen = (key, Small(row[:width], least))
                a, b, total = seen[1], Block(row[width:]), 0
                for p, q, both in gathered(block_pairs(a, b, near, overlap)) if form == "lists" else block_pairs(a, b, near, overlap):
                    total += int((a.m[p] * b.m[q]).sum())
                    if form == "lists" and len(p):
                        yield _lists(a, b, p, q, both)
                        yield _lists(b, a, q, p, both)
                    for s in range(0, len(p) if form == "pairs" else 0, 1 << 16):
                        x, y = p[s : s + (1 << 16)], q[s : s + (1 << 16)]
                        yield pa.RecordBatch.from_pydict({"a": a.ids.take(pa.array(x)), "na": a.n[x], "b": b.ids.take(pa.array(y)), "nb": b.n[y], "i": both[s : s + (1 << 16)].astype(np.int64)})
                if form == "counts":
                    yield pa.RecordBatch.from_pydict({"n": pa.array([total], pa.int64())})

    schemas = {"counts": "n long", "pairs": f"a {kind}, na long, b {kind}, nb long, i long", "lists": f"id {kind}, n long, others array<{kind}>, sizes array<int>, texts array<int>, both array<int>"}
    return met.mapInArrow(run, schemas[form])
