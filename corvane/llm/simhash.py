"""SimHash near-dedup: fingerprints, pigeonhole blocks, exact Hamming check, components.

A fingerprint has 64 bits in R blocks; two that differ in at most D bits agree on at least R - D whole blocks, so for
every choice of R - D blocks the texts are joined on those blocks.  With R = 6 and D = 3 that is 20 keys of about 32
bits for each *distinct* fingerprint.  Rows with one fingerprint are a class from the start and never form pairs.
Within a block bucket a spanning forest of the links is emitted, not all pairs: components need no more, and a link
found in the bucket is never lost.  Buckets over CAP members are keyed anew with more blocks (9, then 16), which is
exact as well; at 16 blocks a bucket has at most 4,096 distinct fingerprints by construction.

Defined cases: null, empty and white-space texts have fingerprint zero and link like any other; fewer words than a
shingle make one shingle of all words; a null id ranks after all others; repeated rows are one class.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._shared import id_column, materialise, small_batches
from corvane.llm.components import connected_components

LEVELS = (6, 9, 16)
CAP = 4096
SEED = 42


def fingerprint(data: bytes | None, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a UTF-8 text; shingles are hashed a bounded number at a time."""
    words = (data or b"").lower().split()  # bytes: A-Z and ASCII white space alone
    total = max(1, len(words) - shingle + 1) if words else 0
    if not total:
        return 0
    grams = map(b" ".join, zip(*(islice(words, i, None) for i in range(min(shingle, len(words)))), strict=False))
    counts = np.zeros(64, np.int64)
    for at in range(0, total, 1 << 16):
        n = min(1 << 16, total - at)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, islice(grams, n), repeat(SEED)), np.uint64, n)
        counts += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(n, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id long, fp long): fp holds the 64 bits, so it may be negative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            fps = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return docs.select(id_column(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("t")).mapInArrow(run, "id long, fp long")


def masks(blocks: int, distance: int) -> list[int]:
    """For every choice of blocks - distance blocks, the bits it covers, as signed longs."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    found = [sum(x) for x in combinations(parts, blocks - distance)]
    return [x - (1 << 64) if x >> 63 else x for x in found]


def forest(fps: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links within distance, as positions: each member joins a tree once."""
    left, a, b = np.arange(len(fps)), [], []
    while left.size:
        stack, left = [int(left[0])], left[1:]
        while stack and left.size:
            x = stack.pop()
            near = np.bitwise_count(fps[left] ^ fps[x]) <= distance
            found = left[near].tolist()
            a += [x] * len(found)
            b += found
            stack += found
            left = left[~near]
    return a, b


def fingerprint_links(classes: DataFrame, distance: int = 3) -> DataFrame:
    """classes(node, fp), one row a distinct fingerprint -> links (a, b) between nodes that connect what is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members, ends = batch.column(0), batch.column(0).offsets.to_numpy()
            flat = members.values
            nodes, fps = (flat.field(k).to_numpy() for k in ("node", "fp"))
            out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for s, e in zip(ends, ends[1:], strict=False):
                a, b = forest(fps[s:e].view(np.uint64), distance)
                out_a.append(nodes[s:e][a])
                out_b.append(nodes[s:e][b])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_a, out_b)], ["a", "b"])

    links = None
    for level, blocks in enumerate(LEVELS):
        table = masks(blocks, distance)
        keyed = classes.select("node", "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(table)])).alias("x")).select("node", "fp", "x.t", "x.k")
        shared = materialise(keyed.groupBy("t", "k").count().where("count > 1"))
        last = level == len(LEVELS) - 1
        fit = shared if last else shared.where(F.col("count") <= CAP)
        grouped = keyed.join(fit.select("t", "k"), ["t", "k"]).groupBy("t", "k").agg(F.collect_list(F.struct("node", "fp")).alias("m"))
        found = materialise(grouped.select("m").mapInArrow(run, "a long, b long").distinct())
        links = found if links is None else links.unionAll(found)
        over = shared.where(F.col("count") > CAP).select("t", "k")
        if last or over.isEmpty():
            return links
        classes = materialise(keyed.join(over, ["t", "k"], "left_semi").select("node", "fp").distinct())
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """(id, fp, component): one row a document; component is the smallest id reachable by links, its own included."""
    prints = materialise(fingerprints(docs, id_col, text_col, shingle))
    classes = materialise(prints.groupBy("fp").agg(F.min("id").alias("node")))
    reach = connected_components(fingerprint_links(classes, distance))
    named = classes.join(reach, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    return prints.join(named, "fp").select("id", "fp", "component")
