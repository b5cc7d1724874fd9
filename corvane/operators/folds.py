"""Folds over groups of rows in order: one shuffle and one sort a table, groups read one after the other from a partition."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
#: Rows, and characters of text, that are sent on together.
ROWS, CHARS = 4096, 1 << 22


def arrow_schema(schema: str) -> pa.Schema:
    """The Arrow form of a schema of plain columns ("a int, b array<string>")."""
    return pa.schema([(name, TYPES[kind]) for name, kind in (c.split() for c in schema.split(", "))])


def folded(table: DataFrame, key: str, order: Sequence[Column], fold: Callable[[list[dict]], Iterable[dict]], schema: str, text: str = "text") -> DataFrame:
    """fold(rows of one key, sorted) -> rows of ``schema``; a task holds one group at a time, however many it has.

    A null key is a group of its own.  Groups are not started one by one, as grouped pandas functions are.
    """
    shape = arrow_schema(schema)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        held: list[dict] = []
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                for row in batch.slice(i, ROWS).to_pylist():
                    if held and row[key] != held[0][key]:
                        yield held
                        held = []
                    held.append(row)
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, chars = [], 0
        for rows in groups(batches):
            for row in fold(rows):
                out.append(row)
                chars += len(row[text] or "")
                if len(out) >= ROWS or chars >= CHARS:
                    yield pa.RecordBatch.from_pylist(out, shape)
                    out, chars = [], 0
        yield pa.RecordBatch.from_pylist(out, shape)

    return table.repartition(F.col(key)).sortWithinPartitions(F.col(key), *order).mapInArrow(run, schema)


def small_batches(batches: Iterator[pa.RecordBatch], column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a binary column has about ``most`` bytes in each; a longer value comes alone."""
    for batch in batches:
        sizes = np.nan_to_num(np.asarray(pc.binary_length(batch.column(column)).cast(pa.float64()).to_numpy(zero_copy_only=False)))
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
