"""What the two operators on embeddings share: which vectors take part, and arrays of them as numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm._shared import id_column


def takes_part(vector: str, dim: int) -> Column:
    """Whether a vector takes part among those of dimension dim; never null."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0) & (F.size(vector) == dim), F.lit(False))


def valid_vectors(table: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(vec_id, v) of the vectors that take part, v in the column's own type, and their dimension.

    Null, zero and empty vectors and those with null or non-finite components take no part; nor do vectors of another
    length than the longest.  A null id ranks after all others.
    """
    rows = table.select(id_column(id_col).alias("vec_id"), F.col(vector_col).alias("v")).where(F.col("v").isNotNull())
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0))
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 0
    return rows.where(F.size("v") == dim), dim


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list column as an array of doubles, one row a vector."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, dim)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1), kind))
