"""Texts to unit vectors by an injected model: what a model needs is a Spec; empty and over-long inputs are refused.

An index of such vectors is built with its figures observed while it is written."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Row
from pyspark.sql import functions as F

from corvane.operators.folds import small_batches
from corvane.sources import versions
from corvane.sources.shared import small_arrow, stored


@dataclass(frozen=True)
class Spec:
    """What callers must know of a model: its name, vector length, longest input and the prefixes it was trained with."""

    name: str
    dim: int
    max_tokens: int
    document_prefix: str = ""
    query_prefix: str = ""


class Registry(dict[str, Spec]):
    """Specs by name; an unknown name is an error that lists the known ones."""

    def add(self, spec: Spec) -> Spec:
        if self.setdefault(spec.name, spec) != spec:
            raise ValueError(f"model {spec.name!r} is registered with other properties")
        return spec

    def __missing__(self, name: str) -> Spec:
        raise ValueError(f"unknown model {name!r}; known: {sorted(self)}")


EMBEDDED = "chunk_id string, vector array<float>, n_tokens int, error string"
#: Rows, and bytes of text, that a task holds and a model gets at once.
ROWS, BYTES = 1024, 2 << 20


def embed(rows: DataFrame, spec: Spec, tokens: Callable[[str], int], model: Callable[[Sequence[str]], np.ndarray], query: bool = False) -> DataFrame:
    """rows(chunk_id, text) -> (chunk_id, vector, n_tokens, error): a vector of length one, or why there is none.

    Inputs that are null, blank or longer than the model takes are refused, never cut; a vector that is not of the
    model's length, not finite or zero is an error of its row, and the others go on.  The model gets the texts of a batch
    together, ROWS and about BYTES of them at most; where that fails, one by one.
    """
    prefix = spec.query_prefix if query else spec.document_prefix

    def called(texts: list[str]) -> list[np.ndarray | str]:
        try:
            found = list(np.asarray(model(texts), np.float64).reshape(len(texts), -1))
        except Exception as e:  # noqa: BLE001  the row says so
            return [f"{type(e).__name__}: {e}"] if len(texts) == 1 else [x for t in texts for x in called([t])]
        return found

    def checked(vector: np.ndarray | str) -> tuple[list[float] | None, str | None]:
        if isinstance(vector, str):
            return None, vector
        length = float(np.linalg.norm(vector))
        if len(vector) != spec.dim or not np.isfinite(length) or not length:
            return None, f"the model gave no vector of {spec.dim} finite numbers"
        return (vector / length).tolist(), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_batches((b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)), 1, BYTES):
            texts = [None if t is None or not t.strip() else prefix + t for t in part.column(1).to_pylist()]
            sizes = [0 if t is None else tokens(t) for t in texts]
            found = [(None, "empty input" if t is None else f"input has {n} tokens, {spec.name} takes {spec.max_tokens}") for t, n in zip(texts, sizes, strict=True)]
            good = [i for i, (t, n) in enumerate(zip(texts, sizes, strict=True)) if t is not None and n <= spec.max_tokens]
            for i, vector in zip(good, called([texts[i] for i in good]) if good else [], strict=True):
                found[i] = checked(vector)
            columns = [part.column(0), pa.array([v for v, _ in found], pa.list_(pa.float32())), pa.array(sizes, pa.int32()), pa.array([e for _, e in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["chunk_id", "vector", "n_tokens", "error"])

    return rows.select(F.col("chunk_id").cast("string"), "text").mapInArrow(run, EMBEDDED)


def build_index(chunks: DataFrame, path: str, spec: Spec, tokens: Callable[[str], int], model: Callable[[Sequence[str]], np.ndarray], corpus: str, recreate: bool = False) -> tuple[Row, DataFrame, dict[str, int]]:
    """(manifest, failures, figures) of an index of chunks(chunk_id, text, payload...), whose text is not in the payload.

    The model runs once: its rows are written with their figures observed on the way, then those with a vector become the
    index and the others failures(chunk_id, error).  Figures: rows, failures, longest, over_512 and over_max inputs in tokens.
    """
    seen = Observation()
    count = lambda c: F.count_if(c)
    figures = [F.count(F.lit(1)).alias("rows"), count(F.col("error").isNotNull()).alias("failures"), F.max("n_tokens").alias("longest"), count(F.col("n_tokens") > 512).alias("over_512"), count(F.col("n_tokens") > spec.max_tokens).alias("over_max")]
    with small_arrow(chunks.sparkSession):
        done = stored(embed(chunks, spec, tokens, model).observe(seen, *figures))
    found = {k: v or 0 for k, v in seen.get.items()}
    rows = done.where("error is null").select("chunk_id", "vector").join(chunks.drop("text"), "chunk_id")
    return versions.create(rows, path, spec.name, corpus, recreate), done.where("error is not null").select("chunk_id", "error"), found
