"""The folder that driver and executors share, and tables written there between steps."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders of sessions in one process that name none, by application: Spark lets nobody set its own key afterwards.
_OWN: dict[str, str] = {}
ARROW_BYTES = "2m"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir.  Where it is unset, a session in one process (tests) gets a folder of its own; on a cluster
    that would lose rows, so it raises ValueError."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        found = _OWN.setdefault(app, "") or tempfile.mkdtemp(prefix="corvane-")
        _OWN[app] = found
    return found.rstrip("/")


def fresh_path(spark: SparkSession, kind: str = "table") -> str:
    return f"{shared_dir(spark)}/corvane/{kind}-{uuid.uuid4().hex}"


def written(table: DataFrame, path: str) -> DataFrame:
    """table written as Parquet and read back with its schema."""
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def stored(table: DataFrame) -> DataFrame:
    """table written in the shared folder and read back: lineage ends there, and what several steps read is made once."""
    return written(table, fresh_path(table.sparkSession))


@contextmanager
def small_arrow(spark: SparkSession) -> Iterator[None]:
    """Within it, batches that go to Python are bounded in bytes, not in rows alone, so long texts do not add up."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ARROW_BYTES)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
