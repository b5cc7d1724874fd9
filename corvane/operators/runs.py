"""A registry of evaluation runs: what was run, with which configuration, on which corpus and benchmark.

A run is a folder below runs/: the values of each query (written first) and a manifest of digests (written last, which
makes the run visible).  A run is refused where its benchmark was first run on another corpus, where its name is taken, or
where the benchmark has problems; so any two runs of one benchmark can be compared.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

MANIFEST = "name string, config string, config_digest string, corpus_digest string, benchmark_digest string, queries long, means map<string,double>"


def digest(rows: DataFrame) -> str:
    """A digest of rows in any order: their number and two XORs of row hashes; columns count by name."""
    columns = sorted(rows.columns)
    own = [*columns, *[F.col(c).isNull() for c in columns]]
    found = rows.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64(*own)), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64(F.lit(1), *own)), F.lit(0))).first()
    return hashlib.sha256(json.dumps([columns, *found]).encode()).hexdigest()[:16]


def exists(spark: SparkSession, pattern: str) -> bool:
    """Whether there is a file for a path pattern, by Hadoop's file system, as a read that fails would be logged."""
    wanted = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = wanted.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(wanted)
    return found is not None and len(found) > 0


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The manifests of all runs."""
    if not exists(spark, f"{path}/runs/*/manifest/_SUCCESS"):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json(f"{path}/runs/*/manifest")


def record(path: str, name: str, config: Mapping[str, object], corpus: DataFrame, benchmark: DataFrame, values: DataFrame, problems: DataFrame | None = None) -> Row:
    """Write a run and return its manifest; values(query_id, metrics...) has a row for each query of benchmark(query_id, ...)."""
    spark = values.sparkSession
    if problems is not None and (found := problems.limit(5).collect()):
        raise ValueError(f"invalid benchmark: {[tuple(r) for r in found]}")
    if not name or "/" in name:
        raise ValueError("a run needs a name that can be a folder's")
    said = json.dumps(config, sort_keys=True, default=str)
    digests = {"config": hashlib.sha256(said.encode()).hexdigest()[:16], "corpus": digest(corpus), "benchmark": digest(benchmark)}
    for other in runs(spark, path).where((F.col("name") == name) | (F.col("benchmark_digest") == digests["benchmark"])).collect():
        if other.benchmark_digest == digests["benchmark"] and other.corpus_digest != digests["corpus"]:
            raise ValueError(f"run {other.name!r} had this benchmark on another corpus ({other.corpus_digest}, not {digests['corpus']})")
        if other.name == name:
            raise ValueError(f"there is a run {name!r} with configuration {other.config}")
    unknown = benchmark.select("query_id").join(values.select("query_id"), "query_id", "left_anti").count() + values.join(benchmark.select("query_id"), "query_id", "left_anti").count()
    if unknown:
        raise ValueError(f"{unknown} queries are in the benchmark or the values alone")
    folder = f"{path}/runs/{name}"
    values.write.mode("overwrite").parquet(f"{folder}/values")  # what is there without a manifest is what a killed run left
    held = spark.read.parquet(f"{folder}/values")
    metrics = [c for c in held.columns if c != "query_id" and held.schema[c].dataType.typeName() in ("double", "float", "long", "integer")]
    means = held.agg(F.count(F.lit(1)).alias("__n"), *[F.avg(c).alias(c) for c in metrics]).first().asDict()
    row = spark.createDataFrame([(name, said, digests["config"], digests["corpus"], digests["benchmark"], means.pop("__n"), {k: None if v is None else round(float(v), 4) for k, v in means.items()})], MANIFEST)
    row.coalesce(1).write.mode("errorifexists").json(f"{folder}/manifest")
    return row.first()


def beside(spark: SparkSession, path: str, names: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(query_id, <name>_<metric>...) of runs of one benchmark on one corpus; raises for others."""
    found = {r.name: r for r in runs(spark, path).where(F.col("name").isin(*names)).collect()}
    if missing := [n for n in names if n not in found]:
        raise ValueError(f"no run {missing}")
    if len({(r.corpus_digest, r.benchmark_digest) for r in found.values()}) > 1:
        raise ValueError("the runs are of different benchmarks or corpora")
    tables = [spark.read.parquet(f"{path}/runs/{n}/values").select("query_id", *[F.col(m).alias(f"{n}_{m}") for m in metrics]) for n in names]
    return reduce(lambda a, b: a.join(b, "query_id"), tables)
