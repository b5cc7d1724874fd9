"""The inverted index, versioned vector tables, index builds and the shared folder."""

import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from corvane.operators import embedding, inverted, retrieval
from corvane.sources import files, versions

VECTORS = "chunk_id string, vector array<double>, label int"


def texts(spark, rows, name="doc_id"):
    return spark.createDataFrame(rows, f"{name} long, text string")


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    weights = 1 / np.arange(1, 301)
    said = [(i, " ".join(rng.choice(words, rng.integers(0, 60), p=weights / weights.sum()))) for i in range(2000)]
    said += [(5000, None), (5001, ""), (5002, "?!"), (5003, "w7 " * 500)]
    asked = [(i, " ".join(rng.choice(words, 8))) for i in range(40)] + [(40, "w0 w0 w1"), (41, "nowhere"), (42, ""), (43, None), (44, said[17][1])]
    return said, asked


@pytest.mark.parametrize(("block", "k"), [(1024, 10), (7, 1), (7, 3000)])
def test_bounded_search_is_whole(spark, corpus, block, k):
    docs, asked = texts(spark, corpus[0]), texts(spark, corpus[1], "query_id")
    index = inverted.build(docs, block=block)
    want = retrieval.bm25(docs, asked, k).collect()
    work = Observation()
    assert sorted(inverted.search(index, asked, k, work).collect()) == sorted(want)
    matches = retrieval.bm25(docs, asked, 10**6).count()
    assert work.get["scored"] <= matches < 2004 * 45
    if k == 1:
        assert work.get["scored"] < 0.5 * matches


def test_index_of_few_documents(spark):
    docs = texts(spark, [(0, "lock lock mutex"), (1, "semaphore wait"), (2, "lock semaphore semaphore semaphore")])
    index = inverted.build(docs)
    found = inverted.search(index, texts(spark, [(0, "Lock, semaphore?")], "query_id"), 10).orderBy("rank").collect()
    assert [r.doc_id for r in found] == [2, 0, 1]
    assert inverted.index_stats(index).first().avgdl == 3
    none = inverted.build(texts(spark, []))
    assert inverted.search(none, texts(spark, [(0, "lock")], "query_id"), 3).collect() == []
    with pytest.raises(ValueError, match="top_k"):
        inverted.search(index, docs, 0)


def test_index_is_read_again(spark, corpus, tmp_path):
    docs, asked = texts(spark, corpus[0]), texts(spark, corpus[1], "query_id")
    path = str(tmp_path / "index")
    built = inverted.build(docs, path, block=50)
    assert sorted(inverted.search(inverted.load(spark, path), asked, 5).collect()) == sorted(inverted.search(built, asked, 5).collect())
    # postings of a crowded band lie in blocks of about the size asked for, and bands fall in impact
    assert built.blocks.agg(F.max("n")).first()[0] < 120
    assert built.terms.where(F.exists("bands", lambda b: b["low"] > b["high"])).count() == 0
    held = built.blocks.select("term", F.explode("postings").alias("p")).select("term", "p.doc_id", "p.tf")
    assert sorted(held.collect()) == sorted(retrieval.term_counts(docs.na.fill("")).select("term", "doc_id", F.col("tf").cast("int")).collect())


def vectors(spark, rows):
    return spark.createDataFrame(rows, VECTORS)


def live(spark, path, **asked):
    return {r.chunk_id: (r.vector, r.label) for r in versions.read(spark, path, **asked).collect()}


def test_versions(spark, tmp_path):
    path = str(tmp_path / "index")
    versions.create(vectors(spark, [("a", [1.0, 0.0], 1), ("b", [2.0, 0.0], 2), ("c", [3.0, 0.0], 3)]), path, "m", "c1")
    assert versions.upsert(path, vectors(spark, [("b", [5.0, 0.0], 5), ("d", [4.0, 0.0], 4)]), "m", "c2", checked_as="c1").rows == 4
    assert versions.delete(path, spark.createDataFrame([("a",), ("b",), ("zz",)], "chunk_id string")).rows == 2
    assert versions.upsert(path, vectors(spark, [("b", [6.0, 0.0], 6)]), "m", "c2").rows == 3
    want = {1: {"a": ([1.0, 0.0], 1), "b": ([2.0, 0.0], 2), "c": ([3.0, 0.0], 3)}, 4: {"b": ([6.0, 0.0], 6), "c": ([3.0, 0.0], 3), "d": ([4.0, 0.0], 4)}}
    want[2] = want[1] | {"b": ([5.0, 0.0], 5), "d": ([4.0, 0.0], 4)}
    want[3] = {"c": want[1]["c"], "d": want[2]["d"]}
    for v, rows in want.items():
        assert live(spark, path, version=v) == rows
        assert versions.verify(spark, path, v).rows == len(rows)
    # a table of the same rows has the same digests, however it came about
    other = str(tmp_path / "other")
    once = versions.create(vectors(spark, [(k, *v) for k, v in want[4].items()]), other, "m", "c2")
    last = versions.manifest(spark, path)
    assert (once.vectors, once.payload, once.rows) == (last.vectors, last.payload, last.rows)
    small = versions.compact(spark, path)
    assert (small.version, len(small.segments), len(small.tombstones)) == (5, 1, 0) and live(spark, path) == want[4]
    assert [r.chunk_id for r in versions.scroll(versions.read(spark, path), "b", 1).collect()] == ["c"]


def test_a_killed_writer_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path, new = str(tmp_path / "index"), vectors(spark, [("a", [9.0], 9)])
    versions.create(vectors(spark, [("a", [1.0], 1), ("b", [2.0], 2)]), path, "m", "c")
    for step in ("_put", "_commit"):
        calls, whole = [], getattr(versions, step)

        def dies(*given, calls=calls, whole=whole, step=step):
            calls.append(given)
            if step == "_commit" or len(calls) == 2:  # before the manifest, or after the data and before the tombstones
                raise RuntimeError("killed")
            return whole(*given)

        with monkeypatch.context() as patch:
            patch.setattr(versions, step, dies)
            with pytest.raises(RuntimeError, match="killed"):
                versions.upsert(path, new, "m", "c")
        assert live(spark, path) == {"a": ([1.0], 1), "b": ([2.0], 2)} and versions.verify(spark, path).version == 1
    os.makedirs(f"{path}/versions/00000002/_temporary/0")  # killed while the manifest was written
    assert live(spark, path)["a"] == ([1.0], 1)
    assert versions.upsert(path, new, "m", "c").version == 2 and live(spark, path)["a"] == ([9.0], 9)
    with pytest.raises(ValueError, match="another writer"):
        versions._commit(spark, path, 2, "m", "c", 1, [], [])


KILLED = """
import os, signal, sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from corvane.sources import versions
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
rows = spark.createDataFrame([("a", [9.0], 9)], {schema!r})
versions._commit = lambda *given: os.kill(os.getpid(), signal.SIGKILL)
versions.upsert({path!r}, rows, "m", "c")
"""


def test_a_process_that_is_killed(spark, tmp_path):
    path = str(tmp_path / "index")
    versions.create(vectors(spark, [("a", [1.0], 1)]), path, "m", "c")
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", KILLED.format(repo=repo, schema=VECTORS, path=path)], capture_output=True, timeout=300, check=False)
    assert done.returncode == -9
    assert len(os.listdir(f"{path}/data")) == 2 and live(spark, path) == {"a": ([1.0], 1)}


def test_versions_refuse(spark, tmp_path):
    path, rows = str(tmp_path / "index"), [("a", [1.0], 1), ("b", [2.0], 2)]
    with pytest.raises(ValueError, match="dimension"):
        versions.create(vectors(spark, [("a", [1.0], 1), ("b", [2.0, 1.0], 2)]), path, "m", "c")
    with pytest.raises(ValueError, match="twice"):
        versions.create(vectors(spark, [*rows, ("a", [3.0], 3)]), path, "m", "c")
    versions.create(vectors(spark, rows), path, "m", "c")
    with pytest.raises(ValueError, match="already"):
        versions.create(vectors(spark, rows), path, "m", "c")
    for bad, why in (({"model": "x"}, "model"), ({"corpus": "x"}, "corpus"), ({"dim": 3}, "dim")):
        with pytest.raises(ValueError, match=why):
            versions.read(spark, path, **bad)
    with pytest.raises(ValueError, match="twice"):
        versions.upsert(path, vectors(spark, [("d", [1.0], 1), ("d", [2.0], 1)]), "m", "c")
    with pytest.raises(ValueError, match="dimensions"):
        versions.upsert(path, vectors(spark, [("d", [1.0, 2.0], 1)]), "m", "c")
    with pytest.raises(ValueError, match="payload columns"):
        versions.upsert(path, vectors(spark, [("d", [1.0], 1)]).drop("label"), "m", "c")
    assert versions.upsert(path, vectors(spark, []), "m", "c").rows == 2
    assert versions.create(vectors(spark, rows[:1]), path, "m2", "c", recreate=True).version == 3
    assert live(spark, path).keys() == {"a"} and live(spark, path, version=2).keys() == {"a", "b"}
    segment = versions.manifest(spark, path, 3).segments[0].name
    spark.createDataFrame([("a", [1.5], 1, 0, 0)], VECTORS + ", vector_hash long, payload_hash long").write.mode("overwrite").parquet(f"{path}/data/{segment}")
    with pytest.raises(ValueError, match="vectors"):
        versions.verify(spark, path)


def test_index_build(spark, tmp_path):
    calls = []

    def model(given):
        if any("bad" in t for t in given):
            raise RuntimeError("no")
        return np.array([[len(t), 1.0] for t in given])

    chunks = spark.createDataFrame([("a", "d: one two", 1), ("b", " ", 2), ("c", None, 3), ("d", "bad", 4), ("e", "w " * 600, 5), ("f", "w " * 900, 6)], "chunk_id string, text string, label int").coalesce(1)
    spec = embedding.Spec("m", 2, 700)
    manifest, failures, figures = embedding.build_index(chunks, str(tmp_path / "i"), spec, lambda t: len(t.split()), model, "c")
    assert figures == {"rows": 6, "failures": 4, "longest": 900, "over_512": 2, "over_max": 1}
    assert {r.chunk_id: r.error for r in failures.collect()} == {"b": "empty input", "c": "empty input", "d": "RuntimeError: no", "f": "input has 900 tokens, m takes 700"}
    found = versions.read(spark, str(tmp_path / "i"), "m", "c").collect()
    assert manifest.rows == 2 and {(r.chunk_id, r.label) for r in found} == {("a", 1), ("e", 5)} and not calls


UNSET = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from corvane.sources.shared import shared_dir, stored
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert stored(spark.range(3)).count() == 3 and shared_dir(spark) == shared_dir(spark.newSession())
print("FOLDER", shared_dir(spark))
"""


def test_a_session_that_names_no_folder():
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", UNSET.format(repo=repo)], capture_output=True, text=True, timeout=300, check=False)
    assert "FOLDER /" in done.stdout, done.stderr[-2000:]


def test_guard_sees_through_paths(tmp_path):
    for target in (f"{tmp_path}/a/out", f"file://{tmp_path}/a/out", f"{tmp_path}/b/../a/out", f"{tmp_path}//a"):
        with pytest.raises(ValueError, match="inside"):
            files.guard_output(f"file:{tmp_path}/a/", target)
    files.guard_output(f"{tmp_path}/a", f"{tmp_path}/ab")
