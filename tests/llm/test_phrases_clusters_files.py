"""Phrase collocations, centroid clusters and token files against brute force, round trips and odd tables."""

import hashlib
import re
import zlib
from collections import Counter
from fractions import Fraction
from math import floor

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.llm import clustering, collocations, token_files
from corvane.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, phrase int, f string, w int, h int, t int"
SF = "/root/testdata/sf0.001"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, "x", 2, 3, 4) for i, t, lang in rows], DOCS)


def brute_phrases(rows, support, longest, top):
    """All counts of each language, in memory, by the words of the contract."""
    counts = {}
    for _, text, lang in rows:
        own = counts.setdefault(lang or "und", Counter())
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, longest + 1):
                own.update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, own in counts.items():
        n = sum(v for k, v in own.items() if len(k) == 1)
        often = {k: v for k, v in own.items() if v >= support}
        found = []
        for k, a in often.items():
            inside = any(len(o) > len(k) and v >= a and any(o[i : i + len(k)] == k for i in range(len(o))) for o, v in often.items())
            if len(k) > 1 and not inside:
                score, cut = min((floor(Fraction(1000 * a * n, own[k[:c]] * own[k[c:]])), c) for c in range(1, len(k)))
                found.append((-score, -a, " ".join(k).encode(), own[k[:cut]], own[k[cut:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


ODD_TEXTS = [
    (1, "The Red fox. the red fox, the RED fox runs; a red fox", "en"), (2, None, "en"), (3, "", None), (4, "of the of the of the of the of the", None),
    (5, "of the of the", "und"), (None, "the red fox\tthe red  fox\x0bred fox", "en"), (6, "É é É é É é É é\nçà çà çà", "fr"), (7, "x " * 20_000, "xx"),
    (7, "x " * 3, "xx"), (8, " \t.,;\n", "fr"), (9, "a\x01b a a\x01b a a\x01b a", "en"), (9, "a\x01b a a\x01b a a\x01b a", "en"),
]


@pytest.mark.parametrize("pointers", [200_000, 2, 1])
@pytest.mark.parametrize(("support", "longest"), [(2, 5), (3, 3), (4, 2)])
def test_phrases(spark, pointers, support, longest):
    got = collocations.collocations(docs_of(spark, ODD_TEXTS), support, longest, 2000, pointers=pointers).collect()
    assert sorted(map(tuple, got)) == brute_phrases(ODD_TEXTS, support, longest, 2000)


def test_phrases_random(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(rng.choice(["a", "b", "cc", "Dd", "e.", "f"], p=[0.5, 0.2, 0.1, 0.1, 0.05, 0.05], size=rng.integers(0, 60))), ["en", "de", None][i % 3]) for i in range(150)]
    monkeypatch.setattr(collocations, "TEXT_BYTES", 500)  # many batches
    table = docs_of(spark, rows).repartition(5)
    want = brute_phrases(rows, 5, 5, 7)
    assert sorted(map(tuple, collocations.collocations(table, 5, 5, 7).collect())) == want
    # a filter that lets everything pass, and prefixes split, change nothing
    monkeypatch.setattr(collocations, "FILTER_BITS", 1)
    monkeypatch.setattr(collocations.BitFilter, "has", lambda self, hashes: np.ones(len(hashes), bool))
    assert sorted(map(tuple, collocations.collocations(table, 5, 5, 7, pointers=3).collect())) == want


def test_phrases_of_no_text(spark):
    assert collocations.collocations(docs_of(spark, []), 2).collect() == []
    assert collocations.collocations(docs_of(spark, [(1, None, None), (2, "a b", "en")]), 2).collect() == []
    with pytest.raises(ValueError, match="support"):
        collocations.collocations(docs_of(spark, []), 0)


def test_exact_scores(spark):
    """1000 a n and l r beyond 64 bits."""
    big = 10**13
    row = spark.range(1).select(F.call_function("div", F.lit(1000).cast("decimal(4,0)") * F.lit(big - 1).cast("decimal(18,0)") * F.lit(big + 7).cast("decimal(18,0)"), F.lit(big - 3).cast("decimal(18,0)") * F.lit(big + 1).cast("decimal(18,0)")).alias("s")).first()
    assert row.s == 1000 * (big - 1) * (big + 7) // ((big - 3) * (big + 1))


VECTORS = "vec_id long, embedding array<float>, label int, q int, cluster string, near int, distance string"


def vectors_of(spark, vectors, ids=None):
    return spark.createDataFrame([(i, v, 0, 1, "x", 2, "y") for i, v in zip(ids or range(len(vectors)), vectors, strict=True)], VECTORS)


def brute_clusters(vectors, ids, k, rounds, dim, seed=2):
    fit = [(i, [floor(256 * float(np.float32(x))) for x in v]) for i, v in zip(ids, vectors, strict=True) if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(fit, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [q for _, q in order[:k]]
    for r in range(rounds + 1):
        placed = [min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(centroids)) for _, q in fit]
        if r < rounds:
            for j in range(len(centroids)):
                own = [q for (_, q), p in zip(fit, placed, strict=True) if p[1] == j]
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)] if own else centroids[j]
    inertia = Counter()
    for d, j in placed:
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((-1 if i is None else i), j, d, inertia[j], sum(inertia.values()), digest[j]) for (i, _), (d, j) in zip(fit, placed, strict=True))


def got_clusters(df):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


@pytest.mark.parametrize(("k", "rounds", "seed"), [(40, 5, 0), (12, 8, 1), (3, 4, 2), (1, 2, 3), (7, 0, 4)])
def test_clusters(spark, k, rounds, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((9, 6))
    x = (centres[rng.integers(0, 9, 600)] + rng.choice([0.02, 0.5], (600, 1)) * rng.standard_normal((600, 6))).astype(np.float32)
    found = clustering.clusters(vectors_of(spark, x.tolist()), k=k, rounds=rounds, dim=6)
    assert got_clusters(found) == brute_clusters(x.tolist(), range(600), k, rounds, 6)
    if (k, rounds) == (12, 8):
        assert found.agg(F.avg("measured")).first()[0] < 0.6 * k


def test_clusters_with_many_ties(spark):
    rng = np.random.default_rng(5)
    x = (rng.integers(-1, 2, (400, 3)) / 256).tolist()
    assert got_clusters(clustering.clusters(vectors_of(spark, x), k=10, rounds=6, dim=3)) == brute_clusters(x, range(400), 10, 6, 3)


def test_clusters_of_odd_tables(spark):
    x = [[0.5, 1.0], None, [1.0], [None, 1.0], [float("nan"), 1.0], [float("inf"), 0.0], [0.0, 0.0], [0.5, 1.0], [-0.3, 2.0], [-0.3, 2.5], [1.0, 1.0, 1.0], []]
    ids = [1, 2, 3, 4, 5, 6, None, 1, 9, 9, 10, 11]
    found = clustering.clusters(vectors_of(spark, x, ids), k=40, rounds=2, dim=2)
    assert got_clusters(found) == brute_clusters(x, ids, 40, 2, 2) and found.count() == 5
    assert clustering.clusters(vectors_of(spark, []), dim=2).collect() == []
    assert clustering.clusters(vectors_of(spark, [None, [1.0]]), dim=2).collect() == []
    with pytest.raises(Exception, match="beyond"):
        clustering.clusters(vectors_of(spark, [[1e9, 0.0]]), dim=2).collect()


def test_cluster_query_by_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    found = clustering.clusters(spark.read.parquet(f"{SF}/embeddings.parquet"))
    assert got_clusters(found) == brute_clusters([list(r.embedding) for r in rows], [r.vec_id for r in rows], 40, 5, 64)


def test_queries_equal_their_sql(spark):
    from corvane.llm import queries

    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    for name in ("op11_phrase_collocations", "op12_centroid_clusters"):
        got, want = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
        order = sorted(want.columns)
        assert sorted(got.columns) == order
        assert sorted(map(tuple, got.select(*order).collect())) == sorted(want.project(", ".join(order)).fetchall())


ids_of = st.lists(st.one_of(st.integers(0, 3), st.integers(0, 1023), st.integers(0, 49_407), st.integers(0, 2**32 - 1)), max_size=1500)


@settings(max_examples=60, deadline=None)
@given(ids_of, st.data())
def test_any_position_of_a_token_file(ids, data):
    held = np.array(ids, np.uint32)
    cut = sorted(data.draw(st.lists(st.integers(0, len(ids)), max_size=4)))
    ends = np.array([*cut, len(ids)], np.int64)
    file = token_files.TokenFile(token_files.encode(np.arange(len(ends)), ends, held))
    assert [d.tolist() for _, _, d in file.documents()] == [ids[a:b] for a, b in zip([0, *cut], ends.tolist(), strict=True)]
    for _ in range(5):
        a, b = sorted(data.draw(st.tuples(st.integers(0, len(ids)), st.integers(0, len(ids)))))
        assert file.range(a, b).tolist() == ids[a:b]
        if a < len(ids):
            assert file.token(a) == ids[a]
    with pytest.raises(IndexError):
        file.token(len(ids))


def test_widths_are_the_cheapest():
    def cost(widths, lengths):
        at = total = 0
        for i, w in enumerate(widths):
            n = sum(c for b, c in enumerate(lengths) if not at or b > at)
            total += n * (w + (1 + 64 / 512) * (i < len(widths) - 1))
            at += w
        return total

    def splits(bits):
        return [[w] for w in range(2, 17, 2) if w >= bits] + [[w, *rest] for w in range(2, 17, 2) if w < bits for rest in splits(bits - w)]

    rng = np.random.default_rng(1)
    for bits in (1, 5, 12, 20):
        lengths = np.zeros(33, int)
        lengths[1 : bits + 1] = rng.integers(0, 1000, bits)
        lengths[bits] += 1
        found = token_files.widths_for(lengths)
        assert sum(found) >= bits
        assert cost(found, lengths) == pytest.approx(min(cost(s, lengths) for s in splits(bits)))


def test_a_damaged_file_is_told():
    data = bytearray(token_files.encode(np.array([1]), np.array([3]), np.array([7, 70_000, 9], np.uint32)))
    data[-6] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        token_files.TokenFile(bytes(data))
    with pytest.raises(ValueError, match="not a token file"):
        token_files.TokenFile(b"other bytes")


def brute_tokens(rows):
    from tokenizers import Tokenizer

    encoder, out, at = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), [], 0
    for i, t in rows:
        ids = np.array([*encoder.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize(("file_tokens", "range_bytes"), [(token_files.FILE_TOKENS, token_files.RANGE_BYTES), (2000, 50_000)])
def test_token_files(spark, file_tokens, range_bytes):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    manifest = token_files.write_files(table, vocabulary("word_bpe_49k.json"), file_tokens=file_tokens, range_bytes=range_bytes)
    want = brute_tokens([(r.doc_id, r.text) for r in table.orderBy("doc_id").collect()])
    found = token_files.read_files(manifest, with_ids=True).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found) == want
    every = np.concatenate([r.ids for r in sorted(found, key=lambda r: r.start)])
    for a, b in ((0, 0), (0, 5), (1990, 2010), (len(every) - 3, len(every)), (100, 30_000)):
        assert token_files.token_range(manifest, a, b).tolist() == every[a:b].tolist()
    assert manifest.count() > 1 or file_tokens > 2000


def test_token_files_of_odd_tables(spark):
    rows = [(3, "third <|endoftext|> row", "en"), (1, None, None), (2, "", "en"), (1, "a second row of id 1", "en"), (None, "no id", "en"), (4, "long " * 50_000 + "z" * 5000, "en"), (5, "same", "en"), (5, "same", "en"), (-7, "É ü 漢字 don't", "fr")]
    manifest = token_files.write_files(docs_of(spark, rows), vocabulary("word_bpe_49k.json"))
    found = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_files(manifest).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == [-7, 1, 1, 2, 3, 4, 5, 5, None]
    assert sorted((r[2], r[3]) for r in found) == sorted(r[2:] for r in brute_tokens([(i, t) for i, t, _ in rows]))
    assert [r[1] for r in found] == np.cumsum([0, *[r[2] for r in found]])[:-1].tolist()
    none = token_files.write_files(docs_of(spark, []), vocabulary("word_bpe_49k.json"))
    assert none.count() == 0 and token_files.read_files(none).collect() == [] and token_files.token_range(none, 0, 4).tolist() == []
