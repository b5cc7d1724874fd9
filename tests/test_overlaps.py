"""Findings of round 4: near duplicates whose pairs are found where blocks of sets are compared."""

import random
import re
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest

from corvane.operators import dedup, overlaps

ODD = ["İstanbul Kelvin 9été_x", "", " ... ", "x", "a b", "b a", "a b a b a b a b a b", "a" * 8, "a" * 9, "a" * 16, "a" * 17, "a" * 16 + "b", "A-b c\td\ne f", "a b c d e f!"]


def plain(text):
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip().split()


def sets_of(rows, k=5):
    found = {}
    for i, t in rows:
        words = plain(t or "")
        if words and i is not None:
            s = frozenset(tuple(words[j : j + k]) for j in range(max(len(words) - k, 0) + 1))
            found.setdefault(s, []).append(i)
    return found


def half_up(x):
    return float(Decimal(repr(x)).quantize(Decimal("0.001"), ROUND_HALF_UP))


def slow_pairs(rows, near=0.8, overlap=0.5):
    classes, out = [(min(ids), s) for s, ids in sets_of(rows).items()], []
    for a, s in classes:
        for b, t in classes:
            if a < b:
                both = len(s & t)
                j, c = both / (len(s) + len(t) - both), both / min(len(s), len(t))
                if j >= near or c >= overlap:
                    out.append((a, b, "near_duplicate" if j >= near else "overlap", half_up(j), half_up(c)))
    return sorted(out)


def some_texts():
    """Passages that many texts have, near copies, copies, texts that are a passage alone, and odd ones."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    passages = [say(n) for n in (6, 9, 14, 30)]
    texts = [say(rng.randint(3, 12)) + " " + rng.choice(passages) + " " + say(rng.randint(0, 40)) for _ in range(70)]
    texts += [t.replace(t.split()[5], "other", 1) for t in texts[:25]] + texts[10:20] + passages + [p + " end" for p in passages] + [p + " " + passages[0] for p in passages]
    return [(i * 7 % 1009, t) for i, t in enumerate([*texts, *ODD])] + [(None, texts[0]), (2000, None)]


SMALL = [("RUN", 300), ("TEXTS", 40), ("RANGE", 64), ("ROWS", 60), ("SETS", 9)]


@pytest.mark.parametrize(("values", "kind"), [([], "long"), (SMALL, "long"), ([*SMALL, ("RANGE", 1)], "string")])
def test_pairs(spark, monkeypatch, values, kind):
    for name, value in values:
        monkeypatch.setattr(overlaps, name, value)
    rows = [(i if kind == "long" or i is None else f"d{i}", t) for i, t in some_texts()]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    sets = dedup.shingle_sets(docs)
    found = dedup.near_duplicate_pairs(docs, sets=sets)
    wanted = slow_pairs(rows)
    assert sorted(tuple(r) for r in found.collect()) == wanted and len(wanted) > 150
    members = dedup.shingle_classes(docs, sets=sets)
    assert sorted((str(r.doc_id), r.class_id) for r in members.collect()) == sorted((str(r.doc_id), r.class_id) for r in dedup.shingle_classes(docs).collect())
    members = members.where("doc_id is not null")
    near = dedup.near_adjacency(docs.where("doc_id is not null"))  # pairs were rows, made twice and shuffled three times
    assert "CartesianProduct" in (plan := near._jdf.queryExecution().executedPlan().toString()) and plan.count("CartesianProduct") <= 2
    assert sorted(near.collect()) == sorted(dedup.adjacency(found, members).collect())
    assert dedup.count_pairs(found, members).first()[0] == dedup.count_pairs(dedup.pair_counts(docs, sets=sets), members).first()[0]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan  # pairs were shuffled twice, and their sets with them


def test_few_bytes_a_shingle(spark):
    """Each shingle was a row in a shuffle, of some 25 bytes; and one of a single text was in it too."""
    g = np.sort(np.random.default_rng(2).integers(2**60, 2**60 + 2**59, 50_000, np.uint64))
    text = np.arange(50_000) % 60_000
    data = overlaps.packed(g, text)
    assert len(data) < 8.01 * len(g)
    for x, y in ((g, text), (g[:1], text[:1]), (np.array([3, 3, 2**64 - 1], np.uint64), np.array([0, 65535, 1]))):
        back = overlaps.unpacked(overlaps.packed(x, y))
        assert back[0].tolist() == x.tolist() and back[1].tolist() == y.tolist()
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l"), (3, "x a b c d e f")], "doc_id long, text string")
    groups = dedup.shingle_sets(docs).groups.select("w", "df").collect()
    assert [tuple(r) for r in groups] == [(2, 2)]  # one row for both shingles that texts share


def test_hashes_tell_shingles_apart():
    texts = [t.encode() for _, t in some_texts() if t]
    for k in (1, 5):
        g, of = overlaps.shingle_hashes(texts, k)
        grams = [tuple(w[j : j + k]) for w in map(plain, (t.decode() for t in texts)) if w for j in range(max(len(w) - k, 0) + 1)]
        assert len(set(zip(grams, g.tolist(), strict=True))) == len(set(grams)) == len(set(g.tolist()))
    assert overlaps.shingle_hashes([b"", b" . "], 5)[0].tolist() == []


def test_no_texts(spark):
    empty = spark.createDataFrame([(1, None), (2, "?")], "doc_id long, text string")
    for docs in (empty, empty.limit(0)):
        assert dedup.near_duplicate_pairs(docs).count() == 0 and dedup.shingle_classes(docs).count() == 0
        sets = dedup.shingle_sets(docs)
        assert dedup.count_pairs(dedup.pair_counts(docs, sets=sets), dedup.shingle_classes(docs, sets=sets)).first()[0] == 0
