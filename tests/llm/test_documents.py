"""Sharding, line dedup, mixing, packing, SimHash, token counts and language ID against brute force, and odd tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corvane.llm import language, line_dedup, mixing, packing, shard, simhash, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
ODD = [
    (1, "One line that repeats here\nshort\nOnly in the first document", "en", "a", 1),
    (2, " one LINE that repeats here\t\n\nshort", "en", "a", 1),
    (3, None, "fr", None, None),
    (4, "", None, "b", 0),
    (5, "x " * 30_000 + "end", "en", "b", 1),
    (6, "same text in two rows", "de", "c", 1),
    (6, "same text in two rows", "de", "c", 1),
    (7, "same text in two rows", "de", "c", 1),
    (None, "One line that repeats here", "en", "a", 1),
    (8, " \t\n ", "en", "a", 1),
    (9, "É ü ßẞ\n漢字 <|endoftext|> don't", "fr", "d", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    extra = spark.createDataFrame(ODD, SCHEMA)
    return extra.withColumns({"size": F.lit("clash"), "shard": F.lit(1), "component": F.lit(2), "tokens": F.array(F.lit(1))})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "source").collect()]


@pytest.mark.parametrize("name", ["odd", "docs"])
@pytest.mark.parametrize("shards", [1, 3, 40])
def test_shards(request, name, shards):
    table = request.getfixturevalue(name)
    source = rows_of(table)
    got = shard.assign_shards(table, shards).collect()
    assert Counter((r.id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in source)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    counts = [len(by[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    if name == "docs":
        per = Counter((r.shard, r.source_key) for r in got)
        total = Counter(r.source_key for r in got)
        assert all(abs(per[s, k] - n / shards) <= 1.5 for s in range(shards) for k, n in total.items())
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, shard.assign_shards(table.repartition(3), shards).collect()), key=repr)


def brute_lines(source, least=10):
    space = " \t\n\x0b\x0c\r"
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    key = lambda line: line.strip(space).translate(lower)
    big = 2**63 - 1
    holders = defaultdict(set)
    for i, t, _ in source:
        for line in (t or "").split("\n"):
            holders[key(line)].add(big if i is None else i)
    out = []
    for i, t, _ in source:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= least and len(holders[key(x)]) > 1 and min(holders[key(x)]) != (big if i is None else i))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("name", ["odd", "docs", "empty"])
def test_line_dedup(request, name):
    table = request.getfixturevalue(name)
    got = line_dedup.dedup_lines(table)
    assert Counter((r.doc_id, r["__n_lines"], r["__n_dropped"], r["__kept"]) for r in got.collect()) == brute_lines(rows_of(table))
    assert set(table.columns) < set(got.columns)


def test_fill_and_apportion():
    got = mixing.fill(np.array([10, 10, 100]), np.array([1.0, 2.0, 3.0]))
    assert got.sum() == pytest.approx(120) and got[1] == 30 and got[0] / 1 == pytest.approx(got[2] / 3)
    rng = np.random.default_rng(0)
    for _ in range(20):
        targets, caps = rng.random(6) * 100, rng.integers(5, 60, 6)
        seats = int(rng.integers(0, caps.sum()))
        quotients = sorted(((-t / (2 * j + 1), i) for i, (t, c) in enumerate(zip(targets, caps, strict=True)) for j in range(c)))[:seats]
        assert mixing.apportion(targets, caps, seats).tolist() == [sum(q[1] == i for q in quotients) for i in range(6)]


@pytest.mark.parametrize("name", ["odd", "docs", "empty"])
def test_mix(request, name):
    table = request.getfixturevalue(name)
    source = rows_of(table)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    got = mixing.taken_words(table).collect()
    assert Counter((r.id, r["size"]) for r in got) == Counter((i, words(t)) for i, t, _ in source)
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    sizes = Counter()
    for _, t, s in source:
        sizes[s] += words(t)
    if name == "docs":
        order = sorted((s for s in sizes if s is not None))
        want = mixing.fill(np.array([sizes[s] for s in order]), np.array([1.0 + i % 3 for i in range(len(order))]))
        own = {i: s for i, _, s in source}
        took = Counter()
        for r in got:
            took[own[r.id]] += r.taken
            assert r.target == want[order.index(own[r.id])] and r.source_size == sizes[own[r.id]]
        assert all(abs(took[s] - t) <= max(5, 0.01 * t) for s, t in zip(order, want, strict=True))
    mixed = mixing.mix(table).collect()
    assert sum(words(r.text) for r in mixed) == sum(r.taken for r in got)
    texts = {(i, t) for i, t, _ in source}
    assert all((r.doc_id, r.text) in texts or any(i == r.doc_id and t and r.text in t for i, t in texts) for r in mixed)
    assert Counter(map(repr, mixed)) == Counter(map(repr, mixing.mix(table.repartition(3)).collect()))


def test_block_schedule(docs, spark):
    sizes = docs.select(mixing.source_key("source").alias("key"), mixing.split_words(F.col("text")).alias("size"))
    plan = mixing.allocation(sizes, shards=4).collect()
    made = Counter((r.key, r.shard) for r in mixing.block_schedule(mixing.allocation(sizes, shards=4)).collect())
    for r in plan:
        assert [made[r.key, s] for s in range(4)] == r.shard_quotas and sum(r.shard_quotas) == r.quota


@pytest.mark.parametrize("name", ["odd", "docs", "empty"])
def test_packing(request, name):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    table = request.getfixturevalue(name)
    source = rows_of(table)
    ids = [(i, [*Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids, 1]) for i, t, _ in source] if len(source) < 20 else None
    if ids is None:
        tokenizer = Tokenizer.from_file(path)
        ids = [(i, [*x.ids, 1]) for (i, _, _), x in zip(source, tokenizer.encode_batch([t or "" for _, t, _ in source], add_special_tokens=False), strict=True)]
    want = Counter()
    for i, own in ids:
        at = 0
        for n in packing.binary_lengths(len(own), 2048):
            want[i, at, n, zlib.crc32(np.array(own[at : at + n], "<u4").tobytes()), len(own)] += 1
            at += n
        assert at == len(own)
    got = packing.pack(table, path).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    assert sorted(r.sequence_id for r in got) == list(range(len(got))) and all(r.offset == 0 for r in got)
    by_id = sorted((r.sequence_id, r.length) for r in got)
    assert [n for _, n in by_id] == sorted((n for _, n in by_id), reverse=True)


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def slow_print(text, k=3):
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("name", ["odd", "docs", "empty"])
def test_simhash(request, name):
    table = request.getfixturevalue(name)
    source = [(2**63 - 1 if i is None else i, t) for i, t, _ in rows_of(table)]
    prints = {i: slow_print(t) for i, t in source}
    want = brute_components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    got = simhash.near_duplicates(table).collect()
    assert len(got) == len(source)
    assert {r.id: (r.fp % 2**64, r.component) for r in got} == {i: (prints[i], want[i]) for i in prints}


@pytest.mark.parametrize("cap", [4096, 3])
def test_crowded_fingerprints(spark, monkeypatch, cap):
    monkeypatch.setattr(simhash, "CAP", cap)
    rng = np.random.default_rng(1)
    fps = set(rng.integers(0, 2**63, 40).tolist())
    for _ in range(150):  # chains of near fingerprints
        fps.add(sorted(fps)[int(rng.integers(len(fps)))] ^ sum(1 << int(b) for b in rng.integers(0, 62, int(rng.integers(1, 5)))))
    nodes = dict(enumerate(sorted(fps)))
    from corvane.llm.components import connected_components

    classes = spark.createDataFrame(list(nodes.items()), "node long, fp long")
    got = {r.node: r.component for r in connected_components(simhash.fingerprint_links(classes)).collect()}
    want = brute_components(sorted(nodes), lambda a, b: (nodes[a] ^ nodes[b]).bit_count() <= 3)
    assert {n: got.get(n, n) for n in nodes} == want


@pytest.mark.parametrize("name", ["odd", "docs", "empty"])
def test_token_counts(request, name):
    table = request.getfixturevalue(name)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoder = token_counts.ByteEncoder(path, public_tokenizers.PATTERN)
    got = token_counts.count_tokens(table, path, public_tokenizers.PATTERN).collect()
    total, want = Counter(), Counter()
    for r in got:
        total[r.doc_id] += r.tokens
    for i, t, _ in rows_of(table):
        want[i] += len(encoder.encoding.encode_ordinary(t or ""))
    assert +total == +want
    texts = {i: t or "" for i, t, _ in rows_of(table)}
    for r in got[:200]:
        assert texts[r.doc_id][r.start : r.end].rstrip("\n") == texts[r.doc_id].split("\n")[int(r.section)]


def test_attribution_rules():
    ends, bounds = np.array([3, 7, 10]), np.array([4, 6, 10])
    assert token_counts.attribute(ends, bounds, "first")[0].tolist() == [2, 0, 1]
    assert token_counts.attribute(ends, bounds, "last")[0].tolist() == [1, 0, 2]
    assert token_counts.attribute(ends, bounds, "largest")[0].tolist() == [1, 1, 1]
    assert token_counts.attribute(ends, bounds, "largest")[1].tolist() == [0, 1, 0]


def test_given_sections(spark):
    docs = spark.createDataFrame([(1, "héllo wörld again", [("b", 6, 11), ("a", 0, 5)]), (2, None, None)], "doc_id long, text string, parts array<struct<name:string,start:long,end:long>>")
    got = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, sections_col="parts").collect()
    assert [(r.doc_id, r.section, r.start, r.end) for r in got] == [(1, "a", 0, 5), (1, "-1", 5, 6), (1, "b", 6, 11), (1, "-1", 11, 17), (2, "-1", 0, 0)]


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = language.fit(docs, sample=2000)
    held = docs.where(F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(10_000)) >= 2000)
    found = language.identify(language.document_evidence(held), model).join(held.select(F.col("doc_id").alias("id"), F.col("lang").alias("truth")), "id")
    counts = found.groupBy((F.col("lang") == F.col("truth")).alias("right"), "accepted").count().collect()
    total = sum(r["count"] for r in counts)
    assert sum(r["count"] for r in counts if r.right) / total > 0.97
    assert sum(r["count"] for r in counts if not r.accepted) / total < 0.01


def test_language_odd(odd, empty, docs):
    model = language.fit(docs)
    got = language.identify(language.document_evidence(odd), model).collect()
    assert len(got) == len(ODD)
    assert {r.id for r in got if not r.accepted} >= {3, 4, 8}
    assert language.identify(language.document_evidence(empty), model).count() == 0
    assert language.identify(language.document_evidence(odd), language.fit(empty)).where("accepted").count() == 0


def test_evidence_decides(spark, docs):
    """A page with next to no text takes the language its host and markup speak for; garbage is und."""
    model = language.fit(docs)
    text = {r.lang: r.text for r in docs.where("n_chars > 400").select("lang", "text").collect()}
    rows = [(i, text["fr"], "fr", "fr", "x.fr", "x.fr") for i in range(30)] + [(99, "le", "fr", "fr", "x.fr", "x.fr"), (100, "qzxj kkvw zzqx jjwq xkcd vvbq " * 20, "fr", "fr", "x.fr", "x.fr")]
    got = {r.id: r.lang for r in language.identify(spark.createDataFrame(rows, "id long, text string, declared string, suffix string, domain string, host string"), model).collect()}
    assert got[99] == "fr" and got[0] == "fr" and got[100] == "und"


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "source_mix", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start = {r.doc_id: r.text for r in docs.collect()}
    kept = corpus_pipeline.language_id(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() >= 0.98 * len(start)
    lines = corpus_pipeline.line_level(spark, kept, SF)
    assert {(r.doc_id, r.text) for r in lines.collect()} == {(i, t) for i, _, n, t in brute_lines(rows_of(kept)) if t or not n}
    once = corpus_pipeline.near_copies(spark, lines, SF)
    group = brute_jaccard([(r.doc_id, r.text) for r in lines.collect()])
    assert sorted(r.doc_id for r in once.collect()) == sorted(set(group.values()))
    mixed = corpus_pipeline.source_mix(spark, once, SF)
    assert mixed.columns == docs.columns
    # all stages together give the pieces of what the mix keeps, by the tokenizers library
    encoder, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for r in mixed.collect():
        ids, at = np.array([*encoder.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for n in packing.binary_lengths(len(ids), 2048):
            want[r.doc_id, at, n, zlib.crc32(ids[at : at + n].tobytes())] += 1
            at += n
    found = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in found) == want
    assert sorted(r.sequence_id for r in found) == list(range(len(found)))


def test_digest_of_lines(spark):
    from corvane.llm.queries import op3_line_dedup

    row = op3_line_dedup(spark, SF).orderBy("doc_id").first()
    assert row.kept_sha256 == hashlib.sha256(next(t for i, _, _, t in brute_lines(rows_of(spark.read.parquet(f"{SF}/documents.parquet"))) if i == row.doc_id).encode()).hexdigest()


def test_packing_forgets_parts(docs, monkeypatch):
    """Ids stay those of the tokenizer however often parts are forgotten."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "KEPT_PARTS", 300)
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, plain = packing.PartEncoder(path), Tokenizer.from_file(path)
    texts = [r.text for r in docs.select("text").limit(60).collect()] + [t for _, t, *_ in ODD]
    for at in range(0, len(texts), 5):
        part = texts[at : at + 5]
        ids, ends = encoder.encode(pa.array(part, pa.string()))
        want = [plain.encode(t or "", add_special_tokens=False).ids for t in part]
        assert ids.tolist() == sum(want, []) and ends.tolist() == np.cumsum([len(w) for w in want]).tolist()


def brute_jaccard(source, near=0.8):
    """The smallest id of each document's group: five-word shingles, every pair that shares a shingle."""
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets, holders = {}, defaultdict(set)
    for i, t in source:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = {" ".join(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set()
        for g in sets[i] or {None}:
            holders[g].add(i)
    pairs = {(a, b) for own in holders.values() for a in own for b in own if a < b}
    linked = defaultdict(list)
    for a, b in pairs:
        if sets[a] == sets[b] or len(sets[a] & sets[b]) >= near * len(sets[a] | sets[b]):
            linked[a].append(b)
            linked[b].append(a)
    group = {}
    for i in sorted(sets):
        stack = [] if i in group else [i]
        while stack:
            x = stack.pop()
            if x not in group:
                group[x] = i
                stack += linked[x]
    return group


@pytest.mark.parametrize("cap", [64, 4])
def test_near_copies_by_jaccard(spark, monkeypatch, cap):
    """Every pair with Jaccard 0.8 or more is linked, however many SimHash bits differ, in small buckets and in large."""
    import corpus_pipeline
    from corvane.llm import jaccard

    monkeypatch.setattr(jaccard, "CAP", cap)
    rng = np.random.default_rng(3)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    base = [f"w{x}" for x in rng.integers(0, 500, 120)]
    for i in range(40):  # near copies of one text, some near enough to each other
        words = list(base)
        for at in rng.integers(0, 120, int(rng.integers(0, 5))):
            words[at] = f"x{i}"
        rows.append((10_000 + i, " ".join(words)))
    rows += [(20_000, ""), (20_001, None), (20_002, " \n"), (20_003, "Two words"), (20_004, "two  WORDS")]
    table = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], SCHEMA)
    group = brute_jaccard(rows)
    assert len(set(group.values())) < len(rows) - 60
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, table, SF).collect()) == sorted(set(group.values()))


def test_near_copies_repeated_ids(spark):
    """Null ids and repeated ids with different texts are rows of their own, and link nothing through their id."""
    import corpus_pipeline

    text = {k: " ".join(f"{k}{i}" for i in range(50)) for k in "abcdef"}
    near = {k: f"{t} more" for k, t in text.items()}
    rows = [(5, text["a"]), (9, text["b"]), (None, near["a"]), (None, near["b"]), (None, text["c"]), (None, text["d"]), (7, text["e"]), (7, text["f"]), (7, text["f"])]
    table = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, table, SF).collect())
    assert got == Counter([(5, text["a"]), (9, text["b"]), (None, text["c"]), (None, text["d"]), (7, text["e"]), (7, text["f"])])


def test_rare_language(spark):
    """A labelled language with enough rows in the whole table has a model, however small its share is."""
    texts = {"aa": "the house and the garden of the mother", "zz": "zwischen grosswagen schlaft niemand zurzeit"}
    rows = [(i, f"{texts['aa']} {i}", "aa") for i in range(9950)] + [(20_000 + i, f"{texts['zz']} {i}", "zz") for i in range(50)] + [(30_000 + i, "few", "qq") for i in range(19)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, sample=400)
    assert model.languages == ["aa", "zz"]
    scores, _ = model.scores([t.encode() for t in texts.values()])
    assert scores.argmax(1).tolist() == [0, 1]


def test_mix_small_sources(spark):
    """Beside a large source, sources of a few words and of one block and a half come to their targets."""
    import corpus_pipeline

    long = " ".join(["word"] * 2000)
    rows = [(i, long, "en", "hot", 1) for i in range(700)] + [(1000, "only three words", "en", "a", 1), (1001, "and " * 33, "en", "b", 1), (1002, "null source here", "en", None, 1)]
    got = Counter()
    for r in corpus_pipeline.source_mix(spark, spark.createDataFrame(rows, SCHEMA), SF).collect():
        got[r.source] += len(r.text.split())
    want = mixing.fill(np.array([3, 33, 1_400_000, 3]), np.array([1.0, 2.0, 3.0, 1.0]))
    assert all(abs(got[s] - t) <= 1 for s, t in zip(["a", "b", "hot", None], want, strict=True)), (got, want)


def test_pages_with_references(spark):
    """Letters written as character references are letters; a bare & takes none with it."""
    word = "привет"
    pages = [(1, "http://a.ru/", "<p>" + "".join(f"&#{ord(c)};" for c in word) + "</p>"), (2, "http://a.fr/", "caf&eacute;&nbsp;AT&T &copy; &#xe9; &amp; x"), (3, None, None)]
    rows = language.page_evidence(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert {r.id: " ".join(r.text.split()) for r in rows.collect()} == {1: word, 2: "café AT T é x", 3: ""}
    model = language.TrigramModel(["fr"], np.ones((1, language.CODES)), np.ones(256))
    assert {r.id: r.n for r in language.identify(rows, model).collect()} == {1: 12, 2: 11, 3: 0}


def test_mix_sources_of_few_words(spark):
    """op4 itself: sources of 1 to 1,000 words beside one of millions come within a few words of their targets."""
    long = " ".join(["word"] * 20_000)
    small = {"a": 1, "b": 7, "c": 90, "d": 400, "e": 1000, None: 3}
    rows = [(i, long, "en", "hot", 1) for i in range(200)] + [(1000 + i, "w " * n, "en", s, 1) for i, (s, n) in enumerate(small.items())]
    got = mixing.taken_words(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    took = Counter()
    for r in got:
        took["hot" if r.id < 1000 else [*small][r.id - 1000]] += r.taken
    order = ["a", "b", "c", "d", "e", "hot", None]
    want = mixing.fill(np.array([4_000_000 if s == "hot" else small[s] for s in order]), np.array([1.0 + i % 3 for i in range(7)]))
    assert all(abs(took[s] - t) <= 3 for s, t in zip(order, want, strict=True)), (took, want)
    assert mixing.ORACLE_SQL.count("source_size > 0") == 1


def test_mix_sql(spark, docs):
    """The oracle SQL on the same rows, with a source of one word added."""
    import duckdb

    rows = [*map(tuple, docs.select("doc_id", "text", "source").collect()), (10**6, "one", "tiny")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    documents = table.toArrow()  # noqa: F841
    want = sorted(duckdb.sql(mixing.ORACLE_SQL).fetchall())
    got = sorted((r.id, r["size"], r.source_size, r.target, r.taken) for r in mixing.taken_words(table).collect())
    assert got == [(i, a, b, pytest.approx(t), n) for i, a, b, t, n in want] and got[-1][-1] == 3


def test_empty_shards_and_written_ones(spark, empty, docs, tmp_path):
    assert shard.assign_shards(empty, 5).count() == 0
    named = docs.withColumns({"shard": F.lit("own"), "slot": F.lit("too")})
    shard.write_shards(named, str(tmp_path / "s"), 3, files=2)
    back = spark.read.parquet(str(tmp_path / "s"))
    want = {r.id: r.shard for r in shard.assign_shards(docs, 3).collect()}
    assert {r.doc_id: r.shard for r in back.collect()} == want and {"_shard", "_slot", "shard"} < set(back.columns)
    assert len(list((tmp_path / "s" / "shard=0").glob("*.parquet"))) <= 2


def test_line_threshold_and_clashing_columns(spark):
    rows = [(i, "a line in three documents\n" * (i < 3) + "a line in two documents" * (i > 0), "x", 1, [2]) for i in range(3)]
    table = spark.createDataFrame(rows, "doc_id long, text string, __id string, __t int, __drop array<int>").withColumns({"_id": F.lit(5), "__lines": F.lit(6)})
    got = {r.doc_id: r for r in line_dedup.dedup_lines(table, min_docs=3).collect()}
    assert [got[i]["__n_dropped"] for i in range(3)] == [0, 1, 1] and got[1]["__kept"] == "a line in two documents"
    assert all((r["__id"], r["__t"], r["__drop"], r["_id"], r["__lines"]) == ("x", 1, [2], 5, 6) for r in got.values())
    mixed = mixing.mix(table.withColumns({"source": F.lit("s"), "__hash": F.lit(1), "__part": F.lit(2), "__cuts": F.lit(3)}))
    assert {(r["__id"], r["__hash"], r["__part"], r["__cuts"]) for r in mixed.collect()} == {("x", 1, 2, 3)}


def fused(rows, model):
    """The fusion in plain loops: (id -> language, probability), counts without the row's own text."""
    names = [*model.languages, "und"]
    scores, n = model.scores([r.text.encode() if r.text else None for r in rows])
    start = scores + np.log([(1 - language.UND_PRIOR) / max(1, len(names) - 1)] * (len(names) - 1) + [language.UND_PRIOR])
    soft = np.exp(start - start.max(1, keepdims=True))
    soft /= soft.sum(1, keepdims=True)
    key = lambda r: tuple((x or "").lower() for x in (r.suffix, r.domain, r.host))
    out = []
    for i, r in enumerate(rows):
        others = [j for j in range(len(rows)) if j != i]
        total = soft[others].sum(0)
        prior = (total + 1) / (len(others) + len(names))
        for depth in (1, 2, 3):
            own = [j for j in others if key(rows[j])[:depth] == key(r)[:depth]]
            prior = (soft[own].sum(0) + language.KAPPA * prior) / (len(own) + language.KAPPA)
        said = [j for j in others if (rows[j].declared or "").lower() == (r.declared or "").lower()]
        log = scores[i] + np.log(prior) + np.log((soft[said].sum(0) + 0.5) / (total + 50))
        p = np.exp(log - log.max())
        out.append((r.id, names[int(np.argmax(log))] if n[i] else "und", p.max() / p.sum() if n[i] else 0.0))
    return out


def test_language_query_by_brute_force(spark):
    """op9 on sf0.001, and odd pages: undecided text with host and markup at odds, null html, null and malformed addresses."""
    from corvane.llm.queries import op9_language_id

    model = language.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {i: (a, b) for i, a, b in fused(language.page_evidence(pages).collect(), model)}
    got = {r.page_id: (r.lang, r.probability) for r in op9_language_id(spark, SF).collect()}
    assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and got[i][1] == pytest.approx(want[i][1], abs=1e-6) for i in want)
    odd = [(i, f"http://a.de/{i}", f'<html lang="de"><p>{w}') for i, w in enumerate(["die und der", "der die", "und ich", "nicht der"])]
    odd += [(10, "http://a.de/x", '<html lang="fr"><p>xq'), (11, None, None), (12, "::no address", "<p>the and of"), (13, "http://b.fr/", ""), (14, "http://a.de/", None)]
    rows = language.page_evidence(spark.createDataFrame(odd, "page_id long, url string, html string"))
    want = fused(rows.collect(), model)
    found = {r.id: (r.lang, r.probability, r.accepted) for r in language.identify(rows, model).collect()}
    assert found == {i: (a, pytest.approx(b, abs=1e-6), a != "und") for i, a, b in want}
    assert not found[11][2] and not found[13][2] and not found[14][2]


def test_trigrams_of_long_texts(monkeypatch):
    text = "Größe und Länge eines sehr langen Textes ".encode() * 30
    whole = [np.concatenate(x) for x in zip(*language.trigrams([text, None, text]), strict=True)]
    monkeypatch.setattr(language, "PIECE", 17)
    cut = [np.concatenate(x) for x in zip(*language.trigrams([text, None, text]), strict=True)]
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True)) and set(whole[2]) == {0, 2}


def test_pipeline_stages_on_odd_rows(spark, odd, empty, docs):
    """Every stage takes nulls, repeated rows and ids, odd texts, clashing columns and an empty table."""
    import corpus_pipeline

    columns = docs.columns
    mixed = odd.unionByName(docs.limit(100), allowMissingColumns=True)
    known = corpus_pipeline.language_id(spark, mixed, SF)
    rows = Counter(tuple(r) for r in mixed.select(*columns).collect())
    found = Counter(map(tuple, known.collect()))
    assert all(found[r] in (0, n) for r, n in rows.items()) and not found - rows
    assert not any((r[1] or "").strip() == "" for r in found) and sum(found.values()) >= 100
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, SF)
        assert name == "packing" or got.columns == columns
        assert stage(spark, empty, SF).count() == 0
        if name == "simhash_dedup":
            kept = Counter((r.doc_id, r.text) for r in got.collect())
            assert kept == Counter({(1, ODD[0][1]): 1, (2, ODD[1][1]): 1, (3, None): 1, (5, ODD[4][1]): 1, (6, ODD[5][1]): 1, (None, ODD[8][1]): 1, (9, ODD[10][1]): 1})
        elif name == "packing":
            assert {r.doc_id for r in got.collect()} == {r[0] for r in ODD}


def test_large_buckets(spark, monkeypatch):
    """Members of a large bucket that its first member does not link are met with all others, in chunks."""
    from corvane.llm import jaccard

    monkeypatch.setattr(jaccard, "CAP", 3)
    monkeypatch.setattr(jaccard, "CHUNK", 4)
    rng = np.random.default_rng(8)
    rows = [(g * 100 + i, " ".join([f"t{g // 3}x{j}" for j in range(30)] + [f"g{g}x{j}" for j in range(60)] + [f"i{i}"] * (i % 3))) for g in range(6) for i in range(9)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    table = spark.createDataFrame(rows, "id long, text string").select("id", F.xxhash64("text").alias("hash"), F.col("text").cast("binary").alias("t"))
    group = brute_jaccard(rows)
    got = {r.id: r["first"].id for r in jaccard.near_duplicates(table).collect()}
    assert got == group and len(set(group.values())) < len(rows) / 3


def test_parity_bound():
    from corvane.llm import jaccard

    rng = np.random.default_rng(1)
    for n, m, both in [(3, 5, 2), (300, 280, 270), (1000, 4000, 900), (600, 700, 0)]:
        pool = np.unique(rng.integers(-(2**62), 2**62, n + m - both))
        a, b = np.sort(pool[:n]), np.sort(pool[n - both :])
        assert jaccard.differing(jaccard.parity(a), jaccard.parity(b)) <= n + m - 2 * both
        assert jaccard.differing(jaccard.parity(a), jaccard.parity(a)) == 0


@pytest.mark.parametrize("id_", [None, 7])
def test_language_without_distinct_ids(spark, id_):
    """The sample does not hang on ids: a model fitted on rows without them is as right."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = language.fit(docs.withColumn("doc_id", F.lit(id_).cast("long")))
    assert set(model.languages) == {"de", "en", "es", "fr"} and np.ptp(model.logs, axis=1).min() > 1
    rows = docs.where("doc_id % 20 = 3").withColumn("own", F.col("lang")).withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string"))
    found = language.identify(language.document_evidence(rows), model).join(rows.select(F.col("doc_id").alias("id"), "own"), "id")
    assert found.where("lang = own").count() > 0.97 * found.count()


def test_language_of_one_text(spark):
    """Copies of one row are drawn once; where nothing is drawn, nothing is accepted."""
    rows = spark.createDataFrame([(None, "the same words again and again", "en", "a", 1)] * 300, SCHEMA)
    model = language.fit(rows)
    assert model.languages in ([], ["en"]) and (not model.languages or np.ptp(model.logs[0]) > 1)
    blank = language.fit(spark.createDataFrame([(i, "12 34", "en", "a", 1) for i in range(50)], SCHEMA))
    assert language.identify(language.document_evidence(rows), blank).where("accepted").count() == 0 or blank.languages == ["en"]
