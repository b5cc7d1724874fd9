"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Each source's documents, in a seeded order, form one stream of words that is cut into blocks of B words, where B
divides all words into about 65,536 blocks (more with many sources), but the smallest source that has words into FINE blocks
at least (so B is one word beside a source of fewer), unless it is given.  So every source comes within about three
of its own FINE blocks, or a few words, of its target.
Blocks are awarded one by one to the source with
the highest quotient target / (2 j + 1), j being the blocks it has; a source can have each of its blocks 3 times at
most.  The sequence of awards is cut into equal runs, one for each shard of the mix, which gives integer quotas per
shard (the method never takes a block back when the total grows).  A source's quota is so many whole passes over its
blocks and a seeded run of blocks for the rest; as documents are in seeded order already, at most three documents of
a source are cut at the run's ends.

The allocation sees one row a source and runs in one task on an executor; over SOURCES of them it raises ValueError.
Documents meet it in an ordinary join.

Defined cases: a null text or one without words has size 0 and nothing is taken of it; a null source is a source and
comes last in the order of weights; rows that repeat an id are separate rows; an empty table gives no rows; a table
without any word gives targets of 0; other columns are ignored (or, by ``mix``, carried along).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._shared import buckets_for, fresh, id_column, materialise, ranked, source_key, split_words

BLOCKS = 65_536
FINE = 256
MOST = 3
SOURCES = 1_000_000


def fill(sizes: np.ndarray, weights: np.ndarray, most: int = MOST) -> np.ndarray:
    """Share sum(sizes) by weight; what passes most x size is shared anew until nothing does."""
    caps = (most * sizes).astype(np.float64)
    order = np.lexsort((np.arange(len(sizes)), caps / weights))
    total, weight = float(sizes.sum()), float(weights.sum())
    level = 0.0
    for i in order:
        level = total / weight
        if caps[i] / weights[i] >= level:
            break
        total, weight = total - caps[i], weight - float(weights[i])
    return np.minimum(caps, level * weights)


def apportion(targets: np.ndarray, caps: np.ndarray, seats: int) -> np.ndarray:
    """Sainte-Lague: the seats highest quotients target / (2 j + 1), j < cap; ties to the earlier source."""
    seats = min(int(seats), int(caps.sum()))
    given = np.zeros(len(targets), np.int64)
    if seats <= 0 or not targets.any():
        return given

    def held(divisor: float) -> np.ndarray:
        return np.minimum(caps, np.floor(targets / divisor + 0.5)).astype(np.int64)

    low, high = float(targets.sum()) / (4.0 * seats) / 2**20, 4.0 * float(targets.max())
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if held(mid).sum() > seats else (low, mid)
    given = held(high * (1 + 1e-12))
    while given.sum() < seats:
        best = int(np.argmax(np.where(given < caps, targets / (2 * given + 1), -1.0)))
        if given[best] >= caps[best]:
            break
        given[best] += 1
    return given


def allocate(table: pd.DataFrame, weights: tuple[float, ...], shards: int, seed: int, block: int | None = None) -> pd.DataFrame:
    """One row a source (key, size) -> its target, blocks, quota, seeded start and quotas per shard."""
    table = table.sort_values("key", key=lambda s: s.map(lambda x: x.encode())).reset_index(drop=True)
    sizes = table["size"].to_numpy(np.int64)
    weight = np.array([weights[i % len(weights)] for i in range(len(table))], np.float64)
    targets = fill(sizes, weight)
    if len(table) > SOURCES:
        raise ValueError(f"{len(table)} sources; one task allocates {SOURCES} at most")
    least = int(sizes[sizes > 0].min(initial=sizes.max(initial=0)))
    block = block or max(1, min(-(-int(sizes.sum()) // max(BLOCKS, 256 * len(table))), least // FINE))
    blocks = -(-sizes // block)
    seats = (int(sizes.sum()) + block // 2) // block
    upto = [apportion(targets, MOST * blocks, seats * k // shards) for k in range(shards + 1)]
    start = [int(hashlib.md5(f"{seed}:{k}".encode()).hexdigest()[:8], 16) % max(1, n) for k, n in zip(table["key"], blocks, strict=True)]
    return table.assign(source_size=sizes, target=targets, block=block, blocks=blocks, quota=upto[-1], start=start, shard_quotas=[np.diff([u[i] for u in upto]).tolist() for i in range(len(table))])


ALLOCATION = "key string, size long, source_size long, target double, block long, blocks long, quota long, start long, shard_quotas array<long>"


def allocation(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), shards: int = 16, seed: int = 11, block: int | None = None) -> DataFrame:
    """sizes(key, size) of all documents -> one row a source."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if frames := [x for x in parts if len(x)]:
            yield allocate(pd.concat(frames), weights, shards, seed, block)

    return sizes.groupBy("key").agg(F.sum("size").alias("size")).coalesce(1).mapInPandas(run, ALLOCATION)


def block_schedule(allocated: DataFrame) -> DataFrame:
    """(key, copy, block, shard): each block copy of the mix and the shard it goes to."""
    ends = "aggregate(slice(shard_quotas, 1, {}), 0L, (a, x) -> a + x)"
    copies = allocated.where("quota > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1)).alias("copy"))
    shard = F.expr(f"size(filter(transform(sequence(1, size(shard_quotas)), i -> {ends.format('i')}), e -> e <= copy))")
    return copies.select("key", "copy", F.expr("(start + copy) % blocks").alias("block"), shard.alias("shard"))


def taken_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), shards: int = 16, seed: int = 11, block: int | None = None) -> DataFrame:
    """(id, hash, size, source_size, target, taken, passes, cuts): cuts are word ranges [a, b) taken beyond the passes.

    ``hash`` is the text's hash, which tells rows apart that repeat an id.
    """
    base = materialise(docs.select(id_column(id_col).alias("__id"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"), source_key(source_col).alias("key"), split_words(F.col(text_col)).alias("size")))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__id").cast("string")))
    buckets = buckets_for(base.count())
    streamed = base.withColumn("__h", order).withColumn("__bucket", F.expr(f"cast(conv(substr(__h, 1, 8), 16, 10) as long) * {buckets} div 4294967296"))
    placed = ranked(streamed, ["key"], ["__bucket"], [F.col("__h"), F.col("__id"), F.col("hash"), F.col("size")], "size")
    allocated = materialise(allocation(base.select("key", "size"), weights, shards, seed, block))
    out = placed.join(allocated.drop("size", "shard_quotas"), "key").withColumns({"__end": F.col("__before") + F.col("size"), "passes": F.expr("if(blocks = 0, 0L, quota div blocks)"), "__run": F.expr("if(blocks = 0, 0L, quota % blocks)")})
    first = F.expr("named_struct('a', greatest(start * block, __before), 'b', least((start + __run) * block, __end))")
    wrapped = F.expr("named_struct('a', __before, 'b', least((start + __run - blocks) * block, __end))")
    cuts = F.expr("transform(filter(array(__first, __wrapped), x -> x.a < x.b), x -> named_struct('a', x.a - __before, 'b', x.b - __before))")
    out = out.withColumns({"__first": first, "__wrapped": wrapped}).withColumn("cuts", cuts)
    taken = F.expr("passes * size + aggregate(cuts, 0L, (s, x) -> s + x.b - x.a)")
    return out.select("__id", "id", "hash", "size", "source_size", "target", taken.alias("taken"), "passes", "cuts")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs as the mix has them: a row for each whole pass, and for each word range taken beyond those.

    A document that the mix leaves out has no row; a part has the words of its range with the white space between.
    """
    names = dict(zip(("id", "hash", "size", "passes", "cuts", "part"), fresh(docs, "id", "hash", "size", "passes", "cuts", "part"), strict=True))
    key = [names["id"], names["hash"]]
    plan = taken_words(docs, id_col, text_col, **options).where("taken > 0").groupBy(F.col("__id").alias(key[0]), F.col("hash").alias(key[1]))
    plan = plan.agg(F.max("size").alias(names["size"]), F.sum("passes").alias(names["passes"]), F.flatten(F.collect_list("cuts")).alias(names["cuts"]))
    once = docs.withColumns({key[0]: id_column(id_col), key[1]: F.xxhash64(text_col)}).dropDuplicates(key)  # the plan has all its rows
    whole = F.expr("transform(if({passes} > 0, sequence(1L, {passes}), array()), i -> named_struct('a', 0L, 'b', {size}))".format(**names))
    parts = F.concat(whole.cast("array<struct<a:bigint,b:bigint>>"), F.col(names["cuts"]))
    part = once.join(plan, key).withColumn(names["part"], F.explode(parts))

    @F.pandas_udf("string")
    def words_of(text: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([t if t is None else word_range(t, i, j) for t, i, j in zip(text, a, b, strict=True)])

    a, b = F.col(f"{names['part']}.a"), F.col(f"{names['part']}.b")
    full = b - a >= F.col(names["size"])
    cut = words_of(F.when(~full, F.col(text_col)), a, b)  # Python sees the texts that are cut alone
    return part.withColumn(text_col, F.when(full, F.col(text_col)).otherwise(cut)).drop(*names.values())


def word_range(text: str, a: int, b: int) -> str:
    """Words a to b (exclusive) of text, white space between them as it was."""
    import re

    start, end = 0, 0
    for i, m in enumerate(re.finditer(r"[^\x20\x09-\x0D]+", text)):
        if i == a:
            start = m.start()
        if i == b - 1:
            end = m.end()
            break
    return text[start:end]


#: DuckDB SQL for taken_words() over documents with the default parameters.
ORACLE_SQL = r"""
with recursive docs as (
  select doc_id, case when source is null then '1' else '0' || source end as key,
    cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
sources as (select key, cast(sum(size) as bigint) as source_size from docs group by key),
weighted as (select *, cast((row_number() over (order by key) - 1) % 3 + 1 as double) as weight, cast(3 * source_size as double) as cap, row_number() over (order by key) - 1 as pos from sources),
ordered as (select *, row_number() over (order by cap / weight, pos) - 1 as i, sum(source_size) over () as total, sum(weight) over () as weights from weighted),
levels as (
  select *, (total - coalesce(sum(cap) over (order by i rows between unbounded preceding and 1 preceding), 0))
    / (weights - coalesce(sum(weight) over (order by i rows between unbounded preceding and 1 preceding), 0)) as level from ordered),
filled as (select coalesce(min_by(level, i) filter (cap / weight >= level), max_by(level, i)) as level from levels),
targets as (select key, pos, source_size, least(cap, (select level from filled) * weight) as target from weighted),
sized as (
  select *, greatest(1, least(cast(ceil((select sum(source_size) from sources) / greatest(65536, 256 * (select count(*) from sources))) as bigint),
    (select min(source_size) from sources where source_size > 0) // 256)) as block from targets),
blocked as (select *, cast(ceil(source_size / block) as bigint) as blocks from sized),
seats as (select cast(((select sum(source_size) from sources) + max(block) // 2) // max(block) as bigint) as seats from blocked),
quotients as (select key, pos, target / (2 * j + 1) as quotient from (select key, pos, target, unnest(range(3 * blocks)) as j from blocked)),
awarded as (select key, count(*) as quota from (select key, row_number() over (order by quotient desc, pos) as r from quotients where quotient > 0) where r <= (select seats from seats) group by key),
plan as (
  select b.*, coalesce(a.quota, 0) as quota, case when blocks = 0 then 0 else cast('0x' || substr(md5('11:' || b.key), 1, 8) as bigint) % blocks end as start
  from blocked b left join awarded a using (key)),
streams as (
  select doc_id, key, size, cast(coalesce(sum(size) over (partition by key order by md5('11:' || doc_id), doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as before from docs),
joined as (select *, before + size as ending, case when blocks = 0 then 0 else quota // blocks end as passes, case when blocks = 0 then 0 else quota % blocks end as run from streams join plan using (key))
select doc_id, size, source_size, target,
  cast(passes * size + greatest(0, least((start + run) * block, ending) - greatest(start * block, before))
    + greatest(0, least((start + run - blocks) * block, ending) - before) as bigint) as taken
from joined
"""
