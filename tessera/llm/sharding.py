"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a 60-bit hash of the key. A bucket that holds more than ``limit`` bytes
splits on its next bit, and only such a bucket does, until each fits or all its rows have one hash, which no further bit
can part. One pass sums bytes by the finest prefix that the total calls for; coarser levels are sums of finer ones; a
cell's depth is the number of its prefixes that split. Cells that still split at that level are taken up again from
their own rows with further bits.

A bucket of one hash over the limit becomes a chain of overflow shards. A row of more than half the limit has a shard of
its own; the others are cut where their running sum passes a multiple of half the limit, so a shard holds less than half
from the rows before its last one and at most half from that one. Only a single row larger than the limit is in a shard
over the limit: it can't be split. A chain of many rows is dealt into parts of about CHAIN rows which are cut apart from
each other, and the numbers of a part's shards follow those of the parts before, so no task sees a whole hot key.

Only (key hash, bytes) rows move; texts never do. The directory has a row for each shard, joined by prefix and not
collected.

Nulls and edges: a null text has 0 bytes; a null key is hashed as the text 'null'; repeated rows stay, each counted;
very long texts are only measured; ties in size go by place of the row; an empty table gives an empty table; a table
that fits gives one shard '' of depth 0. Columns beside the key and the text are kept, those named like an added column
are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_staged, staged

BITS = 60
CHAIN = 100_000
P = "__sh_"


def key_hash(key: Column) -> Column:
    """60 bits, the first 15 hexadecimal digits of MD5, which every engine has."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def _prefix(h: Column, depth: int | Column) -> Column:
    """The leading ``depth`` of BITS bits."""
    by = F.lit(BITS) - depth
    return F.call_function("shiftright", h, by.cast("int"))


def _depths(rows: DataFrame, base: int, level: int, limit: int) -> DataFrame:
    """(cell, depth, over): of every prefix of ``level`` bits among ``rows`` (h, n), below prefixes of ``base`` bits that
    are known to split, the depth of its bucket; over: it splits at ``level`` too."""
    whole = [F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    cells = staged(rows.select(_prefix(F.col("h"), level).alias("cell"), "n", F.col("h").alias("lo"), F.col("h").alias("hi")).groupBy("cell").agg(*whole))
    over = None
    sums = cells.select(F.lit(level).alias("d"), F.col("cell").alias("p"), "n", "lo", "hi")
    for d in range(level, base - 1, -1):
        if d < level:
            sums = sums.groupBy(F.lit(d).alias("d"), F.call_function("shiftright", "p", F.lit(1)).alias("p")).agg(*whole)
        if d % 4 == 0:
            sums = staged(sums)
        full = sums.where((F.col("n") > limit) & (F.col("lo") < F.col("hi"))).select("d", "p")
        over = full if over is None else over.unionByName(full)
    above = cells.select("cell", F.explode(F.sequence(F.lit(base), F.lit(level))).alias("d")).withColumn("p", F.call_function("shiftright", "cell", (F.lit(level) - F.col("d")).cast("int")))
    counted = above.join(over, ["d", "p"]).groupBy("cell").agg(F.count(F.lit(1)).alias("k"), F.max("d").alias("deep"))
    return cells.join(counted, "cell", "left").select("cell", (F.lit(base) + F.coalesce("k", F.lit(0))).cast("int").alias("depth"), (F.coalesce("deep", F.lit(-1)) == level).alias("over"))


def _chained(rows: DataFrame, limit: int, chain: int) -> DataFrame:
    """``rows`` (with shard, n, i) of buckets of one hash over the limit, with the number of their ``overflow`` shard."""
    half = max(1, limit // 2)
    many = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("m")).select("shard", F.ceil(F.col("m") / chain).alias("parts"))
    rows = rows.join(many, "shard").withColumn("part", F.pmod(F.xxhash64("i"), F.col("parts"))).withColumn("alone", F.col("n") > half)
    order = Window.partitionBy("shard", "alone", "part").orderBy("n", "i")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.when(F.col("alone"), F.row_number().over(order) - 1).otherwise(F.floor(before / half)).cast("bigint")
    rows = rows.withColumn("own", own)
    parts = rows.groupBy("shard", "alone", "part").agg((F.max("own") + 1).alias("pages"))
    earlier = Window.partitionBy("shard").orderBy("alone", "part").rowsBetween(Window.unboundedPreceding, -1)
    first = parts.select("shard", "alone", "part", F.coalesce(F.sum("pages").over(earlier), F.lit(0)).alias("first"))
    return rows.join(first, ["shard", "alone", "part"]).withColumn("overflow", F.col("first") + F.col("own")).drop("parts", "part", "alone", "own", "first")


def shard(docs: DataFrame, limit: int = 32 << 20, key: str = "doc_id", text: str = "text", chain: int = CHAIN) -> DataFrame:
    """``docs`` without its text but with ``n_bytes``, ``depth``, ``shard`` (the prefix as bits), ``overflow`` (0, or the
    number of an overflow shard) and ``shard_bytes``, the bytes of the row's own shard."""
    add = ("n_bytes", "depth", "shard", "overflow", "shard_bytes")
    rest = [c for c in docs.columns if c not in (text, *add)]
    # under names of its own, so that none of the caller's can clash
    rows = docs.select(
        *[F.col(f"`{c}`").alias(f"{P}{i}") for i, c in enumerate(rest)],
        key_hash(F.col(f"`{key}`")).alias("h"),
        F.coalesce(F.octet_length(f"`{text}`"), F.lit(0)).cast("bigint").alias("n"),
        F.monotonically_increasing_id().alias("i"),
    )
    rows = staged(rows)
    total = rows.agg(F.sum("n")).first()[0] or 0
    base, level = 0, min(BITS, max(1, math.ceil(math.log2(max(1, total) / limit + 1)) + 3))
    todo, done = rows, []
    while True:
        cells = staged(_depths(todo.select("h", "n"), base, level, limit))
        here = todo.withColumn("cell", _prefix(F.col("h"), level)).join(cells, "cell").drop("cell")
        done.append(here.where("not over").drop("over"))
        if not cells.where("over").take(1):
            break
        todo = staged(here.where("over").drop("over", "depth"))
        base, level = level + 1, min(BITS, level + 8)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    bucket = F.call_function("shiftright", "h", (F.lit(BITS) - F.col("depth")).cast("int"))
    out = staged(out.withColumn("shard", F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.conv(bucket.cast("string"), 10, 2), F.col("depth"), F.lit("0")))))
    drop_staged(rows)
    out = out.join(out.groupBy("shard").agg(F.sum("n").alias("shard_bytes")), "shard")
    fits = out.where(F.col("shard_bytes") <= limit).withColumn("overflow", F.lit(0).cast("bigint"))
    large = staged(_chained(out.where(F.col("shard_bytes") > limit).drop("shard_bytes"), limit, chain))
    large = large.join(large.groupBy("shard", "overflow").agg(F.sum("n").alias("shard_bytes")), ["shard", "overflow"])
    out = fits.unionByName(large)
    return out.select(*[F.col(f"{P}{i}").alias(c) for i, c in enumerate(rest)], F.col("n").alias("n_bytes"), "depth", "shard", "overflow", "shard_bytes")


#: Depths from the sums of every prefix; for chains of fewer rows than CHAIN.
SQL = """
with d as (
  select doc_id, coalesce(strlen(text), 0)::bigint as n_bytes,
         ('0x' || substr(md5(cast(doc_id as varchar)), 1, 15))::bigint as h
  from documents
),
levels as (
  select doc_id, d, sum(n_bytes) over w as n, min(h) over w < max(h) over w as parts
  from d, unnest(range(0, 60)) as r(d) window w as (partition by d, h >> (60 - d))
),
depths as (select doc_id, count(*) filter (n > {limit} and parts)::int as depth from levels group by 1),
placed as (
  select doc_id, n_bytes, depth, h >> (60 - depth) as bucket,
         case when depth = 0 then '' else right(bin(h | (1::bigint << 61)), 60)[1:depth] end as shard,
         sum(n_bytes) over (partition by depth, h >> (60 - depth)) as total, n_bytes > {limit} // 2 as alone
  from d join depths using (doc_id)
),
numbered as (
  select *, case when total <= {limit} then 0
                 when alone then row_number() over (partition by depth, bucket, alone order by n_bytes, doc_id) - 1
                 else coalesce(sum(n_bytes) over (partition by depth, bucket, alone order by n_bytes, doc_id rows between unbounded preceding and 1 preceding), 0) // greatest(1, {limit} // 2)
            end as own
  from placed
),
paged as (
  select *, (own + case when total > {limit} and alone then coalesce(max(case when not alone then own + 1 end) over (partition by depth, bucket), 0) else 0 end)::bigint as overflow
  from numbered
)
select doc_id, n_bytes, depth, shard, overflow, sum(n_bytes) over (partition by depth, bucket, overflow)::bigint as shard_bytes
from paged
"""
