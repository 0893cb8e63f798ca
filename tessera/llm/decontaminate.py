"""Benchmark decontamination by winnowing, in DataFrame expressions alone.

Words are maximal runs of letters, digits and non-ASCII characters after A-Z is lower-cased. Of every item, each
``size`` consecutive words are a window, or the whole item if it is shorter (and has words). Winnowing hashes the grams
of ``gram`` words and keeps, of every ``size - gram + 1`` neighbours, the minimum: two copies of a window have the
same one, so a document without a fingerprint of the benchmark can't hold any window of it. The fingerprints of the
documents are joined with the benchmark's; only in documents that share one, and only at the places whose window
minimum is shared, is the window itself compared, as text; matching windows that overlap chain and so extend each hit
both ways. An item of fewer than ``size`` words is winnowed at its own length (one gram, one neighbour).

The benchmark's fingerprints and windows are broadcast while their counted rows are within ``broadcast_rows``, and
shuffled beyond.

Nulls and edges: a null text has no words; an item without words has no window; rows of documents equal in key and
text are one document and get the same result; items equal in id are one item; a null item id takes no part. An empty
benchmark leaves every document clean; an empty table of documents gives an empty table. Other columns are kept by
``decontaminate`` and not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, small_or_shuffled, staged

#: What separates words, once A-Z is lower-cased, and the same before that.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
APART_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
P = "__dc_"


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), APART, -1), lambda x: x != "")


def _grams(h: str, k: int) -> Column:
    """Hash of every ``k`` neighbours of the array ``h``; null if there are fewer."""
    n = F.size(h)
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(F.lit(k), *[F.get(h, i + j) for j in range(k)])))


def _minima(g: str, w: int) -> Column:
    """Minimum of every ``w`` neighbours of the array ``g``."""
    if w == 1:
        return F.col(g)
    n = F.size(g)
    return F.when(n >= w, F.transform(F.sequence(F.lit(0), n - w), lambda i: F.least(*[F.get(g, i + j) for j in range(w)])))


def _schemes(lengths: list[int], size: int, gram: int) -> list[tuple[int, int, int]]:
    """(window length, gram, neighbours) for the window lengths that occur."""
    return [(n, gram, size - gram + 1) if n == size and size >= gram else (n, n, 1) for n in lengths]


def _with_minima(rows: DataFrame, schemes: list[tuple[int, int, int]]) -> DataFrame:
    """Adds an array column m<length> for each scheme: the fingerprint of the window that starts at each word."""
    keep = rows.columns
    rows = rows.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    rows = rows.select(*keep, *[_grams("h", k).alias(f"g{n}") for n, k, _ in schemes])
    return rows.select(*keep, *[_minima(f"g{n}", w).alias(f"m{n}") for n, _, w in schemes])


def benchmark_hits(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", size: int = 10, gram: int = 5, broadcast_rows: int = 500_000) -> DataFrame:
    """(key, t, at, size, item): the places, by word, at which a window of an item occurs; t: hash of the text."""
    own = items.where(F.col(f"`{item_key}`").isNotNull()).select(F.col(f"`{item_key}`").alias("item"), words(F.col(f"`{item_text}`")).alias("w")).where(F.size("w") > 0)
    own = own.withColumn("size", F.least(F.size("w"), F.lit(size)))
    spread = own.select("item", "size", "w", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("size"))).alias("i"))
    windows = staged(spread.select("item", "size", F.array_join(F.slice("w", F.col("i") + 1, F.col("size")), " ").alias("window")).distinct())
    lengths = sorted(r[0] for r in windows.select("size").distinct().collect())  # 1 .. size at most
    if not lengths:
        return docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(f"`{text}`").alias("t"), F.lit(0).alias("at"), F.lit(0).alias("size"), F.lit(None).cast(own.schema["item"].dataType).alias("item")).where(F.lit(False))
    schemes = _schemes(lengths, size, gram)
    marked = _with_minima(windows.select("size", F.split("window", " ").alias("w")), schemes)
    fingerprints = None
    for n, _, _ in schemes:
        x = marked.where(F.col("size") == n).select(F.lit(n).alias("size"), F.explode(f"m{n}").alias("fp"))
        fingerprints = x if fingerprints is None else fingerprints.unionByName(x)
    fingerprints = staged(fingerprints.distinct())
    n_fp, n_win = fingerprints.count(), windows.count()

    base = docs.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{key}`").alias("key"), F.xxhash64(f"`{text}`").alias("t"), F.col(f"`{text}`").alias("x"))
    arrays = _with_minima(base.select("key", "t", words(F.col("x")).alias("w")), schemes).drop("w")
    own_fps = F.concat(*[F.coalesce(F.transform(F.array_distinct(f"m{n}"), lambda x: F.struct(F.lit(n).alias("size"), x.alias("fp"))), F.array().cast("array<struct<size:int,fp:bigint>>")) for n, _, _ in schemes])
    shared = arrays.select("key", "t", F.explode(own_fps).alias("f")).select("key", "t", "f.size", "f.fp").join(small_or_shuffled(fingerprints, n_fp, broadcast_rows), ["size", "fp"])
    by_doc = staged(shared.groupBy("key", "t").agg(F.collect_set(F.struct("size", "fp")).alias("shared")))

    again = base.join(by_doc, base["key"].eqNullSafe(by_doc["key"]) & (base["t"] == by_doc["t"])).select(base["key"], base["t"], "shared", words(F.col("x")).alias("w")).dropDuplicates(["key", "t"])
    again = _with_minima(again, schemes)
    places = None
    for n, _, _ in schemes:
        at = F.filter(F.transform(f"m{n}", lambda m, i: F.when(F.array_contains("shared", F.struct(F.lit(n).alias("size"), m.alias("fp"))), i)), lambda i: i.isNotNull())
        x = again.select("key", "t", F.lit(n).alias("size"), "w", F.explode(at).alias("at")).select("key", "t", "size", "at", F.array_join(F.slice("w", F.col("at") + 1, n), " ").alias("window"))
        places = x if places is None else places.unionByName(x)
    return places.join(small_or_shuffled(windows, n_win, broadcast_rows), ["size", "window"]).select("key", "t", "at", "size", "item")


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", size: int = 10, gram: int = 5) -> DataFrame:
    """For each document with a hit: (key, t, n_hit, items); n_hit: words inside a matching window; items: ids as text, sorted."""
    hits = staged(benchmark_hits(docs, items, key, text, item_key, item_text, size, gram))
    spans = hits.groupBy("key", "t", "at").agg(F.max(F.col("at") + F.col("size")).alias("end"))
    before = F.max("end").over(Window.partitionBy("key", "t").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("at", F.coalesce(before, F.lit(0))))
    covered = spans.select("key", "t", fresh.alias("n")).groupBy("key", "t").agg(F.sum("n").alias("n_hit"))
    found = hits.select("key", "t", F.col("item").cast("string").alias("item")).distinct().groupBy("key", "t").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return covered.withColumnRenamed("key", "k2").withColumnRenamed("t", "t2").join(found, F.col("k2").eqNullSafe(F.col("key")) & (F.col("t2") == F.col("t"))).select("key", "t", "n_hit", "items")


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", size: int = 10, gram: int = 5) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``items`` (sorted ids as text) and ``contaminated`` added; columns of these
    names are replaced."""
    add = ("n_words", "n_hit", "items", "contaminated")
    found = contamination(docs, items, key, text, item_key, item_text, size, gram).select(*[F.col(c).alias(P + c) for c in ("key", "t", "n_hit", "items")])
    n = F.size(F.filter(F.split(F.col(f"`{text}`"), APART_ANY_CASE, -1), lambda x: x != ""))
    # counted before the join, so that a caller who doesn't take the text doesn't shuffle it either
    counted = docs.withColumn(f"{P}n", F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)).cast("bigint")).withColumn(f"{P}own", F.xxhash64(f"`{text}`"))
    joined = counted.join(found, F.col(f"`{key}`").eqNullSafe(F.col(f"{P}key")) & (F.col(f"{P}own") == F.col(f"{P}t")), "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in add],
        F.col(f"{P}n").alias("n_words"),
        F.coalesce(F.col(f"{P}n_hit"), F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce(F.col(f"{P}items"), F.array().cast("array<string>")).alias("items"),
        F.col(f"{P}n_hit").isNotNull().alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", size: int = 10, gram: int = 5, broadcast_rows: int = 2_000_000) -> DataFrame:
    """The rows of ``docs`` without a hit."""
    hits = benchmark_hits(docs, items, key, text, item_key, item_text, size, gram)
    found = staged(hits.select(F.col("key").alias(f"{P}key"), F.col("t").alias(f"{P}t")).distinct())
    same = F.col(f"`{key}`").eqNullSafe(F.col(f"{P}key")) & (F.xxhash64(f"`{text}`") == F.col(f"{P}t"))
    return docs.join(small_or_shuffled(found, found.count(), broadcast_rows), same, "left_anti")


#: Whole documents against the whole benchmark, windows of 10 words.
SQL = r"""
with dw as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
),
iw as (
  select item_id, w, least(len(w), 10) as size from (
    select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
  ) where len(w) > 0
),
windows as (
  select distinct item_id, size, array_to_string(w[i:i + size - 1], ' ') as g
  from iw, unnest(range(1, len(w) - size + 2)) as r(i)
),
places as (
  select doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') as g
  from dw, (select distinct size from windows), unnest(range(1, len(w) - size + 2)) as r(i)
),
hits as (select distinct doc_id, i, size, item_id from places join windows using (size, g)),
covered as (select doc_id, count(distinct i + j) as n_hit from hits, unnest(range(size)) as r(j) group by 1),
found as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by 1
)
select d.doc_id, coalesce(len(dw.w), 0)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
       coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from documents d join dw using (doc_id) left join covered using (doc_id) left join found using (doc_id)
"""
