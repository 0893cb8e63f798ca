"""Grouping rows into scenes and putting texts together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import points_in, stable_majority


def group_by_flag(df: DataFrame, keys: list[str], order: str, flag: Column, out: str = "group_id") -> DataFrame:
    """``df`` with a number that goes up at each row whose flag holds; the first row starts group 0 whatever its flag."""
    w = Window.partitionBy(*keys).orderBy(order)
    first = F.row_number().over(w) == 1
    return df.withColumn("start__", F.when(first | F.coalesce(flag, F.lit(False)), 1).otherwise(0)).withColumn(out, F.sum("start__").over(w) - 1).drop("start__")


def canonical_id(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, canonical, aliases): the most frequent value and the others in the order first seen; a group without values is
    named after its first second."""
    top = stable_majority(df, keys, value, order).select(*keys, F.col(value).alias("top__"))
    seen = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order).alias("seen__"))
    names = seen.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("seen__", value))), lambda x: x[value]).alias("names__"))
    start = df.groupBy(*keys).agg(F.min(order).alias("from__"))
    rows = start.join(top, keys, "left").join(names, keys, "left")
    fallback = F.concat(F.lit("scene_at_"), F.floor("from__").cast("string"), F.lit("s"))
    return rows.select(*keys, F.coalesce("top__", fallback).alias("canonical"), F.coalesce(F.filter("names__", lambda x: x != F.col("top__")), F.array().cast("array<string>")).alias("aliases"))


def snap_groups(groups: DataFrame, extent: DataFrame, key: str) -> DataFrame:
    """(key, group, start_s, end_s): neighbours meet halfway, the first and last reach the extent (key, lo, hi)."""
    w = Window.partitionBy(key).orderBy("start_s", "end_s")
    rows = groups.join(extent, key)
    before, after = F.lag("end_s").over(w), F.lead("start_s").over(w)
    return rows.withColumn("a__", F.coalesce((before + F.col("start_s")) / 2, F.least("lo", "start_s"))).withColumn("b__", F.coalesce((F.col("end_s") + after) / 2, F.greatest("hi", "end_s"))).withColumn("start_s", F.col("a__")).withColumn("end_s", F.col("b__")).drop("a__", "b__", "lo", "hi")


def balanced_batches(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``df`` with ``batch``: consecutive rows in max(1, round(n / 4)) nearly equal batches, one for up to five rows."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("n__", F.count(F.lit(1)).over(w)).withColumn("i__", F.row_number().over(w.orderBy(order)) - 1)
    rows = rows.withColumn("k__", F.when(F.col("n__") <= 5, 1).otherwise(F.greatest(F.lit(1), F.bround(F.col("n__") / 4).cast("int"))))
    size, rest = F.floor(F.col("n__") / F.col("k__")), F.col("n__") % F.col("k__")
    wide = rest * (size + 1)
    batch = F.when(F.col("i__") < wide, F.floor(F.col("i__") / (size + 1))).otherwise(rest + F.floor((F.col("i__") - wide) / size))
    return rows.withColumn("batch", batch.cast("int")).drop("n__", "i__", "k__")


def disambiguate(df: DataFrame, keys: list[str], name: str, order: str) -> DataFrame:
    """``df`` with the second and later rows of one ``name`` renamed after their start."""
    nth = F.row_number().over(Window.partitionBy(*keys, name).orderBy(order))
    return df.withColumn(name, F.when(nth > 1, F.concat(F.col(name), F.lit("__at_"), F.floor(order).cast("string"), F.lit("s"))).otherwise(F.col(name)))


def ordered_distinct(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, items): values that aren't null in the order first seen."""
    seen = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order).alias("seen__"))
    return seen.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("seen__", value))), lambda x: x[value]).alias("items"))


def fallback_summary(df: DataFrame, keys: list[str], text: str, order: str, most: int = 800) -> DataFrame:
    """(keys, summary): distinct texts in order, cut at ``most`` characters with three dots."""
    body = F.array_join("items", " ")
    return ordered_distinct(df, keys, text, order).select(*keys, F.when(F.length(body) > most, F.concat(F.substring(body, 1, most), F.lit("..."))).otherwise(body).alias("summary"))


def resolve_participants(df: DataFrame, cast: DataFrame, name: str) -> DataFrame:
    """``df`` with ``member``: of (member) the one equal to the name, to what is before a bracket, or to it in any case."""
    exact = cast.select(F.col("member").alias("m1"))
    folded = cast.groupBy(F.lower("member").alias("low__")).agg(F.min("member").alias("m3"))
    head = F.trim(F.split(F.col(name), r"\(")[0])
    rows = df.withColumn("head__", head).join(exact, F.col(name) == F.col("m1"), "left").join(cast.select(F.col("member").alias("m2")), F.col("head__") == F.col("m2"), "left")
    return rows.join(folded, F.lower(F.trim(F.col(name))) == F.col("low__"), "left").withColumn("member", F.coalesce("m1", "m2", "m3")).drop("m1", "m2", "m3", "low__", "head__")


def grade_quality(df: DataFrame, stops: str, level: str, flags: list[str]) -> DataFrame:
    """``df`` with ``quality``: mean of what there is of stops / 8, low-med-high as 0.3-0.6-1, and the flags as 0 or 1."""
    lev = F.when(F.col(level) == "low", 0.3).when(F.col(level) == "med", 0.6).when(F.col(level) == "high", 1.0)
    have = F.array_compact(F.array(F.when(F.col(stops).isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(stops) / 8))), lev, *[F.col(c).cast("double") for c in flags]))
    return df.withColumn("quality", F.try_divide(F.aggregate(have, F.lit(0.0), lambda s, x: s + x), F.size(have)))


def usability(scenes: DataFrame, grades: DataFrame, segments: DataFrame, keys: list[str], sid: str, bucket: float) -> DataFrame:
    """(keys, sid, usability): 0.6 of the mean quality of grades (at, quality) in a scene and 0.4 of the mean confidence of
    segments (at, confidence) in it, each 0.5 if there are none."""
    mean = lambda rows, c, out: points_in(scenes, rows, keys, "start_s", "end_s", "at_u", bucket).groupBy(*keys, sid).agg(F.avg(c).alias(out))
    out = scenes.select(*keys, sid).join(mean(grades, "quality", "q"), [*keys, sid], "left").join(mean(segments, "confidence", "c"), [*keys, sid], "left")
    value = 0.6 * F.coalesce("q", F.lit(0.5)) + 0.4 * F.coalesce("c", F.lit(0.5))
    return out.select(*keys, sid, F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)).alias("usability"))


def first_sentences(text: Column, n: int = 3) -> Column:
    return F.array_join(F.slice(F.split(F.trim(text), r"(?<=[.!?])\s+"), 1, n), " ")


def batches(df: DataFrame, keys: list[str], order: str, value: str, n: int) -> DataFrame:
    """(keys, batch, items): values in order, ``n`` at a time."""
    rows = df.withColumn("i__", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).withColumn("batch", F.floor(F.col("i__") / n).cast("int"))
    return rows.groupBy(*keys, "batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("i__", value))), lambda x: x[value]).alias("items"))


def pending(context: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return context.join(done.select(*keys), keys, "left_anti")


def recent_digest(df: DataFrame, keys: list[str], order: str, text: Column, n: int = 3) -> DataFrame:
    """(keys, digest): the texts of the last ``n`` rows, oldest first, a line each."""
    rows = df.withColumn("r__", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where(F.col("r__") <= n).withColumn("t__", text)
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("r__")).alias("o"), "t__"))), lambda x: x["t__"]), "\n").alias("digest"))


def shards(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """``df`` with ``shard``: consecutive rows, ceil(count / n) in each."""
    w = Window.partitionBy(*keys)
    return df.withColumn("shard", F.floor((F.row_number().over(w.orderBy(order)) - 1) / F.ceil(F.count(F.lit(1)).over(w) / n)).cast("int"))


def prune_frame(df: DataFrame, keep: list[str], nested: str, fields: list[str]) -> DataFrame:
    """Only the columns ``keep`` and, of the structs in ``nested``, the ``fields``."""
    return df.select(*keep, F.transform(nested, lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(nested))
