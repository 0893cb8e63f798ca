"""Column expressions over ``array<double>`` vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 if either vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), l2norm(a) * l2norm(b)), F.lit(0.0))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 if either vector is zero."""
    return 1 - cosine(a, b)


def unit(v: Column | str) -> Column:
    """``v`` over its length; a zero vector stays."""
    return F.transform(F.arrays_zip(col(v).alias("x"), F.array_repeat(l2norm(v), F.size(col(v))).alias("n")), lambda s: F.coalesce(F.try_divide(s["x"], s["n"]), F.lit(0.0)))


def vector_sum(df: DataFrame, keys: list[str], vector: str, weight: Column | None = None) -> DataFrame:
    """(keys, pos, total): sums by component, with partial sums before the shuffle."""
    rows = df.select(*keys, F.posexplode(vector).alias("pos", "x"), *([weight.alias("w")] if weight is not None else []))
    return rows.groupBy(*keys, "pos").agg(F.sum(F.col("x") * F.col("w") if weight is not None else F.col("x")).alias("total"))


def gather(sums: DataFrame, keys: list[str], out: str, value: Column | None = None) -> DataFrame:
    """Components (pos, total) back to one array for each group, which is as long as a vector."""
    pairs = F.array_sort(F.collect_list(F.struct("pos", (value if value is not None else F.col("total")).alias("v"))))
    return sums.groupBy(*keys).agg(F.transform(pairs, lambda p: p["v"]).alias(out))
