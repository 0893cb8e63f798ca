"""New states of tables from changes: ``new = f(current, changes)``, to be written over the partitions concerned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(current: DataFrame, new: DataFrame, keys: list[str], coalesce: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``new`` over those of equal keys; of columns in ``coalesce`` the old value stays where the new one is null, of
    those in ``keep`` (such as a generated id) it stays if there is one. Keys are unique on each side."""
    rest = [c for c in current.columns if c not in keys]
    a = current.select(*keys, *[F.col(c).alias(f"{c}__old") for c in rest], F.lit(True).alias("in__old"))
    b = new.select(*keys, *[F.col(c).alias(f"{c}__new") for c in rest], F.lit(True).alias("in__new"))

    def value(c: str) -> Column:
        old, fresh = F.col(f"{c}__old"), F.col(f"{c}__new")
        if c in keep:
            return F.coalesce(old, fresh)
        return F.coalesce(fresh, old) if c in coalesce else F.when(F.col("in__new"), fresh).otherwise(old)

    return a.join(b, keys, "full").select(*keys, *[value(c).alias(c) for c in rest]).select(*current.columns)


def upsert_if(current: DataFrame, new: DataFrame, keys: list[str], condition: Column) -> tuple[DataFrame, DataFrame]:
    """(state, refused): as upsert(), but a row of ``current`` for which ``condition`` fails stays, and the new one is refused."""
    held = current.where(~F.coalesce(condition, F.lit(False))).select(*keys)
    return upsert(current, new.join(held, keys, "left_anti"), keys), new.join(held, keys, "left_semi")


def insert_ignore(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return current.unionByName(new.join(current.select(*keys), keys, "left_anti"))


def dedup_latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Of each key the first row in ``order``."""
    return df.withColumn("rn__", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rn__ = 1").drop("rn__")


def cascade_delete(doomed: DataFrame, chain: list[tuple[DataFrame, str, str]]) -> list[DataFrame]:
    """What is left of each table of ``chain`` (table, key of its parent, own key) when the keys ``doomed`` (id) and all that
    descends from them go."""
    out = []
    for table, parent, own in chain:
        gone = table.join(doomed.select(F.col("id").alias(parent)), parent, "left_semi")
        out.append(table.join(doomed.select(F.col("id").alias(parent)), parent, "left_anti"))
        doomed = gone.select(F.col(own).alias("id")).distinct()
    return out


def merge_maps(old: Column, new: Column) -> Column:
    """Entries of both maps, those of ``new`` winning; null counts as empty."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    a, b = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def latest(df: DataFrame, keys: list[str], version: str, condition: Column | None = None) -> DataFrame:
    """The row of the highest version of each key, among those for which ``condition`` holds."""
    rows = df if condition is None else df.where(condition)
    rest = [c for c in df.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("r__"))
    return best.select(*keys, *[F.col(f"r__.{c}").alias(c) for c in rest]).select(*df.columns)


def next_version(df: DataFrame, keys: list[str], version: str, status: str) -> DataFrame:
    """(keys, next): the last version if it is a draft, else one more."""
    last = df.groupBy(*keys).agg(F.max(F.struct(version, status)).alias("m"))
    return last.select(*keys, (F.col(f"m.{version}") + F.when(F.col(f"m.{status}") == "draft", 0).otherwise(1)).alias("next"))


def audit(df: DataFrame, name: str, unique: list[str] | None = None, refers: dict[str, tuple[DataFrame, str]] | None = None, allowed: dict[str, list] | None = None, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(table, rule, n): how many rows, or keys for ``unique``, break each rule."""
    found = []
    put = lambda rule, rows: found.append(rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), F.lit(rule).alias("rule"), "n"))
    if unique:
        put(f"unique {','.join(unique)}", df.groupBy(*unique).count().where("count > 1").select(*unique))
    for c, (parent, key) in (refers or {}).items():
        put(f"refers {c}", df.where(F.col(c).isNotNull()).join(parent.select(F.col(key).alias(c)), c, "left_anti"))
    for c, values in (allowed or {}).items():
        put(f"allowed {c}", df.where(~F.col(c).isin(values)))
    for c, (lo, hi) in (ranges or {}).items():
        put(f"range {c}", df.where(~F.col(c).between(lo, hi)))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def new_id(old: Column, target: str) -> Column:
    return F.sha2(F.concat_ws(":", old.cast("string"), F.lit(target)), 256)


def clone(df: DataFrame, ids: list[str], target: str, fixed: dict[str, Column] | None = None) -> DataFrame:
    """Rows with every id of ``ids`` replaced by one that follows from it and ``target``, so that references still meet."""
    return df.withColumns({**{c: F.when(F.col(c).isNotNull(), new_id(F.col(c), target)) for c in ids}, **(fixed or {})})


def update_status(jobs: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """(key, status, at) put on ``jobs``: running stamps ``started``, done and failed stamp ``completed``."""
    c = changes.select(key, F.col("status").alias("new__"), "at")
    rows = jobs.join(c, key, "left")
    started = F.when(F.col("new__") == "running", F.col("at")).otherwise(F.col("started"))
    completed = F.when(F.col("new__").isin("done", "failed"), F.col("at")).otherwise(F.col("completed"))
    return rows.select(key, F.coalesce("new__", "status").alias("status"), started.alias("started"), completed.alias("completed"))


def remap(df: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """``column`` through (old, new); values that aren't mapped stay."""
    m = mapping.select(F.col("old").alias(column), F.col("new").alias("new__"))
    return df.join(m, column, "left").withColumn(column, F.coalesce("new__", column)).drop("new__").select(*df.columns)


def apply_overrides(base: DataFrame, overrides: DataFrame, key: str, fields: list[str], order: str) -> DataFrame:
    """``base`` with the latest override (key, field, value, order) of each field."""
    last = overrides.groupBy(key, "field").agg(F.max_by("value", order).alias("value")).groupBy(key).pivot("field", fields).agg(F.first("value"))
    named = last.select(key, *[F.col(f).alias(f"{f}__o") for f in fields])
    return base.join(named, key, "left").withColumns({f: F.coalesce(F.col(f"{f}__o"), F.col(f).cast("string")) for f in fields}).drop(*[f"{f}__o" for f in fields])


def correction_events(base: DataFrame, overrides: DataFrame, key: str, fields: list[str], order: str) -> DataFrame:
    """(key, field, before, after, order): each override with the value that it replaced."""
    own = base.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("own")) for f in fields])).alias("x")).select(key, "x.field", "x.own")
    w = Window.partitionBy(key, "field").orderBy(order)
    rows = overrides.join(own, [key, "field"]).withColumn("before", F.coalesce(F.lag("value").over(w), F.col("own")))
    return rows.select(key, "field", "before", F.col("value").alias("after"), order)


def merge_report(tables: dict[str, tuple[DataFrame, DataFrame, list[str]]]) -> DataFrame:
    """(table, inserted, updated) for (current, new, keys) of each table."""
    out = None
    for name, (current, new, keys) in tables.items():
        hit = new.select(*keys).join(current.select(*keys).withColumn("in__", F.lit(True)), keys, "left")
        row = hit.agg(F.count_if(F.col("in__").isNull()).alias("inserted"), F.count_if(F.col("in__")).alias("updated")).withColumn("table", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out
