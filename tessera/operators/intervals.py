"""Joins of intervals and points in time, by key and time bucket.

``range_join`` puts both sides into buckets of ``bucket`` seconds and keeps a pair in its first common bucket only, so long
series of one key are spread over tasks and nothing is joined with everything. Rows with a null key or time take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_join(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, c: str, d: str, bucket: float, closed: bool = False, slack: float = 0.0) -> DataFrame:
    """Pairs of ``left`` [a, b] and ``right`` [c, d] of equal keys that overlap: a < d and b > c, or <= and >= if ``closed``,
    with ``slack`` added on both sides of the left interval. Column names must differ but for the keys."""
    lo, hi = F.col(a) - slack, F.col(b) + slack
    cell = lambda x: F.floor(x / bucket)
    spread = lambda df, x, y: df.where(x.isNotNull() & y.isNotNull() & (x <= y)).withColumn("first_b", cell(x)).withColumn("at_b", F.explode(F.sequence(cell(x), cell(y))))
    kept = [k for k in right.columns if k not in keys]
    x = spread(left, lo, hi)
    y = spread(right, F.col(c), F.col(d)).select(*keys, F.col("first_b").alias("first_c"), "at_b", *kept)
    hit = ((lo <= F.col(d)) & (hi >= F.col(c))) if closed else ((lo < F.col(d)) & (hi > F.col(c)))
    return x.join(y, [*keys, "at_b"]).where(hit & (F.col("at_b") == F.greatest("first_b", "first_c"))).drop("first_b", "first_c", "at_b")


def points_in(left: DataFrame, points: DataFrame, keys: list[str], a: str, b: str, at: str, bucket: float, slack: float = 0.0) -> DataFrame:
    """Pairs of intervals and the points inside them, ends included."""
    cell = lambda x: F.floor(x / bucket)
    lo, hi = F.col(a) - slack, F.col(b) + slack
    x = left.where(lo <= hi).withColumn("at_b", F.explode(F.sequence(cell(lo), cell(hi))))
    return x.join(points.withColumn("at_b", cell(F.col(at))), [*keys, "at_b"]).where(F.col(at).between(lo, hi)).drop("at_b")


def max_overlap_join(left: DataFrame, right: DataFrame, keys: list[str], lid: str, rid: str, a: str, b: str, c: str, d: str, bucket: float) -> DataFrame:
    """(keys, lid, rid, overlap): each left row with the right one of the largest overlap, the first of equal ones; null if none."""
    pairs = range_join(left, right, keys, a, b, c, d, bucket).withColumn("overlap", F.round(F.least(b, d) - F.greatest(a, c), 9))
    best = pairs.withColumn("rn", F.row_number().over(Window.partitionBy(*keys, lid).orderBy(F.desc("overlap"), c, rid))).where("rn = 1")
    return left.select(*keys, lid).join(best.select(*keys, lid, rid, "overlap"), [*keys, lid], "left")


def text_in_window(intervals: DataFrame, segments: DataFrame, keys: list[str], iid: str, a: str, b: str, c: str, d: str, text: str, bucket: float, pad: float = 0.0, closed: bool = False, most: int | None = None) -> DataFrame:
    """(keys, iid, body): texts of the segments that overlap each interval with ``pad``, in order, joined by blanks."""
    pairs = range_join(intervals, segments, keys, a, b, c, d, bucket, closed, pad)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(c, d, text))), lambda x: x[text]), " ")
    rows = pairs.groupBy(*keys, iid).agg((F.substring(body, 1, most) if most else body).alias("body"))
    return intervals.select(*keys, iid).join(rows, [*keys, iid], "left").withColumn("body", F.coalesce("body", F.lit("")))


def nearest_by_time(left: DataFrame, right: DataFrame, keys: list[str], at: str, rat: str, fields: list[str]) -> DataFrame:
    """``left`` with the ``fields`` of the row of ``right`` nearest in time, the earlier of two equally near ones (null if the
    key has none). One order over both sides and two windows; no pairs are made."""
    row = F.struct(F.col(rat).alias("t"), *fields)
    none = F.lit(None).cast(right.select(row.alias("r")).schema["r"].dataType)
    both = left.withColumn("at_n", F.col(at).cast("double")).withColumn("row_n", none).withColumn("own_n", F.lit(True))
    other = right.select(*keys, F.col(rat).cast("double").alias("at_n"), row.alias("row_n"), F.lit(False).alias("own_n"))
    both = both.unionByName(other, allowMissingColumns=True)
    # of right rows at one time, the last in the order of their fields comes before and the first after
    w = Window.partitionBy(*keys).orderBy("at_n", "own_n", "row_n")
    both = both.withColumn("lo_n", F.last("row_n", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("hi_n", F.first("row_n", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    near = F.when(F.col("hi_n").isNull() | (F.abs(F.col("lo_n.t") - F.col("at_n")) <= F.abs(F.col("hi_n.t") - F.col("at_n"))), F.col("lo_n")).otherwise(F.col("hi_n"))
    return both.where("own_n").withColumn("row_n", near).select(*left.columns, *[F.col(f"row_n.{f}").alias(f) for f in fields])


def snippet(points: DataFrame, segments: DataFrame, keys: list[str], pid: str, at: str, start: str, text: str, window: float = 10.0, bucket: float = 60.0) -> DataFrame:
    """(keys, pid, body): texts of the segments that start within ``window`` of each point; the nearest one if none does."""
    pairs = points_in(points.withColumn("z_p", F.col(at)), segments, keys, at, "z_p", start, bucket, window)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(start, text))), lambda x: x[text]), " ")
    near = nearest_by_time(points, segments, keys, at, start, [text]).select(*keys, pid, F.col(text).alias("near"))
    return near.join(pairs.groupBy(*keys, pid).agg(body.alias("in_w")), [*keys, pid], "left").select(*keys, pid, F.coalesce("in_w", "near").alias("body"))


def stable_majority(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, value, votes, total, kinds): the most frequent value of each group, of equal ones the first seen."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("votes"), F.min(order).alias("seen"))
    g = Window.partitionBy(*keys)
    ranked = counts.withColumn("rn", F.row_number().over(g.orderBy(F.desc("votes"), "seen", value))).withColumn("total", F.sum("votes").over(g)).withColumn("kinds", F.count(F.lit(1)).over(g))
    return ranked.where("rn = 1").drop("rn", "seen")


def majority_in_interval(turns: DataFrame, obs: DataFrame, keys: list[str], tid: str, a: str, b: str, at: str, value: str, bucket: float) -> DataFrame:
    """(keys, tid, value, confidence, method): the most frequent value inside each interval with its share."""
    best = stable_majority(points_in(turns, obs, keys, a, b, at, bucket), [*keys, tid], value, at)
    method = F.when(F.col("kinds").isNull(), "unresolved").when(F.col("kinds") == 1, "single_candidate").otherwise("face_majority")
    return turns.select(*keys, tid).join(best, [*keys, tid], "left").select(*keys, tid, value, F.bround(F.col("votes") / F.col("total"), 3).alias("confidence"), method.alias("method"))


def presence(turns: DataFrame, obs: DataFrame, keys: list[str], tid: str, a: str, b: str, at: str, value: str, bucket: float, widen: float = 3.0) -> DataFrame:
    """(keys, tid, value, strict, wide): counts inside each interval and inside it widened."""
    inside = F.count_if(F.col(at).between(F.col(a), F.col(b)))
    return points_in(turns, obs, keys, a, b, at, bucket, widen).groupBy(*keys, tid, value).agg(inside.alias("strict"), F.count(F.lit(1)).alias("wide"))


def as_map(counts: DataFrame, keys: list[str], value: str, count: str, out: str) -> DataFrame:
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, count)))).alias(out))


def container_of(intervals: DataFrame, shots: DataFrame, keys: list[str], iid: str, a: str, b: str, sid: str, c: str, d: str, bucket: float) -> DataFrame:
    """(keys, iid, sid): the shot that holds the middle (the earliest of several), else the one whose start is nearest."""
    mids = intervals.withColumn("mid_c", (F.col(a) + F.col(b)) / 2)
    inside = points_in(shots, mids, keys, c, d, "mid_c", bucket)
    first = inside.groupBy(*keys, iid).agg(F.min(F.struct(c, sid)).alias("one")).select(*keys, iid, F.col(f"one.{sid}").alias("in_c"))
    near = nearest_by_time(mids.select(*keys, iid, "mid_c"), shots, keys, "mid_c", c, [sid]).select(*keys, iid, F.col(sid).alias("near_c"))
    return near.join(first, [*keys, iid], "left").select(*keys, iid, F.coalesce("in_c", "near_c").alias(sid))


def nearest_midpoint(clips: DataFrame, shots: DataFrame, cid: str, scene: str, a: str, b: str, sid: str, c: str, d: str, group: str) -> DataFrame:
    """(cid, sid): the shot of nearest midpoint within the clip's ``scene``; of all in the ``group`` if the scene holds none."""
    mids = shots.withColumn("mid_s", (F.col(c) + F.col(d)) / 2)
    own = clips.withColumn("mid_k", (F.col(a) + F.col(b)) / 2).select(cid, scene, group, "mid_k")
    in_scene = nearest_by_time(own, mids, [group, scene], "mid_k", "mid_s", [sid]).select(cid, F.col(sid).alias("in_m"))
    in_group = nearest_by_time(own, mids.drop(scene), [group], "mid_k", "mid_s", [sid]).select(cid, F.col(sid).alias("all_m"))
    return in_scene.join(in_group, cid).select(cid, F.coalesce("in_m", "all_m").alias(sid))


def entities_in_interval(turns: DataFrame, obs: DataFrame, keys: list[str], tid: str, a: str, b: str, at: str, entity: str, label: str, value: str, bucket: float) -> DataFrame:
    """(keys, tid, entity, n, label, mean): how often each entity is inside, its most frequent label, its mean value."""
    rows = points_in(turns, obs, keys, a, b, at, bucket)
    top = stable_majority(rows, [*keys, tid, entity], label, at).select(*keys, tid, entity, label)
    return rows.groupBy(*keys, tid, entity).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).join(top, [*keys, tid, entity])


def silences(words: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, gap_a, gap_b) between consecutive words."""
    after = F.lead(start).over(Window.partitionBy(*keys).orderBy(start, end))
    return words.select(*keys, F.col(end).alias("gap_a"), after.alias("gap_b")).where(F.col("gap_b") > F.col("gap_a"))


def snap_boundaries(points: DataFrame, gaps: DataFrame, keys: list[str], pid: str, at: str, window: float = 0.5, bucket: float = 10.0) -> DataFrame:
    """(keys, pid, at, snapped): each boundary at the middle of the largest silence within ``window``, the silence clipped to
    it, the earlier of equal ones; unmoved if there is none."""
    pairs = range_join(points.withColumn("z_s", F.col(at)), gaps, keys, at, "z_s", "gap_a", "gap_b", bucket, False, window)
    lo, hi = F.greatest(F.col("gap_a"), F.col(at) - window), F.least(F.col("gap_b"), F.col(at) + window)
    best = pairs.withColumn("rn", F.row_number().over(Window.partitionBy(*keys, pid).orderBy(F.desc(F.round(hi - lo, 6)), "gap_a"))).where("rn = 1").select(*keys, pid, ((lo + hi) / 2).alias("snapped"))
    return points.select(*keys, pid, at).join(best, [*keys, pid], "left").withColumn("snapped", F.coalesce("snapped", at))


def merge_intervals(df: DataFrame, keys: list[str], a: str, b: str, eps: float = 0.5) -> DataFrame:
    """(keys, a, b): intervals that overlap or are at most ``eps`` apart become one."""
    w = Window.partitionBy(*keys).orderBy(a, b)
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, a, b).withColumn("far", F.max(b).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("island", F.sum(F.when(F.col("far").isNull() | (F.col(a) > F.col("far") + eps), 1).otherwise(0)).over(w))
    return rows.groupBy(*keys, "island").agg(F.min(a).alias(a), F.max(b).alias(b)).drop("island")


def uncovered(target: DataFrame, cover: DataFrame, keys: list[str], a: str, b: str, bucket: float, eps: float = 0.5) -> DataFrame:
    """(keys, a, b): the parts of the merged ``target``, longer than ``eps``, that the merged ``cover`` leaves open."""
    t = merge_intervals(target, keys, a, b, eps)
    c = merge_intervals(cover, keys, a, b, eps).select(*keys, F.col(a).alias("ca"), F.col(b).alias("cb"))
    hit = range_join(t, c, keys, a, b, "ca", "cb", bucket)
    marks = hit.select(*keys, a, b, "ca", "cb").unionByName(t.select(*keys, a, b, F.col(b).alias("ca"), F.col(b).alias("cb")))
    before = F.max("cb").over(Window.partitionBy(*keys, a, b).orderBy("ca", "cb").rowsBetween(Window.unboundedPreceding, -1))
    gaps = marks.withColumn("ga", F.coalesce(before, F.col(a))).withColumn("gb", F.col("ca"))
    return gaps.where(F.col("gb") - F.col("ga") > eps).select(*keys, F.col("ga").alias(a), F.col("gb").alias(b))


def with_parent(children: DataFrame, parents: DataFrame, key: str, keep: Column | None = None) -> DataFrame:
    """Children of the parents for which ``keep`` holds."""
    return children.join(parents if keep is None else parents.where(keep), key)
