"""Scores, boundaries, shots and budgets over series of frame vectors. Frame ends are inclusive throughout."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine_distance, dot, gather, unit, vector_sum
from .intervals import points_in


def mean_pool(df: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """(keys, pooled): the mean vector at unit length. The factor 1/n cancels, so the sum is enough."""
    return gather(vector_sum(df, keys, vector), keys, "pooled").withColumn("pooled", unit("pooled"))


def pairwise_spread(df: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """(keys, n, spread): mean pairwise cosine distance of unit vectors, from one vector sum for each group; 0 below two rows."""
    sums = vector_sum(df, keys, vector).groupBy(*keys).agg(F.sum(F.col("total") * F.col("total")).alias("ss"))
    own = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(dot(vector, vector)).alias("own"))
    pairs = F.col("n") * (F.col("n") - 1)
    return own.join(sums, keys).select(*keys, "n", F.when(F.col("n") > 1, 1 - (F.col("ss") - F.col("own")) / pairs).otherwise(0.0).alias("spread"))


def motion_score(df: DataFrame, keys: list[str], order: str, vector: str = "embedding") -> DataFrame:
    """(keys, motion): mean Euclidean step of consecutive unit vectors; 0 below two rows."""
    before = F.lag(vector).over(Window.partitionBy(*keys).orderBy(order))
    steps = df.select(*keys, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot(before, vector))).alias("step"))
    return steps.groupBy(*keys).agg(F.coalesce(F.avg("step"), F.lit(0.0)).alias("motion"))


def complexity(df: DataFrame, keys: list[str], order: str, w1: float = 0.5, w2: float = 0.5, vector: str = "embedding") -> DataFrame:
    """(keys, n, spread, motion, complexity)."""
    both = pairwise_spread(df, keys, vector).join(motion_score(df, keys, order, vector), keys)
    return both.withColumn("complexity", F.when(F.col("n") > 1, w1 * F.col("spread") + w2 * F.col("motion")).otherwise(0.0))


def distances(df: DataFrame, key: str, order: str, vector: str = "embedding") -> DataFrame:
    """``df`` with ``distance``: cosine distance to the row before, null for the first."""
    before = F.lag(vector).over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("distance", F.when(before.isNotNull(), cosine_distance(before, vector)))


def boundary_threshold(df: DataFrame, key: str, floor: float = 0.15, cap: float = 0.5) -> DataFrame:
    """(key, threshold): median + 1.5 interquartile ranges of ``distance``, between floor and cap; floor below four values."""
    q = F.percentile("distance", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    rows = df.where("distance is not null").groupBy(key).agg(F.count(F.lit(1)).alias("n"), q.alias("q"))
    raw = F.col("q")[1] + 1.5 * (F.col("q")[2] - F.col("q")[0])
    return rows.select(key, F.when(F.col("n") < 4, F.lit(floor)).otherwise(F.least(F.lit(cap), F.greatest(F.lit(floor), raw))).alias("threshold"))


def soft_boundaries(scores: DataFrame, key: str, order: str, score: str = "distance", threshold: str = "threshold") -> DataFrame:
    """Rows that score the threshold or more and more than both neighbours."""
    w = Window.partitionBy(key).orderBy(order)
    low = F.lit(float("-inf"))
    near = F.greatest(F.coalesce(F.lag(score).over(w), low), F.coalesce(F.lead(score).over(w), low))
    return scores.withColumn("near", near).where((F.col(score) >= F.col(threshold)) & (F.col(score) > F.col("near"))).drop("near")


def hard_cuts(df: DataFrame, key: str, order: str, threshold: float = 0.15, vector: str = "embedding") -> DataFrame:
    """Rows whose vector differs from the one before by more than ``threshold`` on average (absolute, by component)."""
    before = F.lag(vector).over(Window.partitionBy(key).orderBy(order))
    diff = F.aggregate(F.zip_with(before, F.col(vector), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / F.size(vector)
    return df.withColumn("diff", diff).where(F.col("diff") > threshold)


def spike_boundaries(df: DataFrame, key: str, order: str, value: str, cuts: DataFrame | None = None, floor: float = 1.5, gap: int = 5) -> DataFrame:
    """(key, order, smooth): where the centred mean of three (zeros beyond the ends) is over max(p85, floor) for ten
    values or more, and no cut is nearer than ``gap``."""
    w = Window.partitionBy(key).orderBy(order)
    x = lambda c: F.coalesce(c, F.lit(0.0))
    rows = df.withColumn("smooth", (x(F.lag(value).over(w)) + F.col(value) + x(F.lead(value).over(w))) / 3)
    limit = rows.groupBy(key).agg(F.when(F.count(F.lit(1)) >= 10, F.greatest(F.percentile("smooth", F.lit(0.85)), F.lit(floor))).otherwise(floor).alias("limit"))
    out = rows.join(limit, key).where(F.col("smooth") > F.col("limit")).select(key, order, "smooth")
    if cuts is None:
        return out
    near = cuts.select(F.col(key).alias("ck"), F.explode(F.sequence(F.col(order) - gap + 1, F.col(order) + gap - 1)).alias("co")).distinct()
    return out.join(near, (F.col(key) == F.col("ck")) & (F.col(order) == F.col("co")), "left_anti")


def boundaries_to_shots(bounds: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """(key, shot_index, start_frame, end_frame) from (key, boundary) and (key, total); 0 always starts a shot."""
    marks = bounds.join(totals, key).where((F.col("boundary") > 0) & (F.col("boundary") < F.col("total"))).select(key, "boundary", "total")
    marks = marks.unionByName(totals.where("total > 0").select(key, F.lit(0).alias("boundary"), "total")).distinct()
    w = Window.partitionBy(key).orderBy("boundary")
    return marks.select(key, (F.row_number().over(w) - 1).alias("shot_index"), F.col("boundary").alias("start_frame"), (F.coalesce(F.lead("boundary").over(w), F.col("total")) - 1).alias("end_frame"))


def merge_short(shots: DataFrame, key: str, least: int) -> DataFrame:
    """(key, start_frame, end_frame): shots of fewer than ``least`` frames join their shorter neighbour (the earlier of
    two equal ones) until none is left or one shot remains. Groups are lists of one entity's shots."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [list(r) for r in pdf.sort_values("start_frame")[["start_frame", "end_frame"]].itertuples(index=False)]
        size = lambda i: rows[i][1] - rows[i][0] + 1
        while len(rows) > 1 and (short := next((i for i in range(len(rows)) if size(i) < least), None)) is not None:
            left = short > 0 and (short == len(rows) - 1 or size(short - 1) <= size(short + 1))
            i = short - 1 if left else short
            rows[i : i + 2] = [[rows[i][0], rows[i + 1][1]]]
        out = pd.DataFrame(rows, columns=["start_frame", "end_frame"])
        out.insert(0, key, pdf[key].iloc[0])
        return out

    kind = shots.schema[key].dataType.simpleString()
    return shots.select(key, F.col("start_frame").cast("long"), F.col("end_frame").cast("long")).groupBy(key).applyInPandas(run, f"{key} {kind}, start_frame long, end_frame long")


def split_long(shots: DataFrame, most: Column) -> DataFrame:
    """Shots of more than ``most`` frames in equal parts, the first ones taking the remainder; ``is_forced_split`` marks them."""
    n = F.col("end_frame") - F.col("start_frame") + 1
    rows = shots.withColumn("n", n).withColumn("parts", F.ceil(F.col("n") / most).cast("int"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    size, rest = F.floor(F.col("n") / F.col("parts")), F.col("n") % F.col("parts")
    start = F.col("start_frame") + F.col("part") * size + F.least("part", rest)
    end = start + size + (F.col("part") < rest).cast("int") - 1
    return rows.withColumn("s", start.cast("int")).withColumn("e", end.cast("int")).withColumn("is_forced_split", F.col("parts") > 1).drop("start_frame", "end_frame", "n", "parts").withColumnRenamed("s", "start_frame").withColumnRenamed("e", "end_frame")


def longest_shot_seconds(duration_s: Column) -> Column:
    """Fixed tiers: 6 s below ten minutes, 8 s below an hour, 12 s beyond."""
    return F.when(duration_s < 600, 6.0).when(duration_s < 3600, 8.0).otherwise(12.0)


def candidate_grid(videos: DataFrame, key: str, total: str, fps: str, effective: Column) -> DataFrame:
    """(key, frame_index): every max(1, round(fps / effective))-th frame."""
    step = F.greatest(F.lit(1), F.bround(F.col(fps) / effective).cast("int"))
    return videos.where(F.col(total) > 0).select(key, F.explode(F.sequence(F.lit(0), F.col(total).cast("int") - 1, step)).alias("frame_index"))


def assign_frames(frames: DataFrame, shots: DataFrame, key: str, bucket: int = 64) -> DataFrame:
    """(key, shot_index, frame_index): the frames inside each shot; for a shot without any, the nearest to its middle.

    The frames inside come from one join on the key and the bucket of frames, so a long video is spread over tasks; the
    nearest comes from the frame before and after the middle, which windows over frames and middles in one order give.
    """
    f, s = frames.select(F.col(key).alias("k"), "frame_index"), shots.select(F.col(key).alias("k"), "shot_index", "start_frame", "end_frame")
    inside = points_in(s, f, ["k"], "start_frame", "end_frame", "frame_index", bucket).select("k", "shot_index", "frame_index")
    empty = s.join(inside.select("k", "shot_index").distinct(), ["k", "shot_index"], "left_anti").select("k", "shot_index", ((F.col("start_frame") + F.col("end_frame")) / 2).alias("at"))
    line = f.select("k", F.lit(None).cast("int").alias("shot_index"), F.col("frame_index").cast("double").alias("at"), "frame_index").unionByName(empty.withColumn("frame_index", F.lit(None).cast("int")))
    w = Window.partitionBy("k").orderBy("at", F.col("shot_index").asc_nulls_first())
    line = line.withColumn("lo", F.last("frame_index", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("hi", F.first("frame_index", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    near = F.when(F.col("hi").isNull() | (F.abs(F.col("lo") - F.col("at")) <= F.abs(F.col("hi") - F.col("at"))), F.col("lo")).otherwise(F.col("hi"))
    nearest = line.where("shot_index is not null").select("k", "shot_index", near.alias("frame_index")).where("frame_index is not null")
    return inside.unionByName(nearest).withColumnRenamed("k", key)


def shot_budget(shots: DataFrame, threshold: float = 0.3, base: int = 1, bonus: int = 1, start_s: float = 4.0, interval_s: float = 4.0, floor_s: float = 10.0, most: int = 5) -> DataFrame:
    """``shots`` with ``budget``: base, a bonus for complexity over the threshold, one for each interval beyond ``start_s``,
    no less than one for each ``floor_s``, at most ``most``."""
    extra = F.greatest(F.lit(0), F.floor((F.col("duration_s") - start_s) / interval_s))
    raw = base + F.when(F.col("complexity") > threshold, bonus).otherwise(0) + extra
    return shots.withColumn("budget", F.least(F.lit(most), F.greatest(raw, F.ceil(F.col("duration_s") / floor_s))).cast("int"))


def enforce_cap(budgets: DataFrame, key: str, order: str, most: int, base: int = 1) -> DataFrame:
    """``budgets`` with ``budget`` lowered, least complex shots first, to base + 1 and then to base, as far as needed for
    the sum by key to be at most ``most``."""
    for level in (base + 1, base):
        save = F.greatest(F.lit(0), F.col("budget") - level)
        w = Window.partitionBy(key).orderBy("complexity", order)
        total = F.sum("budget").over(Window.partitionBy(key))
        saved = F.coalesce(F.sum("save").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        budgets = budgets.withColumn("save", save).withColumn("trim", total - saved > most)
        budgets = budgets.withColumn("budget", F.when(F.col("trim"), F.col("budget") - F.col("save")).otherwise(F.col("budget")).cast("int")).drop("save", "trim")
    return budgets


def budget_stats(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("shots"), F.sum("budget").alias("frames"), F.min("budget").alias("least"), F.max("budget").alias("most"), F.avg("budget").alias("mean"), F.count_if(F.col("budget") > 1).alias("above_base"))


def predictions_to_scenes(df: DataFrame, key: str | list[str], order: str, flag: str) -> DataFrame:
    """(key, start_frame, end_frame): the stretches of rows whose flag (transition) is false."""
    key = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*key).orderBy(order)
    rows = df.withColumn("starts", (~F.col(flag) & F.coalesce(F.lag(flag).over(w), F.lit(True))).cast("int")).withColumn("island", F.sum("starts").over(w))
    scenes = rows.where(~F.col(flag)).groupBy(*key, "island").agg(F.min(order).alias("start_frame"), F.max(order).alias("end_frame")).drop("island")
    whole = df.groupBy(*key).agg(F.min(order).alias("start_frame"), F.max(order).alias("end_frame"), F.min(F.col(flag).cast("int")).alias("all_on")).where("all_on = 1").drop("all_on")
    return scenes.unionByName(whole)


#: Frames in a block of frame_labels(), and labels in one of its partitions: more labels go into more partitions.
BLOCK, LABELS = 256, 4_000_000


def frame_labels(scenes: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """(key, frame_index, one_hot, many_hot) for the frames of each transition between a scene and the next: one_hot at its middle.

    Labels outnumber scenes by far, so transitions are cut at multiples of ``block`` before they are dealt out, by block, and
    become labels last. Parts of one block follow each other, whole ones first: the same frame numbers come again and again,
    which files in columns hold in a small part of the bytes that labels take in order of key and frame."""
    w = Window.partitionBy(key).orderBy("start_frame")
    gaps = scenes.select(key, F.lag("end_frame").over(w).alias("a"), F.col("start_frame").alias("b")).where("a <= b")
    n = gaps.agg(F.sum(F.col("b") - F.col("a") + 1)).first()[0] or 0
    starts = F.sequence(F.col("a") - F.pmod("a", F.lit(block)), F.col("b"), F.lit(block))
    parts = gaps.select(key, "a", "b", F.floor((F.col("a") + F.col("b")) / 2).alias("middle"), F.explode(starts).alias("block"))
    parts = parts.select("block", key, F.greatest("a", "block").alias("a"), F.least("b", F.col("block") + (block - 1)).alias("b"), "middle")
    parts = parts.repartition(max(1, -(-n // LABELS)), "block").sortWithinPartitions("block", F.col("a") - F.col("b"), key)
    rows = parts.select(key, "middle", F.explode(F.sequence("a", "b")).alias("frame_index"))
    return rows.select(key, "frame_index", (F.col("frame_index") == F.col("middle")).cast("int").alias("one_hot"), F.lit(1).alias("many_hot"))


def transitions(scenes: DataFrame, keys: list[str], tolerance: int = 2) -> DataFrame:
    """(keys, a, b): the interval from the end of each scene to the start of the next, widened by half of ``tolerance`` less
    half a frame on both sides; a gradual transition is as long as the frames between its scenes."""
    grow = tolerance / 2 - 0.5
    w = Window.partitionBy(*keys).orderBy("start_frame")
    rows = scenes.select(*keys, (F.col("end_frame") - grow).alias("a"), (F.lead("start_frame").over(w) + grow).alias("b"))
    return rows.where("b is not null")


def match_scenes(truth: DataFrame, found: DataFrame, keys: list[str], tolerance: int = 2) -> DataFrame:
    """(keys, tp, fp, fn): transitions of scenes (keys, start_frame, end_frame) matched in order, each with at most one that it
    meets. Of two that don't meet the earlier one is a miss; what a match does depends on those before it, so a key's
    transitions (not its frames) are walked in one task."""

    def walk(k: tuple, x: list[tuple], y: list[tuple]) -> tuple:
        i = j = hits = 0
        while i < len(x) and j < len(y):
            late, early = y[j][0] > x[i][1], y[j][1] < x[i][0]
            hits += not (late or early)
            i, j = i + (not early), j + (not late)
        return (*k, hits, len(y) - hits, len(x) - hits)

    fields = [f"`{k}` {truth.schema[k].dataType.simpleString()}" for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = [*keys, "tp", "fp", "fn"], None
        at, sides, out = None, ([], []), []

        def put() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
            out.clear()
            return batch

        for batch in batches:
            kinds = [*[batch.schema.field(k).type for k in keys], *[pa.int64()] * 3]
            for *k, side, a, b in zip(*[batch.column(c).to_pylist() for c in (*keys, "side", "a", "b")]):
                if k != at:
                    if at is not None:
                        out.append(walk(at, *sides))
                    at, sides = k, ([], [])
                sides[side].append((a, b))
            if len(out) >= 10_000:
                yield put()
        if at is not None:
            out.append(walk(at, *sides))
            yield put()

    a, b = (transitions(x, keys, tolerance).withColumn("side", F.lit(i)) for i, x in enumerate((truth, found)))
    # one pass over the sorted rows of all keys: a call for each key would cost more than its walk
    rows = a.unionByName(b).repartition(*keys).sortWithinPartitions(*keys, "side", "a", "b")
    return rows.mapInArrow(run, ", ".join([*fields, "tp long", "fp long", "fn long"]))


def transition_f1(matched: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, tp, fp, fn, precision, recall, f1) over the rows of ``match_scenes``; a ratio without rows is 0."""
    sums = matched.groupBy(*(by or [])).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    sums = sums.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return sums.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


#: Thresholds of the sweep.
SWEEP = (0.02, 0.06, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def threshold_sweep(df: DataFrame, key: str, order: str, score: str, truth: str, thresholds: tuple[float, ...] = SWEEP, tolerance: int = 2) -> DataFrame:
    """(threshold, tp, fp, fn, precision, recall, f1, best) of transitions by ``score`` above each threshold against the flag
    ``truth``; ``best`` marks the first threshold of the largest f1."""
    rows = df.select(F.col(key).alias("k"), order, score, F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold"))
    found = predictions_to_scenes(rows.withColumn("on", F.col(score) > F.col("threshold")), ["k", "threshold"], order, "on")
    # the truth is the same for all thresholds
    real = predictions_to_scenes(df.select(F.col(key).alias("k"), order, truth), "k", order, truth)
    real = real.select("k", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold"), "start_frame", "end_frame")
    out = transition_f1(match_scenes(real, found, ["k", "threshold"], tolerance), ["threshold"])
    none = df.sparkSession.createDataFrame([(float(x),) for x in thresholds], "threshold double")
    out = F.broadcast(none).join(out, "threshold", "left").na.fill(0)
    first = F.row_number().over(Window.orderBy(F.desc(F.round("f1", 9)), "threshold")) == 1
    return out.withColumn("best", first)


def change_score(df: DataFrame, key: str, order: str, hard: str, least: int = 3, most: int = 15, vector: str = "embedding") -> DataFrame:
    """(key, order, score): cosine distance of the means of the rows before each row and of those from it on. The two windows
    follow the segment between the hard cuts (flag ``hard``) around the row: a quarter of its length, from ``least`` to
    ``most``, half of that on each side. The first and last row and hard cuts score 0. Sums go by component, one order for
    all window lengths."""
    w = Window.partitionBy(key).orderBy(order)
    rows = df.withColumn("at", F.row_number().over(w) - 1).withColumn("last", F.count(F.lit(1)).over(Window.partitionBy(key)) - 1)
    cut = F.when(F.col(hard), F.col("at"))
    before = F.coalesce(F.last(cut, True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.coalesce(F.first(cut, True).over(w.rowsBetween(1, Window.unboundedFollowing)), F.col("last"))
    width = F.least(F.lit(most), F.greatest(F.lit(least), F.floor((after - before) / 4)))
    rows = rows.withColumn("half", F.greatest(F.lit(1), F.floor(width / 2)))
    rows = rows.withColumn("out", F.col(hard) | (F.col("at") == 0) | (F.col("at") == F.col("last")))
    x = rows.select(key, order, "half", "out", F.posexplode(vector).alias("pos", "x"))
    o = Window.partitionBy(key, "pos").orderBy(order)
    by_half = lambda lo, hi: F.coalesce(*[F.when(F.col("half") == h, F.avg("x").over(o.rowsBetween(lo(h), hi(h)))) for h in range(max(1, least // 2), max(1, most // 2) + 1)])
    sides = x.withColumn("a", by_half(lambda h: -h, lambda h: -1)).withColumn("b", by_half(lambda h: 0, lambda h: h - 1))
    dots = sides.groupBy(key, order).agg(F.first("out").alias("out"), F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    score = 1 - F.coalesce(F.try_divide(F.col("ab"), F.sqrt(F.col("aa")) * F.sqrt(F.col("bb"))), F.lit(0.0))
    return dots.select(key, order, F.when(F.col("out"), 0.0).otherwise(score).alias("score"))
