"""Plans of operations, quality checks, feedback and profiles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import ratio
from .intervals import nearest_by_time


def rank_candidates(scores: DataFrame, items: DataFrame, keys: list[str], item: str, score: str) -> DataFrame:
    """Scores of items that exist, joined with them and ranked by score; ties to the smaller item."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), item)
    return scores.join(items, item).withColumn("rank", F.row_number().over(w))


def backfill_ops(ops: DataFrame, candidates: DataFrame, scene: str) -> DataFrame:
    """``ops`` with missing bounds from the candidate of their scene; clips without a candidate are dropped."""
    c = candidates.select(scene, F.col("start_s").alias("c_start"), F.col("end_s").alias("c_end"))
    return ops.join(c, scene).withColumn("start_s", F.coalesce("start_s", "c_start")).withColumn("end_s", F.coalesce("end_s", "c_end")).drop("c_start", "c_end")


def plan_duration(ops: DataFrame, plan: str, is_clip: Column) -> DataFrame:
    return ops.groupBy(plan).agg(F.sum(F.when(is_clip, F.greatest(F.lit(0.0), F.col("end_s") - F.col("start_s"))).otherwise(0.0)).alias("duration"))


def resequence(ops: DataFrame, plan: str, index: str, is_clip: Column) -> DataFrame:
    """``ops`` with ``sequence_index``: clips 0, 1, ... in their order, the other operations after them."""
    w = Window.partitionBy(plan).orderBy(F.when(is_clip, 0).otherwise(1), index)
    return ops.withColumn("sequence_index", F.row_number().over(w) - 1)


def trim_to_target(ops: DataFrame, plan: str, op: str, relevance: str, target: str) -> DataFrame:
    """``ops`` without the least relevant ones, as many as it takes for the sum of durations to reach ``target``."""
    dur = F.greatest(F.lit(0.0), F.col("end_s") - F.col("start_s"))
    w = Window.partitionBy(plan).orderBy(relevance, op)
    rows = ops.withColumn("dur__", F.round(dur, 6)).withColumn("before__", F.coalesce(F.sum("dur__").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("total__", F.sum("dur__").over(Window.partitionBy(plan)))
    return rows.where(~(F.round(F.col("total__") - F.col("before__"), 6) > F.col(target))).drop("dur__", "before__", "total__")


def validate_plans(ops: DataFrame, scenes: DataFrame, plan: str, scene: str, index: str, is_clip: Column, known: Column) -> DataFrame:
    """(plan, reason): the first rule that a plan breaks, null if none. ``scenes``: (scene, s_start, s_end)."""
    rows = ops.join(scenes, scene, "left")
    bad = lambda c: F.max(F.coalesce(c, F.lit(False)))
    n = F.count_if(is_clip)
    clip_index = F.when(is_clip, F.col(index))
    out = rows.groupBy(plan).agg(
        bad(~known).alias("kind"), n.alias("n"), bad(is_clip & (F.col("start_s").isNull() | F.col("end_s").isNull())).alias("missing"), bad(is_clip & F.col("s_start").isNull()).alias("unknown"),
        bad(is_clip & ((F.col("start_s") < F.col("s_start") - 0.05) | (F.col("end_s") > F.col("s_end") + 0.05))).alias("outside"),
        ((F.min(clip_index) != 0) | (F.max(clip_index) != n - 1) | (F.count_distinct(clip_index) != n)).alias("gaps"),
    )
    reason = F.when(F.col("kind"), "unknown type").when(F.col("n") == 0, "no clip").when(F.col("missing"), "missing field").when(F.col("unknown"), "unknown scene").when(F.col("outside"), "out of bounds").when(F.col("gaps"), "not contiguous")
    return out.select(plan, reason.alias("reason"))


def apply_diff(ops: DataFrame, diff: DataFrame, keys: list[str], order: str, fields: list[str]) -> DataFrame:
    """``ops`` after the last change of each key in ``diff`` (keys, seq, action, fields): add and modify set the fields that
    aren't null, remove drops; ``position`` keeps the old order and puts new ones at the end."""
    last = diff.groupBy(*keys).agg(F.max_by(F.struct("action", *fields, "seq"), "seq").alias("d"))
    rows = ops.join(last, keys, "full").where(~F.coalesce(F.col("d.action") == "remove", F.lit(False)))
    rows = rows.withColumns({f: F.coalesce(F.col(f"d.{f}"), F.col(f)) for f in fields})
    w = Window.partitionBy(keys[0]).orderBy(F.col(order).isNull(), order, "d.seq")
    return rows.withColumn("position", F.row_number().over(w) - 1).select(*keys, *fields, "position")


def neighbours(clips: DataFrame, keys: list[str], order: str, value: str, r: int = 2) -> DataFrame:
    """``clips`` with ``near``: values of up to ``r`` rows before and after, in order."""
    w = Window.partitionBy(*keys).orderBy(order)
    return clips.withColumn("near", F.concat(F.collect_list(value).over(w.rowsBetween(-r, -1)), F.collect_list(value).over(w.rowsBetween(1, r))))


def clamp_deltas(adj: DataFrame, bounds: DataFrame, param: str) -> DataFrame:
    """(adj, final, clamped): recommended, else current, plus delta, within the bounds (param, lo, hi); unknown parameters go."""
    rows = adj.join(F.broadcast(bounds), param)
    raw = F.coalesce("recommended", "current") + F.col("delta")
    return rows.withColumn("final", F.least(F.col("hi"), F.greatest(F.col("lo"), raw))).withColumn("clamped", raw != F.col("final")).drop("lo", "hi")


def dominance(rows: DataFrame, keys: list[str], item: str, score: str, factor: float = 2.0) -> DataFrame:
    """(keys, item, decided): the best item, decided if it is alone or over ``factor`` times the next one."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), item)
    top = rows.withColumn("r__", F.row_number().over(w)).withColumn("next__", F.lead(score).over(w)).where("r__ = 1")
    return top.select(*keys, item, (F.col("next__").isNull() | (F.col(score) > factor * F.col("next__"))).alias("decided"))


def materialise(clips: DataFrame, backgrounds: DataFrame, mattes: DataFrame, scene: str, shot: str) -> DataFrame:
    """Clips with the background of their scene and the matte of their shot, null where there is none."""
    return clips.join(backgrounds, scene, "left").join(mattes, shot, "left")


def miss_counts(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in columns])


def target_map(ops: DataFrame, keys: list[str], refs: str) -> DataFrame:
    """(keys, target_type, target_id) of references such as ``TYPE:id``."""
    parts = F.split("ref__", ":", 2)
    rows = ops.select(*keys, F.explode(refs).alias("ref__")).where(F.col("ref__").contains(":"))
    return rows.select(*keys, parts[0].alias("target_type"), parts[1].alias("target_id"))


def level_runs(series: DataFrame, key: str, order: str, hit: Column, least: float) -> DataFrame:
    """(key, start_s, end_s): stretches of rows for which ``hit`` holds, of ``least`` seconds or more; the end is the first row
    after, null for a stretch that is open at the end (it is kept whatever its length)."""
    w = Window.partitionBy(key).orderBy(order)
    rows = series.withColumn("hit__", hit)
    rows = rows.withColumn("prev__", F.coalesce(F.lag("hit__").over(w), F.lit(False))).withColumn("next__", F.lead(order).over(w))
    rows = rows.withColumn("island__", F.sum((F.col("hit__") & ~F.col("prev__")).cast("int")).over(w))
    out = rows.where("hit__").groupBy(key, "island__").agg(F.min(order).alias("start_s"), F.max_by("next__", order).alias("end_s")).drop("island__")
    return out.where(F.col("end_s").isNull() | (F.col("end_s") - F.col("start_s") >= least))


def loudness_eval(df: DataFrame, measured: str, platform: Column, tolerance: float = 1.0) -> DataFrame:
    """``df`` with ``target`` (-16 for podcasts, else -14), ``diff`` and ``ok``; null where nothing was measured."""
    target = F.when(platform == "podcast", -16.0).otherwise(-14.0)
    return df.withColumn("target", target).withColumn("diff", F.col(measured) - F.col("target")).withColumn("ok", F.abs("diff") <= tolerance)


def text_drift(pairs: DataFrame, a: str, b: str, limit: float = 0.75) -> DataFrame:
    """``pairs`` with ``similarity`` (share of characters in matching blocks of the delivered text ``a`` and its source ``b``,
    see blocks.py; null as empty) and ``drift``."""

    @F.pandas_udf("double")
    def similarity(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([ratio(p, q) for p, q in zip(x, y)], dtype=float)

    return pairs.withColumn("similarity", similarity(a, b)).withColumn("drift", F.col("similarity") < limit)


def qa_status(checks: DataFrame, keys: list[str], status: str) -> DataFrame:
    """(keys, status): the worst of pass, warn and fail."""
    level = F.max(F.when(F.col(status) == "fail", 2).when(F.col(status) == "warn", 1).otherwise(0))
    return checks.groupBy(*keys).agg(F.element_at(F.array(F.lit("pass"), F.lit("warn"), F.lit("fail")), (level + 1).cast("int")).alias("status"))


def golden_check(live: DataFrame, golden: DataFrame, keys: list[str], count: str, value: str, rows: int = 2, share: float = 0.05) -> DataFrame:
    """(keys, count_ok, value_ok): live within ``rows`` and ``share`` of the golden figures; false where one is missing."""
    g = golden.select(*keys, F.col(count).alias("gc"), F.col(value).alias("gv"))
    both = live.join(g, keys, "full")
    ok = lambda c: F.coalesce(c, F.lit(False))
    return both.select(*keys, ok(F.abs(F.col(count) - F.col("gc")) <= rows).alias("count_ok"), ok(F.abs(F.col(value) - F.col("gv")) <= share * F.abs("gv")).alias("value_ok"))


def rate_alerts(df: DataFrame, keys: list[str], flag: Column, limit: float) -> DataFrame:
    """(keys, n, rate) of groups in which ``flag`` holds for more than ``limit``."""
    rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(flag.cast("double")).alias("rate"))
    return rows.where(F.col("rate") > limit)


def finalise_turns(turns: DataFrame, first: DataFrame, second: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """(key, who, method): an answer (key, who, confidence) of a known id with confidence 0.5 or more settles a turn; the
    second answer replaces a first one below that; turns without an answer stay undecided."""
    a = first.select(key, F.col("who").alias("w1"), F.col("confidence").alias("c1"))
    b = second.select(key, F.col("who").alias("w2"), F.col("confidence").alias("c2"))
    rows = turns.select(key).join(a, key, "left").join(b, key, "left")
    escalate = F.coalesce(F.col("c1") < 0.5, F.lit(True)) & F.col("w2").isNotNull()
    rows = rows.withColumn("who", F.when(escalate, F.col("w2")).otherwise(F.col("w1"))).withColumn("c", F.when(escalate, F.col("c2")).otherwise(F.col("c1")))
    rows = rows.join(known.select(F.col("who"), F.lit(True).alias("in_k")), "who", "left")
    good = F.col("in_k") & (F.col("c") >= 0.5)
    return rows.select(key, F.when(good, F.col("who")).alias("who"), F.when(F.col("w1").isNull() & F.col("w2").isNull(), "undecided").when(good, "tiebreak").otherwise("unresolved_final").alias("method"))


def completeness(videos: DataFrame, key: str, checks: list[tuple[str, DataFrame]]) -> DataFrame:
    """(key, reason): the first of ``checks`` (reason, rows that fail, with the key) that a video is in, null if none."""
    out = videos.select(key)
    for i, (_, rows) in enumerate(checks):
        out = out.join(rows.select(key).distinct().withColumn(f"f{i}", F.lit(True)), key, "left")
    return out.select(key, F.coalesce(*[F.when(F.col(f"f{i}"), F.lit(r)) for i, (r, _) in enumerate(checks)]).alias("reason"))


def reward_samples(df: DataFrame, scores: list[str], sentiment: str, rating: str) -> DataFrame:
    """``df`` with ``score_reward`` (mean of the scores that aren't null, 0..10, on -1..1) and ``feedback_reward`` (sentiment
    times rating / 5, or 0.6 without a rating)."""
    have = F.array_compact(F.array(*[F.col(c).cast("double") for c in scores]))
    mean = F.try_divide(F.aggregate(have, F.lit(0.0), lambda s, x: s + x), F.size(have))
    return df.withColumn("score_reward", mean / 5 - 1).withColumn("feedback_reward", F.col(sentiment) * F.coalesce(F.col(rating) / 5, F.lit(0.6)))


def shrunk_mean(df: DataFrame, keys: list[str], value: str, prior: float = 3.0) -> DataFrame:
    """(keys, n, score): sum / (n + prior) of the values that aren't null."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s")).select(*keys, "n", (F.col("s") / (F.col("n") + prior)).alias("score"))


def pacing_profile(shots: DataFrame, key: str, duration: str) -> DataFrame:
    """(key, n, mean, median, variance, pace): variance is of a sample; fast below a mean of 2, moderate below 5, else slow."""
    out = shots.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(duration).alias("mean"), F.percentile(duration, F.lit(0.5)).alias("median"), F.coalesce(F.var_samp(duration), F.lit(0.0)).alias("variance"))
    return out.withColumn("pace", F.when(F.col("mean") < 2, "fast").when(F.col("mean") < 5, "moderate").otherwise("slow"))


def param_profile(grades: DataFrame, keys: list[str], params: str) -> DataFrame:
    """(keys, param, n, mean, variance) of a map of parameters; values that aren't numbers are left out."""
    rows = grades.select(*keys, F.explode(params).alias("param", "v")).withColumn("v", F.expr("try_cast(v as double)")).where("v is not null")
    return rows.groupBy(*keys, "param").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.coalesce(F.var_samp("v"), F.lit(0.0)).alias("variance"))


def call_costs(calls: DataFrame, prices: DataFrame, model: str, prompt: str, completion: str) -> DataFrame:
    """``calls`` with ``cost`` in the currency of ``prices`` (model, in_price, out_price, for a million), null for an unknown model."""
    rows = calls.join(F.broadcast(prices), model, "left")
    return rows.withColumn("cost", (F.col(prompt) * F.col("in_price") + F.col(completion) * F.col("out_price")) / 1e6).drop("in_price", "out_price")


def latency_summary(df: DataFrame, keys: list[str], ms: str, items: str) -> DataFrame:
    """(keys, n, mean, median, p95, items_per_s)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(ms).alias("mean"), F.percentile(ms, F.lit(0.5)).alias("median"), F.percentile(ms, F.lit(0.95)).alias("p95"), (1000 * F.sum(items) / F.sum(ms)).alias("items_per_s"))


def drift_against_source(delivered: DataFrame, source: DataFrame, keys: list[str], at: str, text: str, limit: float = 0.75) -> DataFrame:
    """Delivered texts against the source text nearest in time."""
    src = source.withColumn("src_text", F.col(text))
    return text_drift(nearest_by_time(delivered, src, keys, at, at, ["src_text"]), text, "src_text", limit)
