"""Queries for frame series and vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import duplicates as D
from ..operators import frames as O
from ..operators import lists as L
from ..operators import picks as P
from ..operators.shared import shared_dir
from .registry import query
from .views import sql, view

K = ["video_id", "shot_index"]
#: Pieces of SQL that several queries share.
SUMS = "sums as (select video_id, shot_index, pos, sum(x) as s from (select video_id, shot_index, unnest(embedding) as x, generate_subscripts(embedding, 1) as pos from frames) group by all)"
SPREAD = f"{SUMS}, own as (select video_id, shot_index, count(*) as n, sum(list_dot_product(embedding, embedding)) as own from frames group by all), spread as (select video_id, shot_index, n, case when n > 1 then 1 - (ss - own) / (n * (n - 1)) else 0.0 end as spread from own join (select video_id, shot_index, sum(s * s) as ss from sums group by all) using (video_id, shot_index))"
MOTION = "steps as (select video_id, shot_index, sqrt(greatest(0, 2 - 2 * list_dot_product(embedding, lag(embedding) over (partition by video_id, shot_index order by frame_index)))) as step from frames), motion as (select video_id, shot_index, coalesce(avg(step), 0.0) as motion from steps group by all)"
SCORED = f"{SPREAD}, {MOTION}, scored as (select s.video_id, s.shot_index, n, spread, motion, case when n > 1 then 0.5 * spread + 0.5 * motion else 0.0 end as complexity from spread s join motion m using (video_id, shot_index))"
COS = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
DIST = "d as (select video_id, frame_index, embedding, case when p is not null then 1 - " + COS.format(a="p", b="embedding") + " end as distance from (select *, lag(embedding) over (partition by video_id order by frame_index) as p from frames))"
TYPICAL = f"{SUMS}, total as (select video_id, shot_index, list(s order by pos) as t from sums group by all), typical as (select f.*, count(*) over g as n, case when count(*) over g > 1 then (list_dot_product(embedding, t) - list_dot_product(embedding, embedding)) / (count(*) over g - 1) else 0.0 end as typicality from frames f join total using (video_id, shot_index) window g as (partition by f.video_id, f.shot_index))"
VOLATILE = "near as (select *, list_dot_product(embedding, lag(embedding) over w) as a, list_dot_product(embedding, lead(embedding) over w) as b from typical window w as (partition by video_id, shot_index order by frame_index)), volatile as (select *, case when a is null and b is null then 0.0 else 1 - (coalesce(a, 0) + coalesce(b, 0)) / ((a is not null)::int + (b is not null)::int) end as volatility from near)"
ROLES = "scaled as (select *, coalesce((typicality - min(typicality) over g) / nullif(max(typicality) over g - min(typicality) over g, 0), 0.0) as t, coalesce((volatility - min(volatility) over g) / nullif(max(volatility) over g - min(volatility) over g, 0), 0.0) as v, count(*) over g = 1 or min(typicality) over g > 1 - 1e-9 as flat from volatile window g as (partition by video_id, shot_index)), c as (select *, row_number() over (partition by video_id, shot_index order by round(0.7 * t - 0.3 * v, 9) desc, frame_index) as cr from scaled), u as (select *, row_number() over (partition by video_id, shot_index order by case when cr > 1 then round(0.5 * (1 - t) + 0.5 * v, 9) end desc nulls last, frame_index) as ur from c), roles as (select video_id, shot_index, frame_index, embedding, case when flat then 'medoid' when cr = 1 then 'common' when ur = 1 then 'unique' end as role from u)"


def frames(s, d):
    return view(s, d, "frames")


@query("v1_vector_functions", sql(f"select video_id, frame_index, round(list_dot_product(p, embedding), 6) as dot, round({COS.format(a='p', b='embedding')}, 6) as cosine, round(sqrt(list_dot_product(embedding, embedding)), 6) as norm from (select *, lag(embedding) over (partition by video_id order by frame_index) as p from frames) where p is not null", "frames"))
def v1(s, d):
    from pyspark.sql import Window

    p = F.lag("embedding").over(Window.partitionBy("video_id").orderBy("frame_index"))
    rows = frames(s, d).withColumn("p", p).where("p is not null")
    return rows.select("video_id", "frame_index", F.round(V.dot("p", "embedding"), 6).alias("dot"), F.round(V.cosine("p", "embedding"), 6).alias("cosine"), F.round(V.l2norm("embedding"), 6).alias("norm"))


@query("v2_mean_pool", sql(f"with {SUMS}, n as (select video_id, shot_index, sqrt(sum(s * s)) as n from sums group by all) select video_id, shot_index, (pos - 1)::int as pos, round(s / n, 6) as x from sums join n using (video_id, shot_index)", "frames"))
def v2(s, d):
    return O.mean_pool(frames(s, d), K).select(*K, F.posexplode("pooled").alias("pos", "v")).select(*K, "pos", F.round("v", 6).alias("x"))


@query("v3_pairwise_spread", sql(f"with {SPREAD} select video_id, shot_index, n, round(spread, 6) as spread from spread", "frames"))
def v3(s, d):
    return O.pairwise_spread(frames(s, d), K).withColumn("spread", F.round("spread", 6))


@query("v4_motion_score", sql(f"with {MOTION} select video_id, shot_index, round(motion, 6) as motion from motion", "frames"))
def v4(s, d):
    return O.motion_score(frames(s, d), K, "frame_index").withColumn("motion", F.round("motion", 6))


@query("v5_complexity", sql(f"with {SCORED} select video_id, shot_index, n, round(spread, 6) as spread, round(motion, 6) as motion, round(complexity, 6) as complexity from scored", "frames"))
def v5(s, d):
    return O.complexity(frames(s, d), K, "frame_index").select(*K, "n", *[F.round(c, 6).alias(c) for c in ("spread", "motion", "complexity")])


LIMIT = "q as (select video_id, count(*) as n, quantile_cont(distance, 0.5) as q2, quantile_cont(distance, 0.75) - quantile_cont(distance, 0.25) as iqr from d where distance is not null group by 1), lim as (select video_id, case when n < 4 then 0.15 else least(0.5, greatest(0.15, q2 + 1.5 * iqr)) end as threshold from q)"


@query("v6_boundary_threshold", sql(f"with {DIST}, {LIMIT} select video_id, round(threshold, 6) as threshold from lim", "frames"))
def v6(s, d):
    return O.boundary_threshold(O.distances(frames(s, d), "video_id", "frame_index"), "video_id").withColumn("threshold", F.round("threshold", 6))


@query("v8_soft_boundaries", sql(f"with {DIST} select video_id, frame_index, round(distance, 6) as distance from (select *, greatest(coalesce(lag(distance) over w, '-inf'::double), coalesce(lead(distance) over w, '-inf'::double)) as near from d window w as (partition by video_id order by frame_index)) where distance >= 0.3 and distance > near", "frames"))
def v8(s, d):
    rows = O.distances(frames(s, d), "video_id", "frame_index").withColumn("threshold", F.lit(0.3))
    return O.soft_boundaries(rows, "video_id", "frame_index").select("video_id", "frame_index", F.round("distance", 6).alias("distance"))


@query("v9_hard_cuts", sql("select video_id, frame_index, round(diff, 6) as diff from (select *, list_sum(list_transform(list_zip(embedding, p), lambda z: abs(z[1] - z[2]))) / len(embedding) as diff from (select *, lag(embedding) over (partition by video_id order by frame_index) as p from frames) where p is not null) where diff > 0.14", "frames"))
def v9(s, d):
    return O.hard_cuts(frames(s, d), "video_id", "frame_index", 0.14).select("video_id", "frame_index", F.round("diff", 6).alias("diff"))


SMOOTH = "x as (select frame_id, x, avg(r) * 3 as v from pixels group by all), sm as (select *, (coalesce(lag(v) over w, 0.0) + v + coalesce(lead(v) over w, 0.0)) / 3 as smooth from x window w as (partition by frame_id order by x)), li as (select frame_id, case when count(*) >= 10 then greatest(quantile_cont(smooth, 0.85), 0.1) else 0.1 end as li from sm group by 1)"


@query("v10_spike_boundaries", sql(f"with {SMOOTH} select frame_id, x, round(smooth, 6) as smooth from sm join li using (frame_id) where smooth > li and not x between 1 and 1", "pixels"))
def v10(s, d):
    series = view(s, d, "pixels").groupBy("frame_id", "x").agg((F.avg("r") * 3).alias("v"))
    cuts = series.where("x = 1").select("frame_id", "x")
    return O.spike_boundaries(series, "frame_id", "x", "v", cuts, 0.1, 1).withColumn("smooth", F.round("smooth", 6))


@query("v11_boundaries_to_shots", sql("with tot as (select video_id, max(frame_index) + 1 as total from frames group by 1), m as (select video_id, frame_index as boundary, total from frames join tot using (video_id) where frame_index % 7 = 3 union select video_id, 0, total from tot) select video_id, row_number() over w - 1 as shot_index, boundary as start_frame, coalesce(lead(boundary) over w, total) - 1 as end_frame from m window w as (partition by video_id order by boundary)", "frames"))
def v11(s, d):
    f = frames(s, d)
    bounds = f.where("frame_index % 7 = 3").select("video_id", F.col("frame_index").alias("boundary"))
    return O.boundaries_to_shots(bounds, f.groupBy("video_id").agg((F.max("frame_index") + 1).alias("total")), "video_id")


@query("v12_merge_short")
def v12(s, d):
    return O.merge_short(view(s, d, "shots"), "video_id", 12)


@query("v13_split_long", sql("with o as (select plan_id, op_id, start_s::int as sf, start_s::int + (round((end_s - start_s) * 10))::int as ef from ops), n as (select *, ef - sf + 1 as n, ceil((ef - sf + 1) / 24.0)::int as parts from o) select plan_id, op_id, sf + part * (n // parts) + least(part, n % parts) as start_frame, sf + part * (n // parts) + least(part, n % parts) + n // parts + (part < n % parts)::int - 1 as end_frame, part, parts > 1 as is_forced_split from n, unnest(range(parts)) as r(part)", "ops"))
def v13(s, d):
    rows = view(s, d, "ops").select("plan_id", "op_id", F.col("start_s").cast("int").alias("start_frame"), (F.col("start_s").cast("int") + F.round((F.col("end_s") - F.col("start_s")) * 10).cast("int")).alias("end_frame"))
    return O.split_long(rows, F.lit(24))


@query("v14_candidate_grid", sql("with v as (select conv_id as video_id, sum(length(text)) as total from conversations group by 1) select video_id, unnest(range(0, total::int, greatest(1, round_even(25.0 / case when total < 3000 then 2.0 else 1.0 end, 0)::int)))::int as frame_index from v"))
def v14(s, d):
    videos = view(s, d, "conversations").groupBy(F.col("conv_id").alias("video_id")).agg(F.sum(F.length("text")).alias("total")).withColumn("fps", F.lit(25.0))
    return O.candidate_grid(videos, "video_id", "total", "fps", F.when(F.col("total") < 3000, 2.0).otherwise(1.0))


@query("v15_assign_frames", sql("with f as (select * from frames where frame_index % 5 <> 0 and frame_index % 16 < 9), inside as (select s.video_id, s.shot_index, f.frame_index from shots s join f on f.video_id = s.video_id and f.frame_index between start_frame and end_frame), bare as (select * from shots s where not exists (select 1 from inside i where i.video_id = s.video_id and i.shot_index = s.shot_index)) select * from inside union all select video_id, shot_index, frame_index from (select b.video_id, b.shot_index, f.frame_index, row_number() over (partition by b.video_id, b.shot_index order by abs(f.frame_index - (start_frame + end_frame) / 2.0), f.frame_index) as rn from bare b join f on f.video_id = b.video_id) where rn = 1", "frames", "shots"))
def v15(s, d):
    return O.assign_frames(frames(s, d).where("frame_index % 5 <> 0 and frame_index % 16 < 9"), view(s, d, "shots"), "video_id")


BUDGET = "budgeted as (select s.video_id, s.shot_index, round(complexity, 6) as complexity, duration_s, least(5, greatest(1 + (round(complexity, 6) > 0.8)::int + greatest(0, floor((duration_s - 2.0) / 1.0)), ceil(duration_s / 10.0)))::int as budget from shots s join scored using (video_id, shot_index))"


def budgeted(s, d):
    scored = O.complexity(frames(s, d), K, "frame_index").select(*K, F.round("complexity", 6).alias("complexity"))
    return O.shot_budget(view(s, d, "shots").join(scored, K), threshold=0.8, start_s=2.0, interval_s=1.0).select(*K, "complexity", "duration_s", "budget")


@query("v16_shot_budget", sql(f"with {SCORED}, {BUDGET} select * from budgeted", "shots"))
def v16(s, d):
    return budgeted(s, d)


TRIM = "t1 as (select * exclude (budget), case when sum(budget) over (partition by video_id) - coalesce(sum(greatest(0, budget - 2)) over w, 0) > {most} then budget - greatest(0, budget - 2) else budget end as budget from budgeted window w as (partition by video_id order by complexity, shot_index rows between unbounded preceding and 1 preceding)), t2 as (select * exclude (budget), case when sum(budget) over (partition by video_id) - coalesce(sum(greatest(0, budget - 1)) over w, 0) > {most} then budget - greatest(0, budget - 1) else budget end as budget from t1 window w as (partition by video_id order by complexity, shot_index rows between unbounded preceding and 1 preceding))".format(most=14)


@query("v17_enforce_cap", sql(f"with {SCORED}, {BUDGET}, {TRIM} select video_id, shot_index, complexity, duration_s, budget from t2", "shots"))
def v17(s, d):
    return O.enforce_cap(budgeted(s, d), "video_id", "shot_index", 14)


@query("v18_budget_stats", sql(f"with {SCORED}, {BUDGET} select video_id, count(*) as shots, sum(budget)::bigint as frames, min(budget) as least, max(budget) as most, round(avg(budget), 6) as mean, count(*) filter (budget > 1) as above_base from budgeted group by 1", "shots"))
def v18(s, d):
    return O.budget_stats(budgeted(s, d), "video_id").withColumn("mean", F.round("mean", 6))


@query("v19_typicality", sql(f"with {TYPICAL} select video_id, shot_index, frame_index, round(typicality, 6) as typicality from typical", "frames"))
def v19(s, d):
    return P.typicality(frames(s, d), K).select(*K, "frame_index", F.round("typicality", 6).alias("typicality"))


@query("v20_volatility", sql(f"with {TYPICAL}, {VOLATILE} select video_id, shot_index, frame_index, round(volatility, 6) as volatility from volatile", "frames"))
def v20(s, d):
    return P.volatility(frames(s, d), K, "frame_index").select(*K, "frame_index", F.round("volatility", 6).alias("volatility"))


@query("v21_minmax", "select l_orderkey as plan_id, l_linenumber as ln, l_extendedprice as p, round(coalesce((l_extendedprice - min(l_extendedprice) over g) / nullif(max(l_extendedprice) over g - min(l_extendedprice) over g, 0), 0.0), 6) as scaled from lineitem window g as (partition by l_orderkey)")
def v21(s, d):
    rows = view(s, d, "lineitem").select(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("ln"), F.col("l_extendedprice").alias("p"))
    return P.minmax(rows, "p", ["plan_id"], "scaled").withColumn("scaled", F.round("scaled", 6))


@query("v22_select_roles", sql(f"with {TYPICAL}, {VOLATILE}, {ROLES} select video_id, shot_index, frame_index, role from roles where role is not null", "frames"))
def v22(s, d):
    return P.select_roles(frames(s, d), K, "frame_index")


def spaced(rows: str, spacing: int, budget: int) -> str:
    """Of each shot's rows by typicality, those at least ``spacing`` from all that were taken before, up to ``budget``."""
    return f"""
with recursive {TYPICAL}, {rows},
ranked as (select video_id, shot_index, frame_index, row_number() over (partition by video_id, shot_index order by round(typicality, 9) desc, frame_index) as i from free),
scan as (
  select video_id, shot_index, 0::bigint as i, []::bigint[] as taken from (select distinct video_id, shot_index from ranked)
  union all
  select s.video_id, s.shot_index, r.i,
         case when len(taken) < {budget} and len(list_filter(taken, lambda t: abs(t - r.frame_index) < {spacing})) = 0 then list_append(taken, r.frame_index) else taken end
  from scan s join ranked r on r.video_id = s.video_id and r.shot_index = s.shot_index and r.i = s.i + 1
)
select video_id, shot_index, unnest(arg_max(taken, i)) as frame_index from scan group by 1, 2
"""


def typical(s, d):
    return P.typicality(frames(s, d), K).withColumn("typicality", F.round("typicality", 9))


@query("v23_select_extras", sql(spaced("free as (select * from typical)", 2, 3).strip(), "frames"))
def v23(s, d):
    return P.select_extras(typical(s, d).withColumn("budget", F.lit(3)), K, "frame_index", "typicality", "budget", 2)


def key_shots(s, d):
    return O.mean_pool(frames(s, d), K).withColumnRenamed("pooled", "embedding")


TREE = f"with {SUMS}, l0 as (select video_id, shot_index as node, list(s / sqrt(q) order by pos) as e from sums join (select video_id, shot_index, sum(s * s) as q from sums group by all) using (video_id, shot_index) group by all)"
for _i, (_name, _size) in enumerate((("chunk", "node // 5"), ("scene", "node // 3"), ("sequence", "node // 3"), ("video", "0"))):
    TREE += f", r{_i} as (select video_id, ({_size})::int as node, e from l{_i}), s{_i} as (select video_id, node, pos, sum(x) as s from (select video_id, node, unnest(e) as x, generate_subscripts(e, 1) as pos from r{_i}) group by all), q{_i} as (select video_id, node, sum(s * s) as q from s{_i} group by all), n{_i} as (select video_id, node, count(*) as n, sum(list_dot_product(e, e)) as own from r{_i} group by all), l{_i + 1} as (select video_id, node, list(s / sqrt(q) order by pos) as e from s{_i} join q{_i} using (video_id, node) group by all)"
TREE += " " + " union all ".join(f"select video_id, node, n, round(case when n > 1 then 1 - (q - own) / (n * (n - 1)) else 0.0 end, 6) as diversity, '{_n}' as level from n{_i} join q{_i} using (video_id, node)" for _i, _n in enumerate(("chunk", "scene", "sequence", "video")))


@query("v24_diversity_tree", sql(TREE, "frames"))
def v24(s, d):
    return P.diversity_tree(key_shots(s, d), "video_id").withColumn("diversity", F.round("diversity", 6))


PRUNED = TREE[: TREE.index(", r0 as")] + """,
r as (select video_id, node as shot_index, node // 5 as chunk, e from l0),
t as (select video_id, chunk, pos, sum(x) as s from (select video_id, chunk, unnest(e) as x, generate_subscripts(e, 1) as pos from r) group by all),
total as (select video_id, chunk, list(s order by pos) as t, sum(s * s) as q from t group by 1, 2),
own as (select video_id, chunk, count(*) as n, sum(list_dot_product(e, e)) as own from r group by 1, 2),
ranked as (
  select video_id, shot_index, n, case when n > 1 then 1 - (q - own) / (n * (n - 1)) else 0.0 end as spread,
         row_number() over (partition by video_id, chunk order by round(case when n > 1 then (list_dot_product(e, t) - list_dot_product(e, e)) / (n - 1) else 0.0 end, 9) desc, shot_index) as rank
  from r join total using (video_id, chunk) join own using (video_id, chunk)
),
pruned as (select video_id, shot_index from ranked where n < 2 or spread > 0.6 or rank = 1)
"""


@query("v25_prune_chunks", sql(f"{PRUNED.strip()} select * from pruned", "frames"))
def v25(s, d):
    return P.prune_chunks(key_shots(s, d), "video_id", 0.6)


@query("v26_compression_stats", sql(f"{PRUNED.strip()} select video_id, before, after, round(before / after, 6) as ratio from (select video_id, count(*) as before from l0 group by 1) join (select video_id, count(*) as after from pruned group by 1) using (video_id)", "frames"))
def v26(s, d):
    before, after = key_shots(s, d).groupBy("video_id").agg(F.count(F.lit(1)).alias("before")), P.prune_chunks(key_shots(s, d), "video_id", 0.6).groupBy("video_id").agg(F.count(F.lit(1)).alias("after"))
    return before.join(after, "video_id").withColumn("ratio", F.round(F.col("before") / F.col("after"), 6))


@query("v27_novelty_missed", sql("with best as (select f.video_id, f.shot_index, f.frame_index, max(list_dot_product(f.embedding, k.embedding)) as best from frames f join frames k on k.video_id = f.video_id and k.frame_index % 10 = 0 group by all), n as (select video_id, shot_index, least(1.0, greatest(0.0, 1 - min(best))) as novelty from best group by all) select video_id, count(*) as shots, round(max(novelty), 6) as max_novelty, round(avg(novelty), 6) as mean_novelty, count(*) filter (novelty > 0.15) as n_missed from n group by 1", "frames"))
def v27(s, d):
    f = frames(s, d)
    out = P.novelty_missed(f, f.where("frame_index % 10 = 0"), "video_id", "shot_index")
    return out.select("video_id", "shots", F.round("max_novelty", 6).alias("max_novelty"), F.round("mean_novelty", 6).alias("mean_novelty"), "n_missed")


@query("v28_leader_cluster")
def v28(s, d):
    return P.leader_cluster(frames(s, d), ["video_id"], "frame_index", 0.6)


@query("v29_mark_duplicates", sql(f"with recursive links as (select b.video_id, a.frame_index as x, b.frame_index as y from frames a join frames b on a.video_id = b.video_id and a.frame_index < b.frame_index and round({COS.format(a='a.embedding', b='b.embedding')}, 9) >= 0.45), adj as (select f.video_id, f.frame_index as y, coalesce(list(x) filter (x is not null), []) as xs from frames f left join links l on l.video_id = f.video_id and l.y = f.frame_index group by all), scan as (select video_id, y, [y] as kept, null::int as dup from adj where y = 0 union all select a.video_id, a.y, case when len(list_intersect(s.kept, a.xs)) = 0 then list_append(s.kept, a.y) else s.kept end, list_min(list_intersect(s.kept, a.xs)) from scan s join adj a on a.video_id = s.video_id and a.y = s.y + 1) select video_id * 100000 + y as fact_id, video_id * 100000 + dup as duplicate_of from scan", "frames"))
def v29(s, d):
    rows = frames(s, d).withColumn("fact_id", F.col("video_id") * 100000 + F.col("frame_index"))
    return D.mark_duplicates(rows, "video_id", "frame_index", "fact_id", 0.45)


ACROSS = f"""
with recursive f as (select vec_id, row_number() over (order by vec_id) as i, embedding::double[] as e from embeddings),
adj as (
  select b.vec_id, b.i, coalesce(list(a.vec_id) filter (a.vec_id is not null), []) as xs
  from f b left join f a on a.i < b.i and round({COS.format(a='a.e', b='b.e')}, 9) >= 0.6 group by all
),
scan as (
  select vec_id, i, [vec_id] as kept, null::bigint as dup from adj where i = 1
  union all
  select a.vec_id, a.i, case when len(list_intersect(s.kept, a.xs)) = 0 then list_append(s.kept, a.vec_id) else s.kept end, list_min(list_intersect(s.kept, a.xs))
  from scan s join adj a on a.i = s.i + 1
)
select vec_id, dup as duplicate_of from scan
"""


@query("v29_duplicates_across_videos", ACROSS.strip())
def v29_across(s, d):
    e = view(s, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return D.mark_duplicates(e, None, "vec_id", "vec_id", 0.6)


@query("v30_knn", sql(f"select query, id, rank, score from (select *, row_number() over (partition by query order by score desc, id) as rank from (select q.vec_id as query, c.vec_id as id, round({COS.format(a='c.embedding::double[]', b='q.embedding::double[]')}, 9) as score from embeddings q join embeddings c on c.vec_id <> q.vec_id and c.label <> 3 where q.vec_id % 50 = 0)) where rank <= 5"))
def v30(s, d):
    e = view(s, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return P.knn(e.where("vec_id % 50 = 0"), e, 5, "vec_id", "vec_id", keep=F.col("label") != 3)


def inverted(s, d):
    """The embeddings, an index of them in a new shared folder, every fiftieth as a query, and the probes that these need."""
    e = view(s, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    index = L.build_lists(e, f"{shared_dir(s).rstrip('/')}/lists-{uuid.uuid4().hex}", "vec_id")
    q = e.where("vec_id % 50 = 0")
    return q, index, L.fewest_probes(L.recall_curve(index, q, e, 5, "vec_id", "vec_id"))


@query("v31_cell_search")
def v31(s, d):
    q, index, (probes, _, _) = inverted(s, d)
    return L.search_lists(index, q, 5, "vec_id", probes)


@query("v31_recall")
def v31_recall(s, d):
    """Recall against the exact search (v30) at the probes that the search takes, and the rows it reads."""
    _, index, (probes, recall, share) = inverted(s, d)
    return s.createDataFrame([(len(index.centres), probes, recall, share)], "lists int, probes int, recall double, share_read double")


@query("v32_gallery_match", sql(f"with s as (select q.vec_id as query, g.label as owner, max(round({COS.format(a='q.embedding::double[]', b='g.embedding::double[]')}, 9)) as score from embeddings q join embeddings g on g.vec_id < 60 where q.vec_id >= 60 group by all), r as (select *, row_number() over w as rank, lead(score) over w as runner_up from s window w as (partition by query order by score desc, owner)) select query, owner, score, runner_up, case when score < 0.38 then 'unknown' when score - coalesce(runner_up, -1.0) < 0.06 then 'ambiguous' else 'match' end as status from r where rank = 1"))
def v32(s, d):
    e = view(s, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return P.gallery_match(e.where("vec_id >= 60").withColumnRenamed("vec_id", "query"), e.where("vec_id < 60").withColumnRenamed("label", "owner"))


@query("v33_weighted_centroid", "with w as (select label, pos, sum(x * w) as s from (select label, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as pos, greatest(0.001, (vec_id % 10) / 10.0) as w from embeddings) group by all), n as (select label, sqrt(sum(s * s)) as n from w group by 1) select label, (pos - 1)::int as pos, round(s / n, 6) as x from w join n using (label)")
def v33(s, d):
    e = view(s, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return P.weighted_centroid(e, ["label"], (F.col("vec_id") % 10) / 10.0).select("label", F.posexplode("centroid").alias("pos", "v")).select("label", "pos", F.round("v", 6).alias("x"))


@query("v34_box_set_change", "with b as (select l_orderkey as k, l_linenumber as i, list({'x1': l_quantity, 'y1': l_discount * 100, 'x2': l_quantity + 10, 'y2': l_discount * 100 + 5}) as boxes from lineitem group by all), p as (select *, lag(boxes) over (partition by k order by i) as before from b), a as (select k, i, unnest(boxes) as a, before, len(boxes) as n, len(before) as m from p where before is not null), v as (select k, i, n, m, list_max(list_transform(before, lambda z: (greatest(0.0, least(a.x2, z.x2) - greatest(a.x1, z.x1)) * greatest(0.0, least(a.y2, z.y2) - greatest(a.y1, z.y1))) / (50 + 50 - greatest(0.0, least(a.x2, z.x2) - greatest(a.x1, z.x1)) * greatest(0.0, least(a.y2, z.y2) - greatest(a.y1, z.y1))))) as best from a) select k, i, round(sum(best) / any_value(n), 6) as iou, abs(any_value(n) - any_value(m))::int as delta, sum(best) / any_value(n) < 0.3 and abs(any_value(n) - any_value(m)) >= 1 as changed from v group by all")
def v34(s, d):
    box = F.struct(F.col("l_quantity").alias("x1"), (F.col("l_discount") * 100).alias("y1"), (F.col("l_quantity") + 10).alias("x2"), (F.col("l_discount") * 100 + 5).alias("y2"))
    rows = view(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i")).agg(F.collect_list(box).alias("boxes"))
    return P.box_set_change(rows, "k", "i", least_delta=1).withColumn("iou", F.round("iou", 6))


FREE = "free as (select * from typical t where not exists (select 1 from typical e where e.video_id = t.video_id and e.shot_index = t.shot_index and e.frame_index % 8 = 0 and abs(e.frame_index - t.frame_index) < 2))"


@query("v35_suppress_near", sql(spaced(FREE, 2, 1 << 30).strip(), "frames"))
def v35(s, d):
    rows = typical(s, d)
    return P.suppress_near(rows, rows.where("frame_index % 8 = 0"), K, "frame_index", "typicality", 2)


MATCH = "sel as (select * from frames where frame_index % 17 = 3), tru as (select * from frames where frame_index % 11 = 0), a as (select video_id, count(*) as ns, count(*) filter (exists (select 1 from tru t where t.video_id = s.video_id and abs(t.frame_index - s.frame_index) <= 2)) as hs from sel s group by 1), b as (select video_id, count(*) as nt, count(*) filter (exists (select 1 from sel s where t.video_id = s.video_id and abs(t.frame_index - s.frame_index) <= 2)) as ht from tru t group by 1), m as (select video_id, case when coalesce(nt, 0) = 0 then 1.0 else ht / nt end as recall, case when coalesce(ns, 0) = 0 then 0.0 else hs / ns end as precision from a full join b using (video_id)), rep as (select video_id, recall, precision, case when recall + precision > 0 then 2 * recall * precision / (recall + precision) else 0.0 end as f1 from m)"


def matched(s, d):
    f = frames(s, d)
    return P.match_at_k(f.where("frame_index % 17 = 3").select("video_id", "frame_index"), f.where("frame_index % 11 = 0").select("video_id", "frame_index"), "video_id", "frame_index", 2)


@query("v36_match_at_k", sql(f"with {MATCH} select video_id, round(recall, 6) as recall, round(precision, 6) as precision, round(f1, 6) as f1 from rep", "frames"))
def v36(s, d):
    return matched(s, d).select("video_id", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "f1")])


@query("v37_eval_report", sql(f"with {MATCH} select case when video_id % 2 = 0 then 'even' else 'odd' end as vertical, count(*) as n, round(avg(recall), 6) as recall, round(avg(f1), 6) as f1 from rep group by rollup (1)", "frames"))
def v37(s, d):
    rows = matched(s, d).withColumn("vertical", F.when(F.col("video_id") % 2 == 0, "even").otherwise("odd"))
    return rows.rollup("vertical").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("f1"), 6).alias("f1"))


ON = "fl as (select key, frame, confidence > 0.6 as on_ from observations), st as (select *, sum((not on_ and coalesce(p, true))::int) over w as island from (select *, lag(on_) over (partition by key order by frame) as p from fl) window w as (partition by key order by frame)), sc as (select key, min(frame) as start_frame, max(frame) as end_frame from st where not on_ group by key, island union all select key, min(frame), max(frame) from fl group by key having bool_and(on_))"


def scenes(s, d):
    rows = view(s, d, "observations").select("key", "frame", (F.col("confidence") > 0.6).alias("on"))
    return O.predictions_to_scenes(rows, "key", "frame", "on")


@query("v38_predictions_to_scenes", sql(f"with {ON} select * from sc", "observations"))
def v38(s, d):
    return scenes(s, d)


def trans(name, flag):
    """SQL of the transitions (key, thr, a, b) by ``flag`` of the rows of fl, widened for a tolerance of two frames, and of their lists by key."""
    return (
        f"{name}1 as (select key, thr, frame, {flag} as on_, lag({flag}) over (partition by key, thr order by frame) as p from fl), {name}2 as (select *, sum((not on_ and coalesce(p, true))::int) over (partition by key, thr order by frame) as island from {name}1), "
        f"{name}3 as (select key, thr, min(frame) as s, max(frame) as e from {name}2 where not on_ group by key, thr, island), {name}4 as (select key, thr, e - 0.5 as a, lead(s) over (partition by key, thr order by s) + 0.5 as b from {name}3), {name} as (select key, thr, list({{'a': a, 'b': b}} order by a) as l from {name}4 where b is not null group by all)"
    )


SWEPT = (
    "with recursive th(thr) as (values (0.02::double), (0.06), (0.1), (0.15), (0.2), (0.3), (0.4), (0.5), (0.6), (0.7), (0.8), (0.9)), fl as (select key, frame, thr, label = 'purchase' as real, confidence > thr as guess from observations, th), "
    + trans("gt", "real") + ", " + trans("pt", "guess")
    + ", pr as (select key, thr, coalesce(gt.l, []) as gs, coalesce(pt.l, []) as ps from gt full join pt using (key, thr)), walk as (select key, thr, 1::bigint as i, 1::bigint as j, 0 as tp from pr union all select key, thr, case when ps[j].b < gs[i].a then i else i + 1 end, case when ps[j].a > gs[i].b then j else j + 1 end, tp + (ps[j].b >= gs[i].a and ps[j].a <= gs[i].b)::int from walk join pr using (key, thr) where i <= len(gs) and j <= len(ps)), "
    "hit as (select key, thr, max(tp) as tp from walk group by all), su as (select thr as threshold, coalesce(sum(tp), 0)::bigint as tp, coalesce(sum(len(ps) - tp), 0)::bigint as fp, coalesce(sum(len(gs) - tp), 0)::bigint as fn from th left join (select * from hit join pr using (key, thr)) using (thr) group by 1), "
    "ra as (select *, coalesce(tp / nullif(tp + fp, 0), 0) as precision, coalesce(tp / nullif(tp + fn, 0), 0) as recall from su), f as (select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1 from ra) "
    "select threshold, tp, fp, fn, round(precision, 9) as precision, round(recall, 9) as recall, round(f1, 9) as f1, row_number() over (order by round(f1, 9) desc, threshold) = 1 as best from f"
)


@query("v39_transition_f1", sql(SWEPT, "observations"))
def v39(s, d):
    rows = view(s, d, "observations").select("key", "frame", "confidence", (F.col("label") == "purchase").alias("real"))
    out = O.threshold_sweep(rows, "key", "frame", "confidence", "real")
    return out.select("threshold", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "best")


@query("v40_frame_labels", sql(f"with {ON}, g as (select key, lag(end_frame) over (partition by key order by start_frame) as a, start_frame as b from sc) select key, f as frame_index, (f = floor((a + b) / 2))::int as one_hot, 1 as many_hot from g, unnest(range(a, b + 1)) as r(f) where a is not null", "observations"))
def v40(s, d):
    return O.frame_labels(scenes(s, d), "key")


@query("v7_change_score", sql("with r as (select video_id, frame_index, embedding, row_number() over w - 1 as rk, count(*) over (partition by video_id) - 1 as n, frame_index % 29 = 28 as hard from frames window w as (partition by video_id order by frame_index)), c as (select *, coalesce(max(case when hard then rk end) over (partition by video_id order by rk rows between unbounded preceding and 1 preceding), 0) as lo, coalesce(min(case when hard then rk end) over (partition by video_id order by rk rows between 1 following and unbounded following), n) as hi from r), h as (select *, greatest(1, least(15, greatest(3, (hi - lo) // 4)) // 2) as half, hard or rk = 0 or rk = n as out from c), x as (select video_id, rk, unnest(embedding) as x, generate_subscripts(embedding, 1) as pos from r), m as (select h.video_id, h.frame_index, h.out, pos, avg(x) filter (x.rk < h.rk) as a, avg(x) filter (x.rk >= h.rk) as b from h join x on x.video_id = h.video_id and x.rk >= h.rk - half and x.rk < h.rk + half group by all) select video_id, frame_index, case when out then 0.0 else round(1 - sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))), 6) end as score from m group by video_id, frame_index, out", "frames"))
def v7(s, d):
    return O.change_score(frames(s, d).withColumn("hard", F.col("frame_index") % 29 == 28), "video_id", "frame_index", "hard").withColumn("score", F.round("score", 6))
