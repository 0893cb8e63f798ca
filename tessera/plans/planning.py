"""Queries for plans, checks, feedback and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import planning as P
from .registry import query
from .views import sql, view


def ops(s, d):
    return view(s, d, "ops")




def clip():
    return F.col("kind") != "R"


@query("p1_rank_candidates", sql("select plan_id, op_id, scene_id, p_size, row_number() over (partition by plan_id order by relevance desc, op_id) as rank from ops join part on p_partkey = scene_id where p_size > 20", "ops"))
def p1(s, d):
    items = view(s, d, "part").where("p_size > 20").select(F.col("p_partkey").alias("scene_id"), "p_size")
    ranked = P.rank_candidates(ops(s, d).withColumn("item", F.col("op_id")), items, ["plan_id"], "scene_id", "relevance")
    from pyspark.sql import Window

    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("plan_id").orderBy(F.desc("relevance"), "op_id"))).select("plan_id", "op_id", "scene_id", "p_size", "rank")


@query("p2_backfill_ops", sql("select plan_id, op_id, coalesce(case when op_id % 2 = 0 then start_s end, p_size / 2.0) as start_s, coalesce(case when op_id % 3 = 0 then end_s end, p_size * 1.0) as end_s from ops join part on p_partkey = scene_id and p_size > 10", "ops"))
def p2(s, d):
    o = ops(s, d).withColumn("start_s", F.when(F.col("op_id") % 2 == 0, F.col("start_s"))).withColumn("end_s", F.when(F.col("op_id") % 3 == 0, F.col("end_s")))
    c = view(s, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("scene_id"), (F.col("p_size") / 2.0).alias("start_s"), (F.col("p_size") * 1.0).cast("double").alias("end_s"))
    return P.backfill_ops(o, c, "scene_id").select("plan_id", "op_id", "start_s", "end_s")


@query("p3_plan_duration", sql("select plan_id, round(sum(case when kind <> 'R' then greatest(0.0, end_s - start_s) else 0.0 end), 4) as duration from ops group by 1", "ops"))
def p3(s, d):
    return P.plan_duration(ops(s, d), "plan_id", clip()).withColumn("duration", F.round("duration", 4))


@query("p4_resequence", sql("select plan_id, op_id, row_number() over (partition by plan_id order by (kind = 'R')::int, op_id) - 1 as sequence_index from ops", "ops"))
def p4(s, d):
    return P.resequence(ops(s, d), "plan_id", "op_id", clip()).select("plan_id", "op_id", "sequence_index")


@query("p5_trim_to_target", sql("select plan_id, op_id from (select *, round(sum(round(greatest(0.0, end_s - start_s), 6)) over (partition by plan_id) - coalesce(sum(round(greatest(0.0, end_s - start_s), 6)) over (partition by plan_id order by relevance, op_id rows between unbounded preceding and 1 preceding), 0.0), 6) > 12 as drop_ from ops) where not drop_", "ops"))
def p5(s, d):
    return P.trim_to_target(ops(s, d).withColumn("target", F.lit(12.0)), "plan_id", "op_id", "relevance", "target").select("plan_id", "op_id")


@query("p6_validate_plans", sql("with x as (select o.*, p_size from ops o left join part on p_partkey = scene_id and p_size > 2), a as (select plan_id, bool_or(kind = 'A' and op_id = 7) as kind_, count(*) filter (kind <> 'R') as n, bool_or(kind <> 'R' and p_size is null) as unknown_, bool_or(coalesce(kind <> 'R' and (start_s < 1 - 0.05 or end_s > 55 + 0.05), false)) filter (p_size is not null) as outside_, min(op_id - 1) filter (kind <> 'R') as lo, max(op_id - 1) filter (kind <> 'R') as hi, count(distinct op_id) filter (kind <> 'R') as nd from x group by 1) select plan_id, case when kind_ then 'unknown type' when n = 0 then 'no clip' when unknown_ then 'unknown scene' when coalesce(outside_, false) then 'out of bounds' when lo <> 0 or hi <> n - 1 or nd <> n then 'not contiguous' end as reason from a", "ops"))
def p6(s, d):
    scenes = view(s, d, "part").where("p_size > 2").select(F.col("p_partkey").alias("scene_id"), F.lit(1.0).alias("s_start"), F.lit(55.0).alias("s_end"))
    rows = ops(s, d).withColumn("i", F.col("op_id") - 1)
    return P.validate_plans(rows, scenes, "plan_id", "scene_id", "i", clip(), ~((F.col("kind") == "A") & (F.col("op_id") == 7)))


@query("p7_apply_diff", sql("with df as (select plan_id, op_id + (op_id % 3 = 0)::int * 10 as op_id, op_id as seq, case when op_id % 4 = 0 then 'remove' else 'modify' end as action, case when op_id % 2 = 0 then relevance + 1 end as relevance from ops where plan_id % 5 = 0), j as (select coalesce(o.plan_id, df.plan_id) as plan_id, coalesce(o.op_id, df.op_id) as op_id, coalesce(df.relevance, o.relevance) as relevance, o.op_id as pos, df.seq from ops o full join df on df.plan_id = o.plan_id and df.op_id = o.op_id where coalesce(df.action, '') <> 'remove') select plan_id, op_id, relevance, row_number() over (partition by plan_id order by pos is null, pos, seq) - 1 as position from j", "ops"))
def p7(s, d):
    o = ops(s, d)
    diff = o.where("plan_id % 5 = 0").select("plan_id", (F.col("op_id") + F.when(F.col("op_id") % 3 == 0, 10).otherwise(0)).alias("op_id"), F.col("op_id").alias("seq"), F.when(F.col("op_id") % 4 == 0, "remove").otherwise("modify").alias("action"), F.when(F.col("op_id") % 2 == 0, F.col("relevance") + 1).alias("relevance"))
    return P.apply_diff(o.select("plan_id", "op_id", "relevance", F.col("op_id").alias("pos")), diff, ["plan_id", "op_id"], "pos", ["relevance"])


@query("p8_neighbours", sql("select plan_id, op_id, array_to_string(list_concat(list(scene_id) over (w rows between 2 preceding and 1 preceding), list(scene_id) over (w rows between 1 following and 2 following)), ',') as near from ops window w as (partition by plan_id order by op_id)", "ops"))
def p8(s, d):
    return P.neighbours(ops(s, d), ["plan_id"], "op_id", "scene_id").select("plan_id", "op_id", F.array_join(F.transform("near", lambda x: x.cast("string")), ",").alias("near"))


ADJ = "adj as (select l_orderkey as k, l_linenumber as i, l_partkey as t, case l_linenumber % 4 when 0 then 'exposure' when 1 then 'contrast' when 2 then 'warmth' else 'unknown' end as param, case when l_quantity > 25 then l_quantity / 10 end as recommended, l_discount * 10 as current, l_tax * 50 as delta from lineitem), bounds as (select * from (values ('exposure', -2.0, 2.0), ('contrast', 0.0, 3.0), ('warmth', -1.0, 5.0)) b(param, lo, hi)), fin as (select k, i, t, adj.param, coalesce(recommended, current) + delta as raw, least(hi, greatest(lo, coalesce(recommended, current) + delta)) as final from adj join bounds using (param))"


def adj(s, d):
    param = F.element_at(F.array(*[F.lit(x) for x in ("exposure", "contrast", "warmth", "unknown")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return view(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), F.col("l_partkey").alias("t"), param.alias("param"), F.when(F.col("l_quantity") > 25, F.col("l_quantity") / 10).alias("recommended"), (F.col("l_discount") * 10).alias("current"), (F.col("l_tax") * 50).alias("delta"))


def bounds(s):
    return s.createDataFrame([("exposure", -2.0, 2.0), ("contrast", 0.0, 3.0), ("warmth", -1.0, 5.0)], "param string, lo double, hi double")


@query("p9_clamp_deltas", f"with {ADJ} select k, i, t, param, round(final, 6) as final, raw <> final as clamped from fin")
def p9(s, d):
    return P.clamp_deltas(adj(s, d), bounds(s), "param").select("k", "i", "t", "param", F.round("final", 6).alias("final"), "clamped")


@query("p10_dominance", sql("select plan_id, op_id, n is null or relevance > 2 * n as decided from (select *, row_number() over w as r, lead(relevance) over w as n from ops window w as (partition by plan_id order by relevance desc, op_id)) where r = 1", "ops"))
def p10(s, d):
    return P.dominance(ops(s, d), ["plan_id"], "op_id", "relevance")


@query("p11_materialise", sql("select plan_id, count(*) filter (p.p_partkey is null) as no_background, count(*) filter (s.s_suppkey is null) as no_matte from ops o left join (select * from part where p_size % 2 = 0) p on p.p_partkey = scene_id left join (select * from supplier where s_nationkey < 12) s on s.s_suppkey = scene_id % 100 group by 1", "ops"))
def p11(s, d):
    backs = view(s, d, "part").where("p_size % 2 = 0").select(F.col("p_partkey").alias("scene_id"), F.col("p_name").alias("background"))
    mattes = view(s, d, "supplier").where("s_nationkey < 12").select(F.col("s_suppkey").alias("shot"), F.col("s_name").alias("matte"))
    return P.miss_counts(P.materialise(ops(s, d).withColumn("shot", F.col("scene_id") % 100), backs, mattes, "scene_id", "shot"), ["plan_id"], ["background", "matte"])


@query("p12_target_map", sql("select plan_id, op_id, split_part(r, ':', 1) as target_type, split_part(r, ':', 2) as target_id from (select plan_id, op_id, unnest(['CLIP:' || op_id, kind || ':' || scene_id]) as r from ops)", "ops"))
def p12(s, d):
    refs = F.array(F.concat(F.lit("CLIP:"), F.col("op_id")), F.concat_ws(":", "kind", "scene_id"), F.lit("bare"))
    return P.target_map(ops(s, d).withColumn("refs", refs), ["plan_id", "op_id"], "refs")


@query("p13_derived_scales", f"with {ADJ} select k, round(avg(case when param = 'exposure' then final / 5 end), 6) as brightness, round(avg(case when param = 'contrast' then 1 + final / 4 end), 6) as contrast, round(avg(case when param = 'warmth' then final * 0.02 end), 6) as red_offset from fin group by 1")
def p13(s, d):
    final = F.col("final")
    rows = P.clamp_deltas(adj(s, d), bounds(s), "param")
    mean = lambda p, c, n: F.round(F.avg(F.when(F.col("param") == p, c)), 6).alias(n)
    return rows.groupBy("k").agg(mean("exposure", final / 5, "brightness"), mean("contrast", 1 + final / 4, "contrast"), mean("warmth", final * 0.02, "red_offset"))


@query("p14_level_runs", sql("with h as (select key, sec, confidence < 0.3 as hit, lead(sec) over w as nx from observations window w as (partition by key order by sec)), i as (select *, sum((hit and not coalesce(p, false))::int) over (partition by key order by sec rows unbounded preceding) as island from (select *, lag(hit) over (partition by key order by sec) as p from h)), r as (select key, min(sec) as start_s, arg_max(coalesce(nx, -1), sec) as e from i where hit group by key, island) select key, start_s, nullif(e, -1) as end_s from r where e = -1 or e - start_s >= 7200", "observations"))
def p14(s, d):
    return P.level_runs(view(s, d, "observations").select("key", "sec", "confidence"), "key", "sec", F.col("confidence") < 0.3, 7200.0)


@query("p15_loudness_eval", "select event_id, target, round(diff, 4) as diff, abs(diff) <= 1.0 as ok from (select event_id, case when event_type = 'view' then -16.0 else -14.0 end as target, -value / 5 - case when event_type = 'view' then -16.0 else -14.0 end as diff from events)")
def p15(s, d):
    e = view(s, d, "events").withColumn("m", -F.col("value") / 5)
    return P.loudness_eval(e, "m", F.when(F.col("event_type") == "view", "podcast").otherwise("web")).select("event_id", "target", F.round("diff", 4).alias("diff"), "ok")


@query("p16_text_drift")
def p16(s, d):
    """Each turn, as delivered, against the turn before it, as its source."""
    from pyspark.sql import Window

    c = view(s, d, "conversations").withColumn("source", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("source is not null")
    return P.text_drift(c, "text", "source").select("conv_id", "turn", F.round("similarity", 6).alias("similarity"), "drift")


@query("p17_clip_audit", f"with {ADJ} select param, count(*) as n from fin where raw <> final group by 1")
def p17(s, d):
    return P.clamp_deltas(adj(s, d), bounds(s), "param").where("clamped").groupBy("param").agg(F.count(F.lit(1)).alias("n"))


@query("p18_qa_status", "select o_custkey as k, case max(case o_orderstatus when 'F' then 2 when 'P' then 1 else 0 end) when 2 then 'fail' when 1 then 'warn' else 'pass' end as status from orders group by 1")
def p18(s, d):
    st = F.when(F.col("o_orderstatus") == "F", "fail").when(F.col("o_orderstatus") == "P", "warn").otherwise("pass")
    return P.qa_status(view(s, d, "orders").select(F.col("o_custkey").alias("k"), st.alias("st")), ["k"], "st")


@query("p19_golden_check", "with l as (select o_custkey as k, count(*) as n, sum(o_totalprice) as v from orders where o_orderkey % 7 <> 0 group by 1), g as (select o_custkey as k, count(*) as n, sum(o_totalprice) as v from orders group by 1) select k, coalesce(abs(l.n - g.n) <= 2, false) as count_ok, coalesce(abs(l.v - g.v) <= 0.05 * abs(g.v), false) as value_ok from l full join g using (k)")
def p19(s, d):
    fig = lambda o: o.groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("v"))
    o = view(s, d, "orders")
    return P.golden_check(fig(o.where("o_orderkey % 7 <> 0")), fig(o), ["k"], "n", "v")


@query("p20_rate_alerts", sql("select key, count(*) as n, round(avg((label = 'error')::int), 6) as rate from observations group by 1 having avg((label = 'error')::int) > 0.2", "observations"))
def p20(s, d):
    return P.rate_alerts(view(s, d, "observations"), ["key"], F.col("label") == "error", 0.2).withColumn("rate", F.round("rate", 6))


@query("p21_finalise_turns", "with t as (select event_id as k from events), a as (select event_id as k, user_id as who, value / 100 as c from events where event_id % 3 > 0), b as (select event_id as k, user_id + 1 as who, 0.8 as c from events where event_id % 5 = 0), j as (select t.k, a.who as w1, b.who as w2, coalesce(a.c < 0.5, true) and b.who is not null as esc, a.c as c1, b.c as c2 from t left join a using (k) left join b using (k)), p as (select *, case when esc then w2 else w1 end as who, case when esc then c2 else c1 end as c from j) select k, case when who <= 120 and c >= 0.5 then who end as who, case when w1 is null and w2 is null then 'undecided' when who <= 120 and c >= 0.5 then 'tiebreak' else 'unresolved_final' end as method from p")
def p21(s, d):
    e = view(s, d, "events")
    a = e.where("event_id % 3 > 0").selectExpr("event_id k", "user_id who", "value / 100 confidence")
    b = e.where("event_id % 5 = 0").selectExpr("event_id k", "user_id + 1 who", "cast(0.8 as double) confidence")
    return P.finalise_turns(e.selectExpr("event_id k"), a, b, "k", e.where("user_id <= 120").selectExpr("user_id who").unionByName(e.where("user_id <= 119").selectExpr("user_id + 1 who")).distinct())


@query("p22_completeness", "select c_custkey as k, case when exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P') then 'pending turns' when not exists (select 1 from orders where o_custkey = c_custkey) then 'no scenes' when c_acctbal < 0 then 'no synopsis' end as reason from customer")
def p22(s, d):
    c, o = view(s, d, "customer").withColumnRenamed("c_custkey", "k"), view(s, d, "orders").withColumnRenamed("o_custkey", "k")
    return P.completeness(c, "k", [("pending turns", o.where("o_orderstatus = 'P'")), ("no scenes", c.join(o, "k", "left_anti")), ("no synopsis", c.where("c_acctbal < 0"))])


REW = "rw as (select doc_id, (coalesce(quality * 10.0, 0) + coalesce(t, 0)) / (1 + (t is not null)::int) / 5 - 1 as score_reward, (quality * 2 - 1) * coalesce(t / 2 / 5, 0.6) as feedback_reward from (select doc_id, quality, case when doc_id % 3 > 0 then toxic * 5.0 end as t from labels))"


def rewards(s, d):
    rows = view(s, d, "labels").withColumn("q", F.col("quality") * 10.0).withColumn("t", F.when(F.col("doc_id") % 3 > 0, F.col("toxic") * 5.0)).withColumn("sentiment", F.col("quality") * 2 - 1).withColumn("rating", F.col("t") / 2)
    return P.reward_samples(rows, ["q", "t"], "sentiment", "rating")


@query("p23_reward_samples", f"with {REW} select doc_id, round(score_reward, 6) + 0.0 as score_reward, round(feedback_reward, 6) + 0.0 as feedback_reward from rw")
def p23(s, d):
    return rewards(s, d).select("doc_id", (F.round("score_reward", 6) + 0.0).alias("score_reward"), (F.round("feedback_reward", 6) + 0.0).alias("feedback_reward"))


@query("p24_reward_signals", f"with {REW} select source, lang, count(*) as n, round(sum(score_reward) / (count(*) + 3), 6) as score from rw join documents using (doc_id) group by 1, 2")
def p24(s, d):
    rows = rewards(s, d).join(view(s, d, "documents").select("doc_id", "source", "lang"), "doc_id")
    return P.shrunk_mean(rows, ["source", "lang"], "score_reward").withColumn("score", F.round("score", 6))


@query("p25_reward_alerts", f"with {REW} select source, n, score from (select source, count(*) as n, round(sum(feedback_reward) / (count(*) + 3), 6) as score from rw join documents using (doc_id) group by 1) where score < 0.5 and n >= 5")
def p25(s, d):
    rows = P.shrunk_mean(rewards(s, d).join(view(s, d, "documents").select("doc_id", "source"), "doc_id"), ["source"], "feedback_reward").withColumn("score", F.round("score", 6))
    return rows.where("score < 0.5 and n >= 5")


@query("p26_top_scenes", "select c_mktsegment, o_orderkey, score from (select c_mktsegment, o_orderkey, round((coalesce(o_totalprice, 0) + coalesce(c_acctbal, 0)) / 2, 4) as score, row_number() over (partition by c_mktsegment order by round((coalesce(o_totalprice, 0) + coalesce(c_acctbal, 0)) / 2, 4) desc, o_orderkey) as rn from orders join customer on c_custkey = o_custkey) where rn <= 10")
def p26(s, d):
    from pyspark.sql import Window

    rows = view(s, d, "orders").join(view(s, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).withColumn("score", F.round((F.coalesce("o_totalprice", F.lit(0.0)) + F.coalesce("c_acctbal", F.lit(0.0))) / 2, 4))
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("score"), "o_orderkey"))).where("rn <= 10").select("c_mktsegment", "o_orderkey", "score")


@query("p27_pacing_profile", "select l_suppkey as k, count(*) as n, round(avg(l_quantity), 6) as mean, quantile_cont(l_quantity, 0.5) as median, round(coalesce(var_samp(l_quantity), 0.0), 5) as variance, case when avg(l_quantity) < 2 then 'fast' when avg(l_quantity) < 5 then 'moderate' else 'slow' end as pace from lineitem group by 1")
def p27(s, d):
    rows = P.pacing_profile(view(s, d, "lineitem").withColumnRenamed("l_suppkey", "k"), "k", "l_quantity")
    return rows.withColumn("mean", F.round("mean", 6)).withColumn("variance", F.round("variance", 5))


@query("p28_param_profile", "select l_suppkey as k, param, count(*) as n, round(avg(v), 6) as mean, round(coalesce(var_samp(v), 0.0), 6) as variance from (select l_suppkey, unnest(['q', 'd']) as param, unnest([l_quantity, l_discount]) as v from lineitem) group by 1, 2")
def p28(s, d):
    m = F.create_map(F.lit("q"), F.col("l_quantity").cast("string"), F.lit("d"), F.col("l_discount").cast("string"), F.lit("flag"), F.col("l_returnflag"))
    rows = P.param_profile(view(s, d, "lineitem").select(F.col("l_suppkey").alias("k"), m.alias("m")), ["k"], "m")
    return rows.withColumn("mean", F.round("mean", 6)).withColumn("variance", F.round("variance", 6))


@query("p30_call_costs", "select event_type as model, user_id % 5 as stage, count(*) as n, round(sum((value * 100 * i + 50 * o) / 1e6), 6) as cost from events left join (values ('click', 2.0, 6.0), ('view', 0.5, 1.5)) p(m, i, o) on m = event_type group by rollup (1, 2)")
def p30(s, d):
    calls = view(s, d, "events").select(F.col("event_type").alias("model"), (F.col("user_id") % 5).alias("stage"), (F.col("value") * 100).alias("prompt"), F.lit(50).alias("completion"))
    prices = s.createDataFrame([("click", 2.0, 6.0), ("view", 0.5, 1.5)], "model string, in_price double, out_price double")
    return P.call_costs(calls, prices, "model", "prompt", "completion").rollup("model", "stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("cost"), 6).alias("cost"))


@query("p31_appearance_counts", "select c_custkey as k, count(o_orderkey) as n, count(*) filter (o_orderstatus = 'F') as n_f, count(*) filter (o_totalprice > 200000) as n_large from customer left join orders on o_custkey = c_custkey group by 1")
def p31(s, d):
    rows = view(s, d, "customer").join(view(s, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.groupBy(F.col("c_custkey").alias("k")).agg(F.count("o_orderkey").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("n_f"), F.count_if(F.col("o_totalprice") > 200000).alias("n_large"))


@query("p32_search", "select doc_id, source, lang from documents where text ilike '%licensed%' or source = 'src3'")
def p32(s, d):
    return view(s, d, "documents").where(F.col("text").ilike("%licensed%") | (F.col("source") == "src3")).select("doc_id", "source", "lang")


@query("p33_rollups", sql("select label, key, count(*) as rows_, round(sum(confidence), 4) as total from observations group by cube (label, key)", "observations"))
def p33(s, d):
    return view(s, d, "observations").cube("label", "key").agg(F.count(F.lit(1)).alias("rows_"), F.round(F.sum("confidence"), 4).alias("total"))


@query("p34_latency_summary", "select l_shipdate::date::varchar as day, count(*) as n, round(avg(l_quantity), 6) as mean, quantile_cont(l_quantity, 0.5) as median, round(quantile_cont(l_quantity, 0.95), 6) as p95, round(1000 * count(*) / sum(l_quantity), 6) as items_per_s from lineitem group by 1")
def p34(s, d):
    rows = view(s, d, "lineitem").withColumn("day", F.to_date("l_shipdate").cast("string")).withColumn("one", F.lit(1))
    out = P.latency_summary(rows, ["day"], "l_quantity", "one")
    return out.select("day", "n", F.round("mean", 6).alias("mean"), "median", F.round("p95", 6).alias("p95"), F.round("items_per_s", 6).alias("items_per_s"))


@query("p29_merge_profile", "select c_custkey as k, case when c_custkey % 2 = 0 then c_acctbal * 2 else c_acctbal end as pace, case when c_custkey % 3 = 0 then 'hand' when c_custkey % 2 = 0 then 'auto' end as style from customer")
def p29(s, d):
    from ..operators.maintain import upsert

    c = view(s, d, "customer")
    old = c.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("pace"), F.when(F.col("c_custkey") % 3 == 0, "hand").alias("style"))
    new = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") * 2).alias("pace"), F.lit("auto").alias("style"))
    return upsert(old, new, ["k"], keep=("style",))
