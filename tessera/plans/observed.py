"""Queries for observations and spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spans as S
from .registry import query
from .views import sql, view


def obs(s, d):
    return view(s, d, "observations").drop("ts")


HISTS = "h as (select user_id as key, event_id as i, [value, value * (event_id % 3), length(event_type)::double, (event_id % 7)::double] as hist from {events}), l as (select *, lag(hist) over (partition by key order by i) as p from h), c as (select key, i, list_sum(hist) as sa, list_sum(p) as sb, list_dot_product(hist, p) as ab, list_dot_product(hist, hist) as aa, list_dot_product(p, p) as bb from l where p is not null), sc as (select key, i, 1 - coalesce((ab - sa * sb / 4) / nullif(sqrt(greatest((aa - sa * sa / 4) * (bb - sb * sb / 4), 0)), 0), 0.0) as score from c)"
HIST = HISTS.format(events="events")


def hists(s, d):
    e = view(s, d, "events")
    h = F.array(F.col("value"), F.col("value") * (F.col("event_id") % 3), F.length("event_type").cast("double"), (F.col("event_id") % 7).cast("double"))
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("i"), h.alias("hist"))


@query("o1_histogram_cuts", f"with {HIST} select key, i, round(score, 5) as score from sc where score >= 0.35")
def o1(s, d):
    return S.histogram_cuts(hists(s, d), "key", "i", "hist").withColumn("score", F.round("score", 5))


#: Cuts in order; ``at`` is the last one that was kept.
GAP = f"""
with recursive {HIST}, cut as (select key, i, score, row_number() over (partition by key order by i) as no from sc where score >= 0.35),
g as (
  select key, 0::bigint as no, null::bigint as at, false as kept from (select distinct key from cut)
  union all
  select c.key, c.no, case when g.at is null or c.i - g.at >= 500 then c.i else g.at end, g.at is null or c.i - g.at >= 500
  from g join cut c on c.key = g.key and c.no = g.no + 1
)
select key, i, round(score, 5) as score from cut join (select key, no from g where kept) using (key, no)
"""


@query("o1_histogram_cuts_with_gap", GAP.strip())
def o1_gap(s, d):
    return S.histogram_cuts(hists(s, d), "key", "i", "hist", 0.35, 500).withColumn("score", F.round("score", 5))


@query("o2_adaptive_threshold", sql("with w as (select key, frame, confidence, list_sort(list(confidence) over (partition by key order by frame rows between 47 preceding and current row)) as held from observations) select key, frame, round(case when len(held) >= 12 then greatest(0.35, 3 * (held[(len(held) - 1) // 2 + 1] + held[len(held) // 2 + 1]) / 2 + 0.08) else 0.35 end, 5) as lim from w", "observations"))
def o2(s, d):
    return S.adaptive_threshold(obs(s, d), "key", "frame", "confidence").select("key", "frame", F.round("limit", 5).alias("lim"))


@query("o3_stride_sample", sql("with i as (select key, frame, row_number() over w - 1 as i, label = 'error' as cut from observations window w as (partition by key order by frame)), a as (select *, max(case when cut then i end) over (partition by key order by frame) as anchor from i) select key, frame from a where (anchor is not null and i - anchor < 3) or (i - coalesce(anchor, 0)) % 4 = 0", "observations"))
def o3(s, d):
    return S.stride_sample(obs(s, d).withColumn("cut", F.col("label") == "error"), "key", "frame", "cut", 4, 3).select("key", "frame")


GATE = "g as (select l_orderkey as k, l_linenumber as i, l_partkey as t, l_quantity as size, 1 - l_discount as confidence, l_tax * 10 as yaw, l_extendedprice as sharp from lineitem), q as (select *, list_filter([case when size < 10 then 'small' end, case when confidence < 0.92 then 'unsure' end, case when yaw > 0.6 then 'turned' end, case when sharp < 2000 then 'blurred' end], lambda x: x is not null) as reasons, least(1.0, greatest(0.0, size / 20.0)) * confidence * (1 - least(1.0, greatest(0.0, yaw / 1.2))) * least(1.0, greatest(0.0, sharp / 4000.0)) as score from g)"


def gate(s, d):
    rows = view(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), F.col("l_partkey").alias("t"), F.col("l_quantity").alias("size"), (1 - F.col("l_discount")).alias("confidence"), (F.col("l_tax") * 10).alias("yaw"), F.col("l_extendedprice").alias("sharp"))
    return S.quality_gate(rows, 10.0, 0.92, 0.6, 2000.0)


@query("o4_quality_gate", f"with {GATE} select k, i, t, array_to_string(reasons, ',') as reasons, len(reasons) = 0 as passed, round(score, 12) as score from q")
def o4(s, d):
    return gate(s, d).select("k", "i", "t", F.array_join("reasons", ",").alias("reasons"), "passed", F.round("gate_score", 12).alias("score"))


@query("o5_rank_detections", f"with {GATE} select k, i, t from (select *, row_number() over (partition by k order by round(score, 9) desc, i, t) as rn from q) where rn = 1")
def o5(s, d):
    return S.best_per_group(gate(s, d).withColumn("gate_score", F.round("gate_score", 9)), ["k"], F.desc("gate_score"), "i", "t").select("k", "i", "t")


@query("o6_salvage_best", f"with {GATE} select k, i, t from (select *, max((len(reasons) = 0)::int) over (partition by k) as passing, row_number() over (partition by k order by round(score, 9) desc, t) as rn from q) where len(reasons) = 0 or (passing = 0 and rn <= 3)")
def o6(s, d):
    return S.salvage_best(gate(s, d).withColumn("gate_score", F.round("gate_score", 9)), ["k"], "passed", "gate_score", "t").select("k", "i", "t")


#: The label with most votes of a list {v}, the first of several: a struct (n, f, l).
MOST = "list_sort(list_transform(list_distinct({v}), lambda nm: {{'n': len(list_filter({v}, lambda z: z = nm)), 'f': -list_position({v}, nm), 'l': nm}}))[-1]"

VOTES = f"""
w as (
  select key, frame, confidence,
         list(label) over (partition by key order by frame rows between 4 preceding and current row) as names,
         list(confidence) over (partition by key order by frame rows between 4 preceding and current row) as vals
  from observations
),
b as (select *, {MOST.format(v='names')} as best from w),
f as (
  select *, last_value(case when best.n >= least(3, len(names)) then best.l end ignore nulls)
            over (partition by key order by frame rows between unbounded preceding and current row) as voted
  from b
)
select key, frame, voted,
       round(coalesce(list_avg(list_transform(list_filter(list_zip(names, vals), lambda z: z[1] = voted), lambda z: z[2])), confidence), 8) as vote_mean
from f
"""


@query("o7_identity_vote", sql(f"with {VOTES}", "observations"))
def o7(s, d):
    return S.identity_vote(obs(s, d), "key", "frame", "label", "confidence").select("key", "frame", "voted", F.round("vote_mean", 8).alias("vote_mean"))


LABELS = ["click", "error", "purchase", "signup", "view"]


def smoothing(mode: str, silence: float | None = None, source: str = "observations") -> str:
    """Row by row within each key: ``held`` trusted labels, ``ema`` by label, ``cur`` the label that holds. After more than
    ``silence`` seconds a key begins anew."""
    new = {
        "majority": "maj",
        "ema": "case when cur is null or list_max(nema) >= 0.4 then top else cur end",
        "hybrid": "case when confidence >= 0.55 and top = label then label else maj end",
    }[mode]
    anew = f"o.sec - o.before > {silence}" if silence else "false"
    return f"""
with recursive o as (
  select key, frame, sec, label, confidence, row_number() over w as i, lag(sec) over w as before
  from {source} window w as (partition by key order by frame)
),
s as (
  select key, 0::bigint as i, 0::bigint as frame, []::varchar[] as held, null::double[] as ema, null::varchar as cur, null::varchar as smoothed
  from (select distinct key from {source})
  union all
  select key, i, frame, nheld, nema, {new} as ncur, coalesce({new}, label) from (
    select *, {LABELS}[list_position(nema, list_max(nema))] as top,
           case when len(nheld) = 0 then cur
                when best.n >= case when cur is null then least(4, len(nheld)) else greatest(4, 1 + len(list_filter(nheld, lambda z: z = cur))) end then best.l
                else cur end as maj
    from (
      select *, case when len(nheld) > 0 then {MOST.format(v='nheld')} end as best from (
        select o.key, o.i, o.frame, o.label, o.confidence,
               case when {anew} then null else s.cur end as cur,
               case when o.confidence >= 0.4 then list_append(case when {anew} then []::varchar[] else s.held end, o.label)[-7:]
                    when {anew} then []::varchar[] else s.held end as nheld,
               case when s.ema is null or {anew} then list_transform({LABELS}, lambda z: case when z = o.label then o.confidence else 0.0 end)
                    else list_transform(list_zip({LABELS}, s.ema), lambda z: 0.45 * (case when z[1] = o.label then o.confidence else 0.0 end) + (1 - 0.45::double) * z[2]) end as nema
        from s join o on o.key = s.key and o.i = s.i + 1
      )
    )
  )
)
select key, frame, smoothed from s where i > 0
"""


for _n, _mode in ((8, "majority"), (9, "ema"), (10, "hybrid")):

    def _smooth(s, d, mode=_mode):
        return S.smooth(obs(s, d), "key", "frame", "label", "confidence", mode, LABELS).select("key", "frame", "smoothed")

    query(f"o{_n}_smooth_{_mode}", sql(smoothing(_mode).strip(), "observations"))(_smooth)


ISL = "l as (select *, lag(label) over w as p, lag(sec) over w as ps from observations window w as (partition by key order by sec, label)), f as (select *, coalesce(sec - ps > {gap}, false) as late from l), i as (select *, sum((p is null or p <> label or late)::int) over (partition by key order by sec, label rows unbounded preceding) as island from f), s as (select key, island, min(sec) as start_s, max(sec) as last_s, any_value(label) as label, count(*) as n, avg(confidence) as confidence, bool_or(late) as late from i group by key, island), spans as (select key, label, start_s, case when lead(late) over o or lead(start_s) over o is null then last_s else lead(start_s) over o end as end_s, n, confidence from s window o as (partition by key order by island))"
OUT = "select key, label, start_s, end_s, n, round(confidence, 8) as confidence from spans"


def spans(s, d, gap=None):
    return S.spans(obs(s, d), "key", "sec", "label", "confidence", gap)


@query("o11_spans", sql(f"with {ISL.format(gap='1e18')} {OUT}", "observations"))
def o11(s, d):
    return spans(s, d).withColumn("confidence", F.round("confidence", 8))


@query("o12_spans_with_gap", sql(f"with {ISL.format(gap='21600')} {OUT}", "observations"))
def o12(s, d):
    return spans(s, d, 21600.0).withColumn("confidence", F.round("confidence", 8))


#: Spans in order; ``no`` counts those that came out so far, of which the last one may still grow.
MERGED = f"""
with recursive {ISL.format(gap='21600')},
q as (select *, confidence * 0.5 as similarity, [key % 7, n] as tracks, row_number() over (partition by key order by start_s, end_s) as i from spans),
m as (
  select key, 0::bigint as i, 0::bigint as no, null::varchar as label, null::double as start_s, null::double as end_s, 0::bigint as n, 0::double as confidence,
         0::double as similarity, []::bigint[] as tracks
  from (select distinct key from spans)
  union all
  select key, i, no + (act = 'new')::bigint,
         case when act = 'new' then l2 else label end, case when act = 'new' then s2 else start_s end,
         case when act = 'new' then e2 when act = 'drop' then end_s else greatest(end_s, e2) end,
         case act when 'new' then n2 when 'join' then n + n2 else n end,
         case act when 'new' then c2 when 'join' then (confidence * n + c2 * n2) / (n + n2) else confidence end,
         case act when 'new' then m2 when 'join' then (similarity * n + m2 * n2) / (n + n2) else similarity end,
         case act when 'new' then t2 when 'join' then list_sort(list_distinct(list_concat(tracks, t2))) else tracks end
  from (
    select m.key, q.i, m.no, m.label, m.start_s, m.end_s, m.n, m.confidence, m.similarity, m.tracks, q.similarity as m2, list_sort(list_distinct(q.tracks)) as t2, q.label as l2, q.start_s as s2, q.end_s as e2, q.n as n2, q.confidence as c2,
           case when m.no > 0 and m.label = q.label and q.start_s - m.end_s <= 3600 then 'join'
                when m.no > 0 and q.end_s - q.start_s < 1800 then 'absorb'
                when m.no > 0 or q.end_s - q.start_s >= 1800 or q.n > 1 then 'new' else 'drop' end as act
    from m join q on q.key = m.key and q.i = m.i + 1
  )
),
last_of as (select *, row_number() over (partition by key, no order by i desc) as rn from m where no > 0)
select key, label, start_s, end_s, n, round(confidence, 6) as confidence, round(similarity, 6) as similarity, array_to_string(tracks, '|') as tracks from last_of where rn = 1
"""


@query("o13_merge_spans", sql(MERGED.strip(), "observations"))
def o13(s, d):
    rows = spans(s, d, 21600.0).withColumn("similarity", F.col("confidence") * 0.5).withColumn("tracks", F.array_sort(F.array_distinct(F.array(F.col("key") % 7, F.col("n")))))
    out = S.merge_spans(rows, "key", 3600.0, 1800.0).withColumn("tracks", F.array_join(F.transform("tracks", lambda t: t.cast("string")), "|"))
    return out.withColumn("confidence", F.round("confidence", 6)).withColumn("similarity", F.round("similarity", 6))


@query("o14_entity_summary", sql(f"with {ISL.format(gap='21600')} select key, min(start_s) as first_seen, max(end_s) as last_seen, round(sum(end_s - start_s), 3) as total_s, count(*) as spans, sum(change)::bigint as changes from (select *, coalesce((lag(label) over (partition by key order by start_s, end_s) <> label)::int, 0) as change from spans) group by key", "observations"))
def o14(s, d):
    return S.entity_summary(spans(s, d, 21600.0), "key").withColumn("total_s", F.round("total_s", 3))


@query("o15_label_totals", sql(f"with {ISL.format(gap='21600')} select label, round(sum(end_s - start_s), 3) as seconds, count(*) as spans from spans group by label", "observations"))
def o15(s, d):
    return S.label_totals(spans(s, d, 21600.0), ["label"]).withColumn("seconds", F.round("seconds", 3))


@query("o15_active_at", sql(f"with {ISL.format(gap='21600')} select key, label, start_s from spans where start_s <= 1704800000 and end_s >= 1704800000", "observations"))
def o15b(s, d):
    return S.active_at(spans(s, d, 21600.0), 1704800000.0).select("key", "label", "start_s")


@query("o16_assign_pids", sql("with e as (select label as video, key as entity, min(sec) as seen from observations group by all) select video, entity, case when entity % 4 <> 0 then 'P' else 'PU' end || row_number() over (partition by video, entity % 4 <> 0 order by seen, entity) as pid from e", "observations"))
def o16(s, d):
    e = obs(s, d).groupBy(F.col("label").alias("video"), F.col("key").alias("entity")).agg(F.min("sec").alias("seen"))
    return S.assign_pids(e, "video", "entity", "seen", F.col("entity") % 4 != 0).select("video", "entity", "pid")


@query("o17_sample_points", sql("with r as (select video_id, min(start_s) as a, max(end_s) as b from segments group by 1), g as (select video_id, unnest(range(ceil(a)::bigint, floor(b)::bigint + 1))::double as \"at\", false as forced from r union all select video_id, start_s, true from segments) select video_id, \"at\", bool_or(forced) as forced from g group by all", "segments"))
def o17(s, d):
    seg = view(s, d, "segments")
    return S.sample_points(seg.groupBy("video_id").agg(F.min("start_s").alias("a"), F.max("end_s").alias("b")), "video_id", "a", "b", seg.select("video_id", F.col("start_s").alias("at")))


def changes(forced: str, columns: str, source: str = "observations") -> str:
    """Rows in order; ``last`` and ``sent`` are those of the row that went out last."""
    return f"""
with recursive o as (select *, row_number() over (partition by key order by sec, frame) as i from {source}),
c as (
  select key, 0::bigint as i, null::bigint as frame, null::varchar as last, null::double as sent, false as out from (select distinct key from {source})
  union all
  select key, i, frame, case when out then label else last end, case when out then sec else sent end, out from (
    select o.key, o.i, o.frame, o.label, o.sec, c.last, c.sent, {forced} or c.last is null or o.label <> c.last or o.sec - c.sent > 43200 as out
    from c join o on o.key = c.key and o.i = c.i + 1
  )
)
select {columns} from o join (select key, i from c where out) using (key, i)
"""


@query("o18_sample_changes", sql(changes("o.frame % 50 = 0", "key, frame, label, sec").strip(), "observations"))
def o18(s, d):
    return _o18(s, d).select("key", "frame", "label", "sec")


def _o18(s, d):
    return S.emit_changes(obs(s, d).withColumn("forced", F.col("frame") % 50 == 0), "key", "sec", "label", "forced", 43200.0)


@query("o19_entity_key", sql("select frame, coalesce((case when key % 3 > 0 then key end)::varchar, 'track:' || key) as entity from observations", "observations"))
def o19(s, d):
    return S.entity_key(obs(s, d).withColumn("known", F.when(F.col("key") % 3 > 0, F.col("key"))), "known", "key").select("frame", "entity")


#: ``names`` and ``vals`` are the last votes, one for each look.
DUE = f"""
with recursive o as (
  select key, confidence, case label when 'error' then 'unknown' else label end as label, row_number() over (partition by key order by frame) as i
  from observations
),
v as (
  select key, 0::bigint as i, []::varchar[] as names, []::double[] as vals, null::varchar as who, 0::double as mean, 0::bigint as since, false as due
  from (select distinct key from observations)
  union all
  select key, i, names, vals, now,
         case when due then coalesce(list_sum(list_transform(list_filter(list_zip(names, vals), lambda z: z[1] = now), lambda z: z[2])) / len(list_filter(names, lambda z: z = now)), confidence) else mean end,
         case when due then 0 else since end, due
  from (
    select *, case when due and best.n >= least(3, len(names)) then best.l else who end as now from (
      select *, case when len(names) > 0 then {MOST.format(v='names')} end as best from (
        select key, i, confidence, who, mean, since, due, case when due then list_append(names, label)[-5:] else names end as names,
               case when due then list_append(vals, confidence)[-5:] else vals end as vals
        from (
          select o.key, o.i, o.label, o.confidence, v.names, v.vals, v.who, v.mean, v.since + 1 as since,
                 v.who is null or v.since + 1 >= 10 or (v.who <> 'unknown' and round(v.mean, 9) < 0.38) as due
          from v join o on o.key = v.key and o.i = v.i + 1
        )
      )
    )
  )
)
select key, count(*) filter (due) as calls, count(*) as n from v where i > 0 group by key
"""


@query("o20_reid_due", sql(DUE.strip(), "observations"))
def o20(s, d):
    o = obs(s, d).withColumn("label", F.when(F.col("label") == "error", "unknown").otherwise(F.col("label")))
    return S.reid_due(o, "key", "frame", "label", "confidence", 10).groupBy("key").agg(F.count_if("due").alias("calls"), F.count(F.lit(1)).alias("n"))


@query("o21_suppress_overlaps")
def o21(s, d):
    b = view(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), F.col("l_quantity").alias("x1"), (F.col("l_discount") * 100).alias("y1"), (F.col("l_quantity") + 20).alias("x2"), (F.col("l_discount") * 100 + 20).alias("y2"), F.col("l_extendedprice").alias("score"))
    return S.suppress_overlaps(b, ["k"], "score", "i")


@query("o22_top_labels", "with e as (select event_id, unnest(['a', 'b', 'c', 'd']) as label, unnest([value / 50, (event_id % 5)::double, user_id / 40.0, 1.0]) as x, unnest([1, 2, 3, 4]) as i from events), p as (select event_id, label, i, x, exp(x - top) / sum(exp(x - top)) over (partition by event_id) as p from (select *, max(x) over (partition by event_id) as top from e)) select event_id, label, round(p, 5) as p, row_number() over (partition by event_id order by x desc, i) as rank from p qualify rank <= 3")
def o22(s, d):
    e = view(s, d, "events").select("event_id", F.array(F.col("value") / 50, (F.col("event_id") % 5).cast("double"), F.col("user_id") / 40.0, F.lit(1.0)).alias("x"))
    return S.top_labels(e, ["event_id"], "x", ["a", "b", "c", "d"]).withColumn("p", F.round("p", 5))
