"""Queries for interval joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as I
from .registry import query
from .views import sql, view

V = ["video_id"]


def seg(s, d):
    return view(s, d, "segments")


def named(s, d):
    """Chunks with other names for their columns."""
    return view(s, d, "chunks").withColumnsRenamed({"start_s": "c_start", "end_s": "c_end"})


@query("j1_max_overlap_join", sql("select s.video_id, s.seg, chunk, overlap from segments s left join (select * from (select a.video_id, seg, chunk, round(least(a.end_s, c.end_s) - greatest(a.start_s, c.start_s), 9) as overlap, row_number() over (partition by a.video_id, seg order by round(least(a.end_s, c.end_s) - greatest(a.start_s, c.start_s), 9) desc, c.start_s) as rn from segments a join chunks c on a.video_id = c.video_id and a.start_s < c.end_s and a.end_s > c.start_s) where rn = 1) b on b.video_id = s.video_id and b.seg = s.seg", "chunks"))
def j1(s, d):
    return I.max_overlap_join(seg(s, d), named(s, d), V, "seg", "chunk", "start_s", "end_s", "c_start", "c_end", 30.0)


@query("j2_text_in_window", sql("select c.video_id, chunk, coalesce(string_agg(text, ' ' order by s.start_s, s.end_s, text), '') as body from chunks c left join segments s on s.video_id = c.video_id and c.start_s - 2 < s.end_s and c.end_s + 2 > s.start_s group by all", "chunks"))
def j2(s, d):
    return I.text_in_window(named(s, d), seg(s, d), V, "chunk", "c_start", "c_end", "start_s", "end_s", "text", 30.0, 2.0)


@query("j3_snippet", sql("with i as (select c.video_id, chunk, string_agg(text, ' ' order by s.start_s, text) as body from chunks c join segments s on s.video_id = c.video_id and s.start_s between c.start_s - 10 and c.start_s + 10 group by all), n as (select c.video_id, chunk, text, row_number() over (partition by c.video_id, chunk order by abs(s.start_s - c.start_s), s.start_s, text desc) as rn from chunks c join segments s using (video_id)) select video_id, chunk, coalesce(body, text) as body from n left join i using (video_id, chunk) where rn = 1", "chunks"))
def j3(s, d):
    return I.snippet(named(s, d), seg(s, d), V, "chunk", "c_start", "start_s", "text", 10.0)


@query("j4_excerpt", sql("select c.video_id, chunk, coalesce(substr(string_agg(text, ' ' order by s.start_s, s.end_s, text), 1, 300), '') as body from chunks c left join segments s on s.video_id = c.video_id and c.start_s - 0.25 <= s.end_s and c.end_s + 0.25 >= s.start_s group by all", "chunks"))
def j4(s, d):
    return I.text_in_window(named(s, d), seg(s, d), V, "chunk", "c_start", "c_end", "start_s", "end_s", "text", 30.0, 0.25, True, 300)


TOP = "p as (select t.key, turn_id, label, sec, confidence from turns t join observations o on o.key = t.key and sec between start_s and end_s), n as (select key, turn_id, label, count(*) as votes, min(sec) as seen from p group by all), top as (select key, turn_id, label, votes, row_number() over (partition by key, turn_id order by votes desc, seen, label) as rn, sum(votes) over (partition by key, turn_id) as total, count(*) over (partition by key, turn_id) as kinds from n)"
HALF = 10800.0


def obs(s, d):
    return view(s, d, "observations").select("key", "label", "sec", "confidence")


@query("j5_majority_in_interval", sql(f"with {TOP} select t.key, t.turn_id, label, round_even(votes / total, 3) as confidence, case when kinds is null then 'unresolved' when kinds = 1 then 'single_candidate' else 'face_majority' end as method from turns t left join top on top.turn_id = t.turn_id and rn = 1", "turns"))
def j5(s, d):
    return I.majority_in_interval(view(s, d, "turns"), obs(s, d), ["key"], "turn_id", "start_s", "end_s", "sec", "label", HALF)


@query("j6_presence", sql("select t.key, turn_id, label, count(*) filter (sec between start_s and end_s) as strict, count(*) as wide from turns t join observations o on o.key = t.key and sec between start_s - 3600 and end_s + 3600 group by all", "turns"))
def j6(s, d):
    return I.presence(view(s, d, "turns"), obs(s, d), ["key"], "turn_id", "start_s", "end_s", "sec", "label", HALF, 3600.0)


@query("j7_nested_in_interval", sql("with e as (select key, sec, unnest([label, lower(label) || ' ', 'other']) as person from observations), c as (select distinct upper(trim(label)) as person from observations) select t.key, turn_id, upper(trim(e.person)) as person, c.person is not null as known, count(*) as n from turns t join e on e.key = t.key and sec between start_s and end_s left join c on c.person = upper(trim(e.person)) group by all", "turns"))
def j7(s, d):
    nested = obs(s, d).withColumn("people", F.array(F.col("label"), F.concat(F.lower("label"), F.lit(" ")), F.lit("other")))
    rows = I.points_in(view(s, d, "turns"), nested, ["key"], "start_s", "end_s", "sec", HALF).select("key", "turn_id", F.explode("people").alias("raw"))
    cast = obs(s, d).select(F.upper(F.trim("label")).alias("person")).distinct().withColumn("yes", F.lit(True))
    rows = rows.select("key", "turn_id", F.upper(F.trim("raw")).alias("person")).join(cast, "person", "left")
    return rows.groupBy("key", "turn_id", "person", F.coalesce("yes", F.lit(False)).alias("known")).agg(F.count(F.lit(1)).alias("n"))


@query("j8_container_of", sql("with m as (select *, (start_s + end_s) / 2 as mid from segments), i as (select m.video_id, seg, arg_min(chunk, c.start_s) as chunk from m join chunks c on c.video_id = m.video_id and chunk % 2 = 0 and mid between c.start_s and c.end_s group by all), n as (select m.video_id, seg, chunk, row_number() over (partition by m.video_id, seg order by abs(c.start_s - mid), c.start_s) as rn from m left join (select * from chunks where chunk % 2 = 0) c using (video_id)) select n.video_id, n.seg, coalesce(i.chunk, n.chunk) as chunk from n left join i using (video_id, seg) where rn = 1", "chunks"))
def j8(s, d):
    return I.container_of(seg(s, d), named(s, d).where("chunk % 2 = 0"), V, "seg", "start_s", "end_s", "chunk", "c_start", "c_end", 30.0)


@query("j9_nearest_midpoint", sql("with k as (select video_id * 1000 + seg as cid, video_id, seg % 3 as scene, (start_s + end_s) / 2 as mk from segments), m as (select video_id, chunk, chunk % 3 as scene, (start_s + end_s) / 2 as ms from chunks), r as (select cid, chunk, row_number() over (partition by cid order by (k.scene = m.scene) desc, abs(mk - ms), ms) as rn from k join m using (video_id)) select cid, chunk from r where rn = 1", "chunks"))
def j9(s, d):
    clips = seg(s, d).withColumn("cid", F.col("video_id") * 1000 + F.col("seg")).withColumn("scene", F.col("seg") % 3)
    shots = named(s, d).withColumn("scene", (F.col("chunk") % 3).cast("bigint"))
    return I.nearest_midpoint(clips, shots, "cid", "scene", "start_s", "end_s", "chunk", "c_start", "c_end", "video_id")


@query("j10_nearest_by_time", sql("with a as (select key, frame, sec from observations where label = 'click'), b as (select key, frame as near_frame, sec as s2 from observations where label <> 'click'), r as (select a.key, frame, near_frame, row_number() over (partition by frame order by abs(sec - s2), s2) as rn from a left join b using (key)) select key, frame, near_frame from r where rn = 1", "observations"))
def j10(s, d):
    o = view(s, d, "observations").select("key", "label", "sec", "frame")
    right = o.where("label <> 'click'").select("key", F.col("sec").alias("s2"), F.col("frame").alias("near_frame"))
    return I.nearest_by_time(o.where("label = 'click'").select("key", "frame", "sec"), right, ["key"], "sec", "s2", ["near_frame"]).select("key", "frame", "near_frame")


SMALL = "t as (select key, turn_id, start_s, start_s + 3600 as end_s from turns)"


@query("j11_interval_signal", sql(f"with {SMALL}, {TOP.replace('turns t join', 't join')}, n2 as (select t.key, turn_id, label, row_number() over (partition by turn_id order by abs(sec - (start_s + end_s) / 2), sec) as rn from t join observations o using (key)) select t.key, t.turn_id, coalesce(top.label, n2.label) as label from t left join top on top.turn_id = t.turn_id and top.rn = 1 left join n2 on n2.turn_id = t.turn_id and n2.rn = 1", "turns"))
def j11(s, d):
    t = view(s, d, "turns").withColumn("end_s", F.col("start_s") + 3600)
    top = I.stable_majority(I.points_in(t, obs(s, d), ["key"], "start_s", "end_s", "sec", HALF), ["key", "turn_id"], "label", "sec").select("key", "turn_id", F.col("label").alias("inside"))
    near = I.nearest_by_time(t.withColumn("mid", (F.col("start_s") + F.col("end_s")) / 2), obs(s, d), ["key"], "mid", "sec", ["label"]).select("key", "turn_id", F.col("label").alias("near"))
    return near.join(top, ["key", "turn_id"], "left").select("key", "turn_id", F.coalesce("inside", "near").alias("label"))


@query("j12_entities_in_interval", sql("with days as (select distinct 0 as k, floor(sec / 86400)::bigint as day from observations), p as (select day, key as entity, label, sec, confidence from days join observations on sec between day * 86400 and (day + 1) * 86400), n as (select day, entity, label, count(*) as v, min(sec) as seen from p group by all), top as (select *, row_number() over (partition by day, entity order by v desc, seen, label) as rn from n), a as (select day, entity, count(*) as n, round(avg(confidence), 8) as mean from p group by all) select a.day, a.entity, a.n, a.mean, label from a join top on top.day = a.day and top.entity = a.entity and rn = 1", "observations"))
def j12(s, d):
    o = view(s, d, "observations").select(F.lit(0).alias("k"), F.col("key").alias("entity"), "label", "sec", "confidence")
    days = o.select("k", F.floor(F.col("sec") / 86400).alias("day")).distinct().withColumn("a", F.col("day") * 86400.0).withColumn("b", (F.col("day") + 1) * 86400.0)
    return I.entities_in_interval(days, o, ["k"], "day", "a", "b", "sec", "entity", "label", "confidence", 86400.0).select("day", "entity", "n", F.round("mean", 8).alias("mean"), "label")


GAPS = "g as (select key, sec + 60 as gap_a, lead(sec) over (partition by key order by sec, sec + 60) as gap_b from observations), gaps as (select * from g where gap_b > gap_a)"


@query("j13_snap_boundaries", sql(f"with {GAPS}, r as (select t.key, turn_id, start_s, (greatest(gap_a, start_s - 1800) + least(gap_b, start_s + 1800)) / 2 as snapped, row_number() over (partition by turn_id order by round(least(gap_b, start_s + 1800) - greatest(gap_a, start_s - 1800), 6) desc, gap_a) as rn from turns t join gaps g on g.key = t.key and start_s - 1800 < gap_b and start_s + 1800 > gap_a) select t.key, t.turn_id, t.start_s, round(coalesce(snapped, t.start_s), 5) as snapped from turns t left join r on r.turn_id = t.turn_id and rn = 1", "turns"))
def j13(s, d):
    words = obs(s, d).select("key", "sec", (F.col("sec") + 60).alias("e"))
    out = I.snap_boundaries(view(s, d, "turns").select("key", "turn_id", "start_s"), I.silences(words, ["key"], "sec", "e"), ["key"], "turn_id", "start_s", 1800.0, HALF)
    return out.withColumn("snapped", F.round("snapped", 5))


ISLANDS = "ev as (select key, sec as a, sec + 3600 as b from observations), f as (select *, max(b) over (partition by key order by a, b rows between unbounded preceding and 1 preceding) as far from ev), il as (select *, sum((far is null or a > far + 600)::int) over (partition by key order by a, b rows unbounded preceding) as island from f), merged as (select key, min(a) as a, max(b) as b from il group by key, island)"


def hours(s, d):
    return obs(s, d).select("key", F.col("sec").alias("a"), (F.col("sec") + 3600).alias("b"))


@query("j14_merge_intervals", sql(f"with {ISLANDS} select key, round(a, 4) as a, round(b, 4) as b from merged", "observations"))
def j14(s, d):
    return I.merge_intervals(hours(s, d), ["key"], "a", "b", 600.0).select("key", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


@query("j15_uncovered", sql(f"with {ISLANDS}, tt as (select key, start_s as a, end_s as b from turns), tf as (select *, max(b) over (partition by key order by a, b rows between unbounded preceding and 1 preceding) as far from tt), ti as (select *, sum((far is null or a > far + 600)::int) over (partition by key order by a, b rows unbounded preceding) as island from tf), t as (select key, min(a) as a, max(b) as b from ti group by key, island), m as (select t.key, t.a, t.b, c.a as ca, c.b as cb from t join merged c on c.key = t.key and t.a < c.b and t.b > c.a union all select key, a, b, b, b from t), g as (select key, coalesce(max(cb) over (partition by key, a, b order by ca, cb rows between unbounded preceding and 1 preceding), a) as ga, ca as gb from m) select key, round(ga, 4) as a, round(gb, 4) as b from g where gb - ga > 600", "turns"))
def j15(s, d):
    t = view(s, d, "turns").select("key", F.col("start_s").alias("a"), F.col("end_s").alias("b"))
    return I.uncovered(t, hours(s, d), ["key"], "a", "b", 43200.0, 600.0).select("key", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


@query("j16_frames_with_time", sql("select f.video_id, f.frame_index, s.shot_index, round(f.frame_index / fps, 4) as at_s from frames f join shots s on s.video_id = f.video_id and s.shot_index = f.shot_index", "shots"))
def j16(s, d):
    return I.with_parent(view(s, d, "frames"), view(s, d, "shots").select("video_id", "shot_index", "fps"), ["video_id", "shot_index"]).select("video_id", "frame_index", "shot_index", F.round(F.col("frame_index") / F.col("fps"), 4).alias("at_s"))


@query("j17_children_of", "select l_orderkey, l_linenumber, l_partkey, o_orderstatus from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus = 'F'")
def j17(s, d):
    kids = view(s, d, "lineitem").withColumn("o_orderkey", F.col("l_orderkey"))
    return I.with_parent(kids, view(s, d, "orders"), "o_orderkey", F.col("o_orderstatus") == "F").select("l_orderkey", "l_linenumber", "l_partkey", "o_orderstatus")


@query("j18_with_names", "select c_custkey, n_name from customer left join nation on c_nationkey = n_nationkey and n_regionkey <> 2")
def j18(s, d):
    names = view(s, d, "nation").where("n_regionkey <> 2")
    return view(s, d, "customer").join(names, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")


