"""Queries for scenes and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import scenes as N
from .registry import query
from .views import sql, view

GRP = "g as (select *, sum((first_ or flag)::int) over (partition by key order by frame rows unbounded preceding)::bigint - 1 as group_id from (select *, row_number() over (partition by key order by frame) = 1 as first_, label = 'error' as flag from observations))"


def groups(s, d):
    return N.group_by_flag(view(s, d, "observations").drop("ts"), ["key"], "frame", F.col("label") == "error")


@query("n1_group_by_flag", sql(f"with {GRP} select key, frame, group_id from g", "observations"))
def n1(s, d):
    return groups(s, d).select("key", "frame", "group_id")


@query("n2_canonical_id", sql(f"with {GRP}, n as (select key, group_id, label, count(*) as v, min(sec) as seen from g where label <> 'view' group by all), t as (select *, row_number() over (partition by key, group_id order by v desc, seen, label) as rn from n), s as (select key, group_id, min(sec) as a from g group by all) select s.key, s.group_id, coalesce(max(label) filter (rn = 1), 'scene_at_' || any_value(floor(a)::bigint) || 's') as canonical, coalesce(string_agg(label, ',' order by seen, label) filter (rn > 1), '') as aliases from s left join t using (key, group_id) group by all", "observations"))
def n2(s, d):
    rows = groups(s, d).withColumn("label", F.when(F.col("label") != "view", F.col("label")))
    return N.canonical_id(rows, ["key", "group_id"], "label", "sec").withColumn("aliases", F.array_join("aliases", ","))


@query("n3_snap_groups", sql(f"with {GRP}, x as (select key, group_id, min(sec) as a, max(sec) as b from g group by all), e as (select key, min(sec) - 100 as lo, max(sec) + 100 as hi from observations group by 1) select key, group_id, round(coalesce((lag(b) over w + a) / 2, least(lo, a)), 4) as start_s, round(coalesce((b + lead(a) over w) / 2, greatest(hi, b)), 4) as end_s from x join e using (key) window w as (partition by key order by a, b)", "observations"))
def n3(s, d):
    x = groups(s, d).groupBy("key", "group_id").agg(F.min("sec").alias("start_s"), F.max("sec").alias("end_s"))
    e = view(s, d, "observations").groupBy("key").agg((F.min("sec") - 100).alias("lo"), (F.max("sec") + 100).alias("hi"))
    return N.snap_groups(x, e, "key").select("key", "group_id", F.round("start_s", 4).alias("start_s"), F.round("end_s", 4).alias("end_s"))


@query("n4_balanced_batches", sql("with i as (select video_id, seg, count(*) over (partition by video_id) as n, row_number() over (partition by video_id order by seg) - 1 as i from segments), k as (select *, case when n <= 5 then 1 else greatest(1, round_even(n / 4.0, 0))::int end as k from i) select video_id, seg, (case when i < (n % k) * (n // k + 1) then i // (n // k + 1) else n % k + (i - (n % k) * (n // k + 1)) // (n // k) end)::int as batch from k", "segments"))
def n4(s, d):
    return N.balanced_batches(view(s, d, "segments"), ["video_id"], "seg").select("video_id", "seg", "batch")


@query("n5_disambiguate", sql("select video_id, seg, case when row_number() over (partition by video_id, speaker order by start_s) > 1 then speaker || '__at_' || floor(start_s)::bigint || 's' else speaker end as speaker from segments", "segments"))
def n5(s, d):
    return N.disambiguate(view(s, d, "segments"), ["video_id"], "speaker", "start_s").select("video_id", "seg", "speaker")


@query("n6_fallback_summary", sql("with f as (select video_id, text, min(seg) as seen from segments group by all), b as (select video_id, string_agg(text, ' ' order by seen, text) as body from f group by 1) select video_id, case when length(body) > 800 then substr(body, 1, 800) || '...' else body end as summary from b", "segments"))
def n6(s, d):
    return N.fallback_summary(view(s, d, "segments"), ["video_id"], "text", "seg")


@query("n7_resolve_participants", "with p as (select c_custkey, case c_custkey % 4 when 0 then n_name when 1 then lower(n_name) when 2 then n_name || ' (guest)' else 'nobody' end as name from customer join nation on n_nationkey = c_nationkey) select c_custkey, name, coalesce((select n_name from nation where n_name = name and n_regionkey < 4), (select n_name from nation where n_name = trim(split_part(name, '(', 1)) and n_regionkey < 4), (select n_name from nation where lower(n_name) = lower(trim(name)) and n_regionkey < 4)) as member from p")
def n7(s, d):
    k = F.col("c_custkey") % 4
    rows = view(s, d, "customer").join(view(s, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    rows = rows.select("c_custkey", F.when(k == 0, F.col("n_name")).when(k == 1, F.lower("n_name")).when(k == 2, F.concat("n_name", F.lit(" (guest)"))).otherwise("nobody").alias("name"))
    return N.resolve_participants(rows, view(s, d, "nation").where("n_regionkey < 4").select(F.col("n_name").alias("member")), "name")


GRADE = "gr as (select l_orderkey as k, l_linenumber as i, l_partkey as t, case when l_linenumber % 3 > 0 then least(1.0, greatest(0.0, l_quantity / 5 / 8)) end as a, case l_returnflag when 'A' then 0.3 when 'N' then 0.6 when 'R' then 1.0 end as b, case when l_linenumber % 2 = 0 then (l_linestatus = 'F')::int::double end as c from lineitem), gq as (select k, i, t, (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / ((a is not null)::int + (b is not null)::int + (c is not null)::int) as quality from gr)"


def graded(s, d):
    level = F.when(F.col("l_returnflag") == "A", "low").when(F.col("l_returnflag") == "N", "med").otherwise("high")
    rows = view(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), F.col("l_partkey").alias("t"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_quantity") / 5).alias("stops"), level.alias("level"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linestatus") == "F").alias("flag"))
    return N.grade_quality(rows, "stops", "level", ["flag"])


@query("n8_grade_quality", f"with {GRADE} select k, i, t, round(quality, 6) as quality from gq")
def n8(s, d):
    return graded(s, d).select("k", "i", "t", F.round("quality", 6).alias("quality"))


@query("n9_usability", sql("with q as (select key, turn_id, avg(confidence) as q from turns t join observations o using (key) where sec between start_s and end_s and frame % 3 = 0 group by all), c as (select key, turn_id, avg((frame % 10) / 10.0) as c from turns t join observations o using (key) where sec between start_s and end_s and frame % 2 = 0 group by all) select t.key, t.turn_id, round(0.6 * coalesce(q, 0.5) + 0.4 * coalesce(c, 0.5), 6) as usability from turns t left join q using (key, turn_id) left join c using (key, turn_id)", "turns", "observations"))
def n9(s, d):
    o = view(s, d, "observations").withColumn("at_u", F.col("sec"))
    grades = o.where("frame % 3 = 0").select("key", "at_u", F.col("confidence").alias("quality"))
    segs = o.where("frame % 2 = 0").select("key", "at_u", ((F.col("frame") % 10) / 10.0).alias("confidence"))
    return N.usability(view(s, d, "turns"), grades, segs, ["key"], "turn_id", 10800.0).withColumn("usability", F.round("usability", 6))


@query("n10_segment_confidence", "select conv_id, turn, round(avg(length(w) / 20.0), 6) as confidence from (select conv_id, turn, unnest(string_split(text, ' ')) as w from conversations) group by 1, 2")
def n10(s, d):
    words = view(s, d, "conversations").select("conv_id", "turn", F.explode(F.split("text", " ")).alias("w"))
    return words.groupBy("conv_id", "turn").agg(F.round(F.avg(F.length("w") / 20.0), 6).alias("confidence"))


@query("n11_scene_text", sql("with tg as (select video_id, speaker, min(seg) as seen from segments group by all), b as (select video_id, string_agg(speaker, ', ' order by seen, speaker) as tags from tg group by 1), x as (select video_id, substr(string_agg(text, ' ' order by start_s, end_s, text), 1, 200) as ex from segments where start_s < 30 group by 1) select video_id, 'mood: ' || tags || ' | ' || ex as body from b join x using (video_id)", "segments"))
def n11(s, d):
    seg = view(s, d, "segments")
    tags = N.ordered_distinct(seg, ["video_id"], "speaker", "seg").select("video_id", F.array_join(F.slice("items", 1, 12), ", ").alias("tags"))
    win = seg.select("video_id").distinct().withColumn("i", F.lit(0)).withColumn("a", F.lit(-1.0)).withColumn("b", F.lit(30.0))
    ex = I.text_in_window(win, seg, ["video_id"], "i", "a", "b", "start_s", "end_s", "text", 30.0, most=200)
    return tags.join(ex, "video_id").select("video_id", F.concat(F.lit("mood: "), "tags", F.lit(" | "), "body").alias("body"))


@query("n12_asset_text", "select p_partkey, p_name || ' ' || p_brand || ' ' || p_type as body from part")
def n12(s, d):
    return view(s, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("body"))


@query("n13_first_sentences", r"select doc_id, array_to_string(list_slice(string_split(regexp_replace(trim(text, ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), 1, 3), ' ') as head from documents where text is not null")
def n13(s, d):
    return view(s, d, "documents").where("text is not null").select("doc_id", N.first_sentences(F.col("text")).alias("head"))


@query("n15_batches", sql("select video_id, (i // 3)::int as batch, string_agg(seg::varchar, ',' order by i) as items from (select video_id, seg, row_number() over (partition by video_id order by seg) - 1 as i from segments) group by all", "segments"))
def n15(s, d):
    return N.batches(view(s, d, "segments"), ["video_id"], "seg", "seg", 3).withColumn("items", F.array_join(F.transform("items", lambda x: x.cast("string")), ","))


@query("n16_frame_context", sql("with p as (select frame, key, label, sec from observations where frame % 100 = 0), n as (select p.frame, o.label, count(*) as n from p join observations o on o.key = p.key and o.sec between p.sec - 36000 and p.sec + 36000 group by all) select frame, string_agg(label || '=' || n, ',' order by label) as near from n group by 1", "observations"))
def n16(s, d):
    o = view(s, d, "observations").select("key", "frame", "label", "sec")
    p = o.where("frame % 100 = 0").select("key", F.col("frame").alias("f"), F.col("sec").alias("a"), F.col("sec").alias("b"))
    near = I.points_in(p, o, ["key"], "a", "b", "sec", 36000.0, 36000.0).groupBy("f", "label").agg(F.count(F.lit(1)).alias("n"))
    return near.groupBy(F.col("f").alias("frame")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "label", "n"))), ",").alias("near"))


@query("n17_pending", "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'A')")
def n17(s, d):
    done = view(s, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    return N.pending(view(s, d, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("n18_recent_digest", sql("select video_id, string_agg(speaker || ': ' || substr(text, 1, 40), chr(10) order by seg) as digest from (select *, row_number() over (partition by video_id order by seg desc) as rn from segments) where rn <= 3 group by 1", "segments"))
def n18(s, d):
    return N.recent_digest(view(s, d, "segments"), ["video_id"], "seg", F.concat("speaker", F.lit(": "), F.substring("text", 1, 40)))


@query("n19_shards", sql("select key, frame, ((row_number() over (partition by key order by frame) - 1) // ceil(count(*) over (partition by key) / 4.0)::bigint)::int as shard from observations", "observations"))
def n19(s, d):
    return N.shards(view(s, d, "observations"), ["key"], "frame", 4).select("key", "frame", "shard")


@query("n14_prune_frame", "select event_id, event_type as setting, 'u' || user_id as who from events where event_id % 11 <> 0 and event_id % 13 <> 0")
def n14(s, d):
    from ..sources.tables import parse_frame_output
    from .sourced import outputs

    rows, _ = parse_frame_output(outputs(s, d), ["event_id"], "j")
    return N.prune_frame(rows, ["event_id", "setting"], "people", ["name"]).select("event_id", "setting", F.col("people")[0]["name"].alias("who"))
