"""Queries for sources and sinks; nested texts are built from the tables by Spark first."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.shared import shared_dir, staged
from ..sources import tables as S
from ..sources import timelines as TL
from .observed import ISL, spans
from .registry import query
from .views import sql, view


@query("s1_read_table", "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F'")
def s1(s, d):
    return S.read_table(s, f"{d}/orders.parquet", where=F.col("o_orderstatus") == "F", columns=["o_orderkey", "o_totalprice"])


@query("s2_explode_manifest", sql("select video_id::varchar as video_id, shot_index, (shot_index // 5)::int as chunk_index, start_frame, end_frame, round(start_frame / 25.0, 6) as start_time, unnest([start_frame, end_frame]) as frame_index, unnest(['common', 'unique']) as role from shots", "shots"))
def s2(s, d):
    key = lambda c, r: F.struct(F.col(c).alias("frame_index"), F.lit(r).alias("role"))
    shot = F.struct("shot_index", F.struct("start_frame", "end_frame", F.array(key("start_frame", "common"), key("end_frame", "unique")).alias("keyframes")).alias("s"))
    m = view(s, d, "shots").groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("shot_index", "start_frame", "end_frame"))), lambda x: F.struct(x["start_frame"].alias("start_frame"), x["end_frame"].alias("end_frame"), F.array(F.struct(x["start_frame"].alias("frame_index"), F.lit("common").alias("role")), F.struct(x["end_frame"].alias("frame_index"), F.lit("unique").alias("role"))).alias("keyframes"))).alias("shots"))
    texts = m.select(F.to_json(F.struct(F.col("video_id").cast("string").alias("video_id"), F.lit(0.0).alias("fps"), "shots")).alias("j"))
    return S.explode_manifest(texts, "j").withColumn("start_time", F.round("start_time", 6))


def outputs(s, d):
    e = view(s, d, "events")
    people = F.array(F.struct(F.concat(F.lit("u"), "user_id").alias("name"), F.col("event_type").alias("emotion")))
    motion = F.when(F.col("event_id") % 3 == 0, "zoom").when(F.col("event_id") % 3 == 1, "spin").otherwise(F.lit(None))
    good = F.to_json(F.struct(F.col("event_type").alias("setting"), people.alias("people"), F.array("event_type", F.lit("x")).alias("tags"), motion.alias("motion"), F.lit(1).alias("extra")))
    return e.select("event_id", F.when(F.col("event_id") % 11 == 0, F.lit("{broken")).when(F.col("event_id") % 13 == 0, F.lit('{"setting": "a"}')).otherwise(good).alias("j"))


@query("s3_parse_frame_output", "select event_id, event_type as setting, 'u' || user_id as person, case when event_id % 3 = 0 then 'zoom' else 'static' end as motion from events where event_id % 11 <> 0 and event_id % 13 <> 0")
def s3(s, d):
    rows, _ = S.parse_frame_output(outputs(s, d), ["event_id"], "j")
    return rows.select("event_id", "setting", F.col("people")[0]["name"].alias("person"), "motion")


@query("s3_rejects", "select event_id from events where event_id % 11 = 0 or event_id % 13 = 0")
def s3b(s, d):
    return S.parse_frame_output(outputs(s, d), ["event_id"], "j")[1].select("event_id")


@query("s4_normalise_relations", "select event_id, 'u' || user_id as subject, event_type as predicate, 'x' as object from events")
def s4(s, d):
    who, what = F.concat(F.lit("u"), "user_id"), F.col("event_type")
    j = F.when(F.col("event_id") % 2 == 0, F.to_json(F.array(F.array(who, what, F.lit("x"))))).otherwise(F.to_json(F.array(F.struct(who.alias("subject"), what.alias("predicate"), F.lit("x").alias("object")))))
    rows = view(s, d, "events").select("event_id", F.explode(S.normalise_relations(j)).alias("r"))
    return rows.select("event_id", "r.*")


@query("s5_explode_words", "select conv_id, turn, w as word, i::double as start_s, i + 0.8 as end_s from (select conv_id, turn, unnest(string_split(text, ' ')) as w, unnest(range(len(string_split(text, ' ')))) as i from conversations) where i % 7 <> 3 and i % 5 <> 4")
def s5(s, d):
    words = F.transform(F.split("text", " "), lambda w, i: F.struct(w.alias("word"), F.when(i % 7 == 3, "bad").otherwise(i.cast("string")).alias("start"), F.when(i % 5 == 4, "-1").otherwise((i + 0.8).cast("string")).alias("end")))
    return S.explode_words(view(s, d, "conversations").withColumn("words", words), ["conv_id", "turn"], "words")


@query("s6_chunk_records", sql("select video_id, (shot_index // 5)::int as chunk, count(*)::int as shots, min(start_frame) as start_frame, max(end_frame) as end_frame, 'Chunk ' || (shot_index // 5)::int || ' of video ' || video_id || ': ' || count(*) || ' shots' as context from shots group by 1, 2", "shots"))
def s6(s, d):
    return S.chunk_records(view(s, d, "shots"), "video_id").withColumn("shots", F.size("shots"))


@query("s8_timecode", sql("select video_id, seg, printf('%02d:%02d:%02d.%02d', c // 360000, (c // 6000) % 60, (c // 100) % 60, c % 100) as clock from (select video_id, seg, round(start_s * 100)::bigint as c from segments)", "segments"))
def s8(s, d):
    return view(s, d, "segments").select("video_id", "seg", S.timecode(F.col("start_s")).alias("clock"))


def timeline(s, d):
    """Spans of observations as events of twenty videos; no share lies between two numbers of four digits."""
    key, at = F.col("key"), lambda c: F.floor(F.col(c) % 86400 * 25).cast("int")
    return spans(s, d, 21600.0).select(
        F.concat(F.lit("v"), key % 20).alias("video"), F.concat(F.lit("actor "), key).alias("actor"), F.col("label").alias("emotion"), F.col("start_s").alias("start"), F.col("end_s").alias("end"),
        (F.col("confidence") * 0.7310585786).alias("confidence"), key.cast("int").alias("actor_id"), F.array((key % 7).cast("int"), F.lit(3), F.col("n").cast("int")).alias("track_ids"),
        at("start_s").alias("start_frame"), at("end_s").alias("end_frame"), F.col("n").cast("int").alias("samples"), (F.col("confidence") * 0.4142135623).alias("similarity"),
    )


TIMELINE = f"""
with {ISL.format(gap='21600')},
ev as (
  select 'v' || key % 20 as video, 'actor ' || key as actor, label as emotion, round(start_s, 3) as start, round(end_s, 3) as "end", round(greatest(0, end_s - start_s), 3) as duration,
         round(confidence * 0.7310585786, 4) as confidence, key::int as actor_id, list_sort(list_distinct([(key % 7)::int, 3, n::int])) as track_ids,
         floor(start_s % 86400 * 25)::int as start_frame, floor(end_s % 86400 * 25)::int as end_frame, n::int as samples, round(confidence * 0.4142135623, 4) as similarity
  from spans
)
"""
BARE = "null::int as actor_id, null::varchar as track_ids, null::int as start_frame, null::int as end_frame, null::int as samples, null::double as similarity"
FULL = "actor_id, array_to_string(track_ids, '|') as track_ids, start_frame, end_frame, samples, similarity"


@query("s7_timeline_sink", sql(TIMELINE.strip() + " " + " union all ".join(f"select '{k}' as form, video, actor, emotion, start, \"end\", confidence, {f} from ev" for k, f in (("csv lean", BARE), ("csv verbose", FULL), ("json lean", BARE), ("json verbose", FULL))), "observations"))
def s7(s, d):
    """All four forms, written to a new shared folder, as they read back."""
    folder, ev, out = f"{shared_dir(s).rstrip('/')}/timeline-{uuid.uuid4().hex}", staged(timeline(s, d)), None
    extra = ("actor_id", "track_ids", "start_frame", "end_frame", "samples", "similarity")
    for kind in ("csv", "json"):
        for form in ("lean", "verbose"):
            path, full = f"{folder}/{kind}-{form}", form == "verbose"
            TL.write_timeline(ev, path, kind, full)
            back = TL.read_timeline_rows(s, path, full) if kind == "csv" else TL.read_timeline(s, path)
            types = {"track_ids": "string", "similarity": "double"}
            more = [(F.array_join(F.transform("track_ids", lambda t: t.cast("string")), "|").alias(c) if c == "track_ids" else F.col(c)) if full else F.lit(None).cast(types.get(c, "int")).alias(c) for c in extra]
            rows = back.select(F.lit(f"{kind} {form}").alias("form"), "video", "actor", "emotion", "start", "end", "confidence", *more)
            out = rows if out is None else out.unionByName(rows)
    return out


@query("s9_timeline_source", sql(TIMELINE.strip() + """, videos as (select video, round(max("end") - min(start), 3) as video_duration from ev group by 1)
select video, video_duration, 25.0::double as fps, actor, emotion, start, "end", confidence, case when odd then actor_id else -1 end as actor_id,
       case when odd then array_to_string(track_ids, '|') else '' end as track_ids, case when odd then start_frame else -1 end as start_frame,
       case when odd then end_frame else -1 end as end_frame, case when odd then samples else 0 end as samples, case when odd then similarity else 0.0 end as similarity
from (select *, actor_id % 2 = 1 as odd from ev) join videos using (video)""", "observations"))
def s9(s, d):
    """Documents of even videos in the lean form, of odd ones in the verbose, through the one reader."""
    folder, ev = f"{shared_dir(s).rstrip('/')}/timeline-{uuid.uuid4().hex}", staged(timeline(s, d))
    videos = ev.groupBy("video").agg(F.round(F.max("end") - F.min("start"), 3).alias("video_duration")).withColumn("fps", F.lit(25.0))
    for odd in (0, 1):
        TL.write_timeline(ev.where(F.col("actor_id") % 2 == odd), f"{folder}/{odd}", "json", bool(odd), videos)
    back = TL.read_timeline(s, f"{folder}/*")
    return back.withColumn("track_ids", F.array_join(F.transform("track_ids", lambda t: t.cast("string")), "|"))


@query("s10_table_counts", "select c_custkey as k, count(distinct o_orderkey) as orders, count(l_orderkey) as lines from customer join orders on o_custkey = c_custkey left join lineitem on l_orderkey = o_orderkey group by 1")
def s10(s, d):
    o = view(s, d, "orders").withColumn("k", F.col("o_custkey"))
    lines = view(s, d, "lineitem").join(o.select("k", "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return S.table_counts({"orders": o, "lines": lines}, "k")


@query("s11_best_file", "select p_partkey, case when p_size % 3 = 0 then 'b' else 'a' end || p_partkey as link from part")
def s11(s, d):
    f = lambda t, w, l: F.struct(F.lit(t).alias("type"), w.cast("int").alias("width"), F.lit(10).alias("height"), F.concat(F.lit(l), "p_partkey").alias("link"))
    small = F.when(F.col("p_size") % 3 == 0, "video/mp4").otherwise("video/webm")
    files = F.array(f("video/webm", F.lit(100), "a"), F.struct(small.alias("type"), F.lit(50).alias("width"), F.lit(10).alias("height"), F.concat(F.lit("b"), "p_partkey").alias("link")))
    return view(s, d, "part").select("p_partkey", S.best_file(files).alias("link"))
