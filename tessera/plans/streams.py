"""Queries that run a stream over the events table to its end; each has the SQL of the same question on the table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import shared_dir
from ..streaming import spans as S
from ..streaming.merge import KeyedTable
from .observed import HISTS, LABELS, MOST, changes, smoothing
from .registry import query
from .views import sql, table


def folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    path = f"{sf_dir}/events.parquet"
    reader = spark.readStream.schema(schema)
    # a stream reads folders: the table's own, or, for a table of one file, the one it lies in
    raw = reader.parquet(path) if _is_folder(spark, path) else reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("sec", F.floor(F.unix_micros("ts") / 1000) / 1000)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def finished(stream: DataFrame) -> DataFrame:
    """What the stream has put out when everything that is there has been read."""
    spark = stream.sparkSession
    out = folder(spark)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


#: Rows that the watermark, an hour behind the newest, has passed; later ones still wait when the stream ends.
OBS = """
top as (select max(epoch_us(ts)) // 1000 - 3600000 as mark from events),
seen as (select events.* from events, top where epoch_us(ts) <= mark * 1000),
o as (
  select user_id as key, event_type as label, event_id as frame, least(1.0::double, value / 100) as confidence, floor(epoch_us(ts) / 1000) / 1000 as sec
  from seen
)
"""


def observed(s, d):
    return events(s, d).select(F.col("user_id").alias("key"), F.col("event_type").alias("label"), F.col("event_id").alias("frame"), F.least(F.lit(1.0), F.col("value") / 100).alias("confidence"), "sec", "ts")


SPANS = f"""
with {OBS},
l as (select *, lag(label) over w as p, lag(sec) over w as ps from o window w as (partition by key order by sec, label)),
i as (
  select *, sum((p is null or p <> label or sec - ps > 21600)::int) over (partition by key order by sec, label rows unbounded preceding) as island
  from l
),
s as (select key, island, any_value(label) as label, min(sec) as start_s, max(sec) as last_s, count(*) as n from i group by 1, 2),
e as (select *, lead(start_s) over (partition by key order by island) as nx from s)
select key, label, start_s, case when nx - last_s <= 21600 then nx else last_s end as end_s, n
from e, top where nx is not null or round((last_s + 21600) * 1000) <= mark
"""


@query("t1_open_spans", SPANS.strip())
def t1(s, d):
    return finished(S.open_spans(observed(s, d), "key", "sec", "label", 21600.0))


SILENCE = 172_800.0


@query("t3_smooth_hybrid", sql(smoothing("hybrid", SILENCE, "released").strip(), "released"))
def t3(s, d):
    return finished(S.smooth_stream(observed(s, d), "key", "frame", "sec", "label", "confidence", "hybrid", LABELS, SILENCE))


STALE = f"""
with {OBS},
l as (select *, coalesce(sec - lag(sec) over (partition by key order by frame) > {SILENCE}, true)::int as anew from o),
g as (select *, sum(anew) over (partition by key order by frame rows unbounded preceding) as life from l),
w as (
  select key, frame, life, confidence, list(label) over v as names, list(confidence) over v as vals
  from g window v as (partition by key, life order by frame rows between 4 preceding and current row)
),
b as (select *, {MOST.format(v='names')} as best from w),
f as (
  select *, last_value(case when best.n >= least(3, len(names)) then best.l end ignore nulls)
            over (partition by key, life order by frame rows between unbounded preceding and current row) as voted
  from b
)
select key, frame, voted,
       round(coalesce(list_avg(list_transform(list_filter(list_zip(names, vals), lambda z: z[1] = voted), lambda z: z[2])), confidence), 8) as vote_mean
from f
"""


@query("t4_vote", STALE.strip())
def t4(s, d):
    return finished(S.vote_stream(observed(s, d), "key", "frame", "sec", "label", "confidence", SILENCE)).withColumn("vote_mean", F.round("vote_mean", 8))


#: Turns of conversations, a minute each from an hour of the conversation on; some never come. The watermark is at ``mark``.
TURNS = """
with t as (select conv_id, turn, 1704067200 + (conv_id % 500) * 3600 + turn * 60 as sec from conversations where (conv_id + turn) % 7 > 0),
top as (select max(sec) - 3600 as mark from t),
n as (select *, row_number() over (partition by conv_id order by turn) - 1 + {first} = turn as ok, max(sec) over (partition by conv_id) as last from t)
select conv_id, turn, not ok as forced from n, top where ok or last + 600 < mark
"""


@query("t5_release_in_order", TURNS.format(first=0).strip())
def t5(s, d):
    rows = s.readStream.schema(table(s, d, "conversations").schema)
    path = f"{d}/conversations.parquet"
    rows = rows.parquet(path) if _is_folder(s, path) else rows.option("pathGlobFilter", "conversations.parquet").parquet(d)
    sec = (F.lit(1704067200) + (F.col("conv_id") % 500) * 3600 + F.col("turn") * 60).cast("double")
    rows = rows.where((F.col("conv_id") + F.col("turn")) % 7 > 0).select("conv_id", "turn", sec.alias("sec"), F.timestamp_seconds(sec).alias("ts"))
    return finished(S.release_in_order(rows, "conv_id", "turn", "sec", 0, 600.0))


CUTS = f"""
with recursive {OBS.strip()}, {HISTS.format(events="seen")},
f as (select key, i, score, list_sort(list(score) over (partition by key order by i rows between 47 preceding and current row)) as held from sc),
cut as (
  select key, i, score, row_number() over (partition by key order by i) as no from f
  where score >= case when len(held) >= 12 then greatest(0.35, 3 * (held[(len(held) - 1) // 2 + 1] + held[len(held) // 2 + 1]) / 2 + 0.08) else 0.35 end
),
g as (
  select key, 0::bigint as no, null::bigint as kept_at, false as kept from (select distinct key from cut)
  union all
  select c.key, c.no, case when g.kept_at is null or c.i - g.kept_at >= 500 then c.i else g.kept_at end, g.kept_at is null or c.i - g.kept_at >= 500
  from g join cut c on c.key = g.key and c.no = g.no + 1
)
select key, i, round(score, 5) as score from cut join (select key, no from g where kept) using (key, no)
"""


@query("t8_cuts", CUTS.strip())
def t8(s, d):
    h = F.array(F.col("value"), F.col("value") * (F.col("event_id") % 3), F.length("event_type").cast("double"), (F.col("event_id") % 7).cast("double"))
    e = events(s, d).select(F.col("user_id").alias("key"), F.col("event_id").alias("i"), h.alias("hist"), "sec", "ts")
    return finished(S.cut_stream(e, "key", "i", "sec", "hist", 500, 1e9)).withColumn("score", F.round("score", 5))


@query("t9_emit_changes", sql(changes("false", "key, sec, label", "released").strip(), "released"))
def t9(s, d):
    return finished(S.emit_changes_stream(observed(s, d), "key", "sec", "label", 43200.0))


@query("t11_distinct_events", "select event_id, user_id, event_type from events")
def t11(s, d):
    e = events(s, d)
    twice = e.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return finished(S.distinct_events(twice, ["event_id"], "ts", "40 days")).select("event_id", "user_id", "event_type")


LAST = "m as (select max(ts) as top from events)"


@query("t2_sessions", f"with {LAST}, l as (select user_id as key, ts, lag(ts) over (partition by user_id order by ts) as p from events), i as (select key, ts, sum((p is null or ts - p >= interval 6 hours)::int) over (partition by key order by ts rows unbounded preceding) as s from l), g as (select key, min(ts) as a, max(ts) as b, count(*) as n from i group by key, s) select key, (epoch_us(a) // 1000)::bigint as start_ms, (epoch_us(b + interval 6 hours) // 1000)::bigint as end_ms, n from g, m where b + interval 6 hours <= top - interval 1 hour")
def t2(s, d):
    out = finished(S.sessions(events(s, d).withColumn("key", F.col("user_id")), "key", "ts", "6 hours", "1 hour"))
    return out.select("key", F.unix_millis("start_at").alias("start_ms"), F.unix_millis("end_at").alias("end_ms"), "n")


@query("t6_sliding_rates", f"with {LAST}, w as (select event_type, value, unnest([time_bucket(interval 1 day, ts), time_bucket(interval 1 day, ts) - interval 1 day]) as a from events) select event_type, epoch_ms(a) as start_ms, count(*) as n, round(avg(value), 8) as mean from w, m where a + interval 2 days <= top - interval 1 hour group by 1, 2")
def t6(s, d):
    out = finished(S.period_counts(events(s, d), ["event_type"], "ts", "2 days", "1 hour", "1 day"))
    return out.select("event_type", F.unix_millis("start_at").alias("start_ms"), "n", F.round("mean", 8).alias("mean"))


@query("t7_period_counts", f"with {LAST} select event_type, epoch_ms(time_bucket(interval 1 day, ts)) as start_ms, count(*) as n from events, m where time_bucket(interval 1 day, ts) + interval 1 day <= top - interval 1 hour group by 1, 2")
def t7(s, d):
    out = finished(S.period_counts(events(s, d), ["event_type"], "ts", "1 day", "1 hour"))
    return out.select("event_type", F.unix_millis("start_at").alias("start_ms"), "n")


@query("t10_upsert_sink", "select user_id, arg_max(event_type, event_id) as event_type, max(event_id) as event_id from events group by 1")
def t10(s, d):
    e = events(s, d).select("user_id", "event_type", "event_id")
    out = folder(s)
    kept = KeyedTable(s, out, e.schema, ["user_id"], "event_id")
    e.writeStream.foreachBatch(kept.sink()).option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start().awaitTermination()
    return kept.read()
