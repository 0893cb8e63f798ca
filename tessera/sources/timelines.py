"""Timelines of events as files: CSV rows and JSON documents of a video, both lean and verbose, and the way back.

An event is (video, actor, emotion, start, end, confidence) and, in the verbose forms, (actor_id, track_ids, start_frame,
end_frame, samples, similarity). Seconds have three digits, shares four; tracks are distinct and in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the files in their order.
LEAN = ("actor", "emotion", "start", "end", "duration", "confidence")
VERBOSE = ("actor", "actor_id", "emotion", "start", "end", "duration", "confidence", "similarity", "start_frame", "end_frame", "samples", "track_ids")
EVENT = "actor:string,emotion:string,start:double,end:double,confidence:double,actor_id:int,track_ids:array<int>,start_frame:int,end_frame:int,samples:int,similarity:double"
INFO = "path:string,video_duration:double,fps:double"
DOCUMENT = f"video string, video_duration double, fps double, video_info struct<{INFO}>, events array<struct<{EVENT}>>"
#: What an event of the lean form lacks.
DEFAULTS = {"confidence": 0.0, "actor_id": -1, "start_frame": -1, "end_frame": -1, "samples": 0, "similarity": 0.0}
DIGITS = {"start": 3, "end": 3, "duration": 3, "confidence": 4, "similarity": 4}


def _columns(verbose: bool, text: bool) -> list[Column]:
    """The fields of an event as they are written: numbers of so many digits, as text in CSV."""
    value = {"duration": F.greatest(F.lit(0.0), F.col("end") - F.col("start")), "track_ids": F.array_sort(F.array_distinct("track_ids"))}
    if text:
        value["track_ids"] = F.array_join(F.transform(value["track_ids"], lambda t: t.cast("string")), "|")
    digits = lambda c, n: F.format_string(f"%.{n}f", c) if text else F.round(c, n)
    names = VERBOSE if verbose else LEAN
    return [(digits(value.get(c, F.col(c)), DIGITS[c]) if c in DIGITS else value.get(c, F.col(c))).alias(c) for c in names]


def timeline_rows(events: DataFrame, verbose: bool = False) -> DataFrame:
    """Rows of the CSV form, as text."""
    return events.select("video", *_columns(verbose, True))


def timeline_documents(events: DataFrame, verbose: bool = False, videos: DataFrame | None = None) -> DataFrame:
    """One document a video with its events in order of start and actor; ``videos``: (video, video_duration, fps)."""
    rows = events.select("video", F.struct(F.col("start").alias("s"), F.col("actor").alias("a"), F.struct(*_columns(verbose, False)).alias("e")).alias("x"))
    docs = rows.groupBy("video").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["e"]).alias("events"))
    if videos is None:
        return docs
    docs = docs.join(videos, "video")
    return docs.withColumn("video_info", F.struct(F.col("video").alias("path"), "video_duration", "fps")) if verbose else docs


def write_timeline(events: DataFrame, path: str, kind: str = "csv", verbose: bool = False, videos: DataFrame | None = None) -> None:
    """Write ``events``: CSV with a folder a video and rows by start and actor, or JSON with a line a video."""
    if kind == "json":
        timeline_documents(events, verbose, videos).write.mode("overwrite").json(path)
    else:
        rows = events.repartition("video").sortWithinPartitions("video", "start", "actor")
        timeline_rows(rows, verbose).write.partitionBy("video").mode("overwrite").csv(path, header=True)


def read_timeline(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """(video, video_duration, fps, actor, emotion, start, end, ...) of JSON documents of either form; what a form lacks has the
    values of DEFAULTS. multiline: a file is one indented document."""
    docs = spark.read.schema(DOCUMENT).option("multiLine", str(multiline).lower()).json(path)
    about = [F.coalesce("video_info.path", "video").alias("video"), *[F.coalesce(f"video_info.{c}", c, F.lit(0.0)).alias(c) for c in ("video_duration", "fps")]]
    rows = docs.select(*about, F.explode("events").alias("e")).select("video", "video_duration", "fps", "e.*")
    return rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in DEFAULTS.items()}).withColumn("track_ids", F.coalesce("track_ids", F.array().cast("array<int>")))


def read_timeline_rows(spark: SparkSession, path: str, verbose: bool = False) -> DataFrame:
    """Events of the CSV form."""
    kinds = {"actor": "string", "emotion": "string", "track_ids": "string", "actor_id": "int", "start_frame": "int", "end_frame": "int", "samples": "int"}
    fields = ", ".join(f"`{c}` {kinds.get(c, 'double')}" for c in (VERBOSE if verbose else LEAN))
    rows = spark.read.schema(f"{fields}, video string").option("enforceSchema", "true").csv(path, header=True)
    tracks = F.transform(F.filter(F.split("track_ids", "\\|"), lambda t: t != ""), lambda t: t.cast("int"))
    return rows.withColumn("track_ids", F.coalesce(tracks, F.array().cast("array<int>"))) if verbose else rows
