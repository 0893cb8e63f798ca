"""Reading and shaping of tables, manifests and nested model output; writing of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Schema of one manifest: shots with key frames.
MANIFEST = "video_id string, fps double, shots array<struct<start_frame:int,end_frame:int,keyframes:array<struct<frame_index:int,role:string>>>>"
FRAME_OUTPUT = "setting string, people array<struct<name:string,emotion:string>>, tags array<string>, motion string, corrupt string"
MOTIONS = ("static", "pan", "zoom")


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, where: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """Parquet rows; filter and columns reach the scan. Order belongs to what is shown in the end, not to the scan."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path)
    df = df if where is None else df.where(where)
    return df.select(*columns) if columns else df


def explode_manifest(df: DataFrame, json: str, per_chunk: int = 5) -> DataFrame:
    """(video_id, shot_index, chunk_index, start_frame, end_frame, frame_index, role, start_time) from manifests as JSON text; fps
    25 where it is missing or 0."""
    m = df.select(F.from_json(json, MANIFEST).alias("m")).select("m.*")
    fps = F.when(F.col("fps") > 0, F.col("fps")).otherwise(25.0)
    shots = m.select("video_id", fps.alias("fps"), F.posexplode("shots").alias("shot_index", "s"))
    return shots.select("video_id", "shot_index", F.floor(F.col("shot_index") / per_chunk).cast("int").alias("chunk_index"), "s.start_frame", "s.end_frame", (F.col("s.start_frame") / F.col("fps")).alias("start_time"), F.explode_outer("s.keyframes").alias("k")).select("*", "k.frame_index", "k.role").drop("k")


def parse_frame_output(df: DataFrame, keys: list[str], json: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): typed columns with motions outside MOTIONS as static; rejects are texts that can't be read or lack people."""
    rows = df.withColumn("o", F.from_json(json, FRAME_OUTPUT, {"columnNameOfCorruptRecord": "corrupt"}))
    bad = F.col("o").isNull() | F.col("o.corrupt").isNotNull() | F.col("o.people").isNull()
    motion = F.when(F.col("o.motion").isin(*MOTIONS), F.col("o.motion")).otherwise("static")
    return rows.where(~bad).select(*keys, "o.setting", "o.people", "o.tags", motion.alias("motion")), rows.where(bad).select(*keys, json)


def normalise_relations(c: Column) -> Column:
    """Relations as JSON, either triples or objects, as an array of (subject, predicate, object)."""
    objects = F.from_json(c, "array<struct<subject:string,predicate:string,object:string>>")
    triples = F.transform(F.filter(F.from_json(c, "array<array<string>>"), lambda t: t.isNotNull() & (F.size(t) == 3)), lambda t: F.struct(t[0].alias("subject"), t[1].alias("predicate"), t[2].alias("object")))
    named = F.filter(objects, lambda o: o.isNotNull() & o["subject"].isNotNull())
    return F.when(F.size(F.coalesce(named, F.array().cast("array<struct<subject:string,predicate:string,object:string>>"))) > 0, named).otherwise(triples)


def explode_words(segments: DataFrame, keys: list[str], words: str) -> DataFrame:
    """(keys, word, start_s, end_s) of an array of (word, start, end) texts; malformed or backward ones are left out."""
    rows = segments.select(*keys, F.explode(words).alias("w")).select(*keys, F.col("w.word").alias("word"), F.expr("try_cast(w.start as double)").alias("start_s"), F.expr("try_cast(w.end as double)").alias("end_s"))
    return rows.where("start_s is not null and end_s >= start_s and word is not null")


def timecode(seconds: Column) -> Column:
    """HH:MM:SS.ss"""
    cs = F.round(seconds * 100).cast("bigint")
    return F.format_string("%02d:%02d:%02d.%02d", F.floor(cs / 360000), F.floor(cs / 6000) % 60, F.floor(cs / 100) % 60, cs % 100)


def chunk_records(shots: DataFrame, video: str, per_chunk: int = 5) -> DataFrame:
    """One record for each chunk with its shots nested in order and a sentence of context."""
    rows = shots.withColumn("chunk", F.floor(F.col("shot_index") / per_chunk).cast("int"))
    item = F.struct("shot_index", "start_frame", "end_frame")
    out = rows.groupBy(video, "chunk").agg(F.array_sort(F.collect_list(item)).alias("shots"), F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"))
    context = F.concat(F.lit("Chunk "), F.col("chunk"), F.lit(" of video "), F.col(video), F.lit(": "), F.size("shots"), F.lit(" shots"))
    return out.withColumn("context", context)


def write_chunk_jsonl(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").json(path)


def table_counts(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, one column of counts for each table), from one union of grouped counts."""
    out = None
    for name, df in tables.items():
        n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).withColumn("t", F.lit(name))
        out = n if out is None else out.unionByName(n)
    return out.groupBy(key).pivot("t", list(tables)).agg(F.first("n")).na.fill(0)


def best_file(files: Column) -> Column:
    """Link of the file of the largest area among mp4 files, else among files with a link."""
    area = lambda f: F.struct((F.coalesce(f["width"], F.lit(0)) * F.coalesce(f["height"], F.lit(0))).alias("area"), f["link"].alias("link"))
    mp4 = F.array_max(F.transform(F.filter(files, lambda f: (f["type"] == "video/mp4") & f["link"].isNotNull()), area))
    any_ = F.array_max(F.transform(F.filter(files, lambda f: f["link"].isNotNull()), area))
    return F.coalesce(mp4, any_)["link"]
