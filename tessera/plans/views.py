"""Views of the given tables in the shapes that the operators take, and the same views as SQL.

``view(spark, sf_dir, name)`` builds one; ``sql(body, *names)`` puts the definitions that a query needs before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("label").orderBy("vec_id")
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("video_id"), (F.row_number().over(order) - 1).alias("frame_index"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.withColumn("shot_index", F.floor(F.col("frame_index") / 8).cast("int"))


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir).groupBy("video_id", "shot_index").agg(F.min("frame_index").alias("start_frame"), F.max("frame_index").alias("end_frame"))
    return rows.withColumn("fps", F.lit(2.0)).withColumn("duration_s", (F.col("end_frame") - F.col("start_frame") + 1) / 2.0)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"), F.col("event_type").alias("label"), F.col("ts").cast("timestamp").alias("ts"),
        (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000) / 1000).alias("sec"), F.least(F.lit(1.0), F.col("value") / 100).alias("confidence"), F.col("event_id").alias("frame"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hour cells of each key in which it has observations."""
    cells = observations(spark, sf_dir).select("key", F.floor(F.col("sec") / 21600).alias("cell")).distinct()
    return cells.select("key", F.concat_ws(":", F.col("key"), F.col("cell")).alias("turn_id"), (F.col("cell") * 21600.0).alias("start_s"), ((F.col("cell") + 1) * 21600.0).alias("end_s"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn")
    n = F.length("text") / 15.0
    rows = table(spark, sf_dir, "conversations").withColumn("n", n).withColumn("end_s", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select(F.col("conv_id").alias("video_id"), F.col("turn").alias("seg"), F.round(F.col("end_s") - F.col("n"), 4).alias("start_s"), F.round("end_s", 4).alias("end_s"), "text", F.col("role").alias("speaker"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of 60 seconds of each conversation."""
    far = segments(spark, sf_dir).groupBy("video_id").agg(F.max("end_s").alias("far"))
    cells = far.select("video_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("far") / 60).cast("int"))).alias("chunk"))
    return cells.select("video_id", "chunk", (F.col("chunk") * 60.0).alias("start_s"), ((F.col("chunk") + 1) * 60.0).alias("end_s"))


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plan_id"), F.lit(100.0).alias("target"), F.col("o_orderdate").alias("created"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("client"))


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One operation for each (order, line number); of lines that share it, the one of least part."""
    first = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").withColumn("rn", F.row_number().over(first)).where("rn = 1")
    return rows.select(
        F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("op_id"), F.col("l_partkey").alias("scene_id"), F.col("l_quantity").alias("start_s"),
        F.round(F.col("l_quantity") + 1 + F.col("l_tax") * 100, 2).alias("end_s"), F.col("l_discount").alias("relevance"), F.col("l_returnflag").alias("kind"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.lit("Part").alias("node_type"), F.col("p_partkey").cast("string").alias("ref_id"), F.col("p_name").alias("label"))
    supplier = table(spark, sf_dir, "supplier").select(F.lit("Supplier").alias("node_type"), F.col("s_suppkey").cast("string").alias("ref_id"), F.col("s_name").alias("label"))
    nation = table(spark, sf_dir, "nation").select(F.lit("Nation").alias("node_type"), F.col("n_nationkey").cast("string").alias("ref_id"), F.col("n_name").alias("label"))
    return part.unionByName(supplier).unionByName(nation)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.concat_ws("_", "l_returnflag", "l_linestatus").alias("relation"), F.col("l_discount").alias("weight"),
        F.col("l_shipdate").alias("ts"), F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("frame_id"), F.col("l_linenumber").alias("x"), (F.col("l_orderkey") % 16).cast("int").alias("y"),
        unit(F.col("l_quantity") / 50).alias("r"), unit(F.col("l_discount") * 10).alias("g"), unit(F.col("l_tax") * 12.5).alias("b"),
    )


VIEWS = {f.__name__: f for f in (frames, shots, observations, turns, segments, chunks, plans, ops, nodes, edges, pixels)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return VIEWS[name](spark, sf_dir) if name in VIEWS else table(spark, sf_dir, name)


#: name: (views it needs, definition)
SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "frames": ((), "select video_id, frame_index, (frame_index // 8)::int as shot_index, embedding from (select label as video_id, (row_number() over (partition by label order by vec_id) - 1)::int as frame_index, embedding::double[] as embedding from embeddings)"),
    "shots": (("frames",), "select video_id, shot_index, min(frame_index) as start_frame, max(frame_index) as end_frame, 2.0::double as fps, (max(frame_index) - min(frame_index) + 1) / 2.0::double as duration_s from frames group by all"),
    "observations": ((), "select user_id as key, event_type as label, ts, floor(epoch_us(ts) / 1000) / 1000 as sec, least(1.0, value / 100) as confidence, event_id as frame from events"),
    "released": (("observations",), "select * from observations where epoch_us(ts) <= (select max(epoch_us(ts)) // 1000 - 3600000 from observations) * 1000"),
    "turns": (("observations",), "select key, concat_ws(':', key, cell) as turn_id, cell * 21600.0::double as start_s, (cell + 1) * 21600.0::double as end_s from (select distinct key, floor(sec / 21600)::bigint as cell from observations)"),
    "segments": ((), "select conv_id as video_id, turn as seg, round(end_s - n, 4) as start_s, round(end_s, 4) as end_s, text, role as speaker from (select *, length(text) / 15.0::double as n, sum(length(text) / 15.0::double) over (partition by conv_id order by turn rows unbounded preceding) as end_s from conversations)"),
    "chunks": (("segments",), "select video_id, chunk, chunk * 60.0::double as start_s, (chunk + 1) * 60.0::double as end_s from (select video_id, unnest(range(0, floor(max(end_s) / 60)::int + 1))::int as chunk from segments group by 1)"),
    "plans": ((), "select o_orderkey as plan_id, 100.0::double as target, o_orderdate as created, o_orderstatus as status, o_custkey as client from orders"),
    "ops": ((), "select l_orderkey as plan_id, l_linenumber as op_id, l_partkey as scene_id, l_quantity as start_s, round(l_quantity + 1 + l_tax * 100, 2) as end_s, l_discount as relevance, l_returnflag as kind from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_extendedprice) as rn from lineitem) where rn = 1"),
    "nodes": ((), "select 'Part' as node_type, p_partkey::varchar as ref_id, p_name as label from part union all select 'Supplier', s_suppkey::varchar, s_name from supplier union all select 'Nation', n_nationkey::varchar, n_name from nation"),
    "edges": ((), "select l_suppkey as src, l_partkey as dst, l_returnflag || '_' || l_linestatus as relation, l_discount as weight, l_shipdate as ts, l_orderkey as ok, l_linenumber as ln, l_quantity as q, l_extendedprice as p from lineitem"),
    "pixels": ((), "select l_suppkey as frame_id, l_linenumber as x, (l_orderkey % 16)::int as y, least(1.0, greatest(0.0, l_quantity / 50)) as r, least(1.0, greatest(0.0, l_discount * 10)) as g, least(1.0, greatest(0.0, l_tax * 12.5)) as b from lineitem"),
}


def sql(body: str, *names: str) -> str:
    """``body`` after the definitions of the views ``names`` and of those they need; a body that begins with ``with`` goes on from them."""
    order: list[str] = []

    def need(n: str) -> None:
        for x in SQL[n][0]:
            need(x)
        if n not in order:
            order.append(n)

    for n in names:
        need(n)
    body = body.strip()
    recursive = body.startswith("with recursive")
    head = ", ".join(f"{n} as ({SQL[n][1]})" for n in order)
    if not head:
        return body
    if body.startswith("with"):
        return f"with {'recursive ' if recursive else ''}{head}, {body[len('with recursive') if recursive else len('with'):].strip()}"
    return f"with {head} {body}"
