"""A property graph as two tables: nodes (node_type, ref_id, label, ...) and edges (src, dst, relation, weight, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpoints


def node_key(kind: str, value: Column) -> Column:
    """``kind:`` and the value trimmed in lower case."""
    return F.concat(F.lit(f"{kind}:"), F.lower(F.trim(value)))


def extract_nodes(frames: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """(node_type, ref_id, label) of each frame by kind; a column of arrays gives a node for each item. Keys are distinct, the
    smallest label stands for a key."""
    out = None
    for kind, c in kinds.items():
        rows = frames.select(c.alias("v"))
        if dict(rows.dtypes)["v"].startswith("array"):
            rows = rows.select(F.explode("v").alias("v"))
        rows = rows.where(F.col("v").isNotNull() & (F.trim(F.col("v").cast("string")) != "")).select(F.lit(kind).alias("node_type"), node_key(kind.lower(), F.col("v").cast("string")).alias("ref_id"), F.col("v").cast("string").alias("label"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("node_type", "ref_id").agg(F.min("label").alias("label"))


def dedup_nodes(nodes: DataFrame, keys: list[str], order: str, mode: str = "last") -> DataFrame:
    """``last``: the row that comes last. ``merge``: the first label that isn't empty and the union of the property maps in
    order, later ones winning."""
    if mode == "last":
        rest = [c for c in nodes.columns if c not in keys]
        return nodes.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")
    rows = nodes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "label", F.map_entries("properties").alias("entries")))).alias("l"))
    label = F.get(F.filter(F.transform("l", lambda x: x["label"]), lambda v: v.isNotNull() & (v != "")), F.lit(0))
    # of entries of one key the last stays: the entries in reverse, without those whose key came before
    every = F.reverse(F.flatten(F.transform("l", lambda x: x["entries"])))
    keys_of = F.transform(every, lambda e: e["key"])
    merged = F.map_from_entries(F.filter(every, lambda e, i: F.array_position(keys_of, e["key"]) == i + 1))
    return rows.select(*keys, label.alias("label"), merged.alias("properties"))


def merge_edges(edges: DataFrame, nodes: DataFrame, order: list[str], relation: str = "relation") -> tuple[DataFrame, DataFrame]:
    """(edges, missing): one edge for each (src, relation, dst), the last weight winning, self-loops dropped; edges of which
    an end is no node (id) are counted by relation instead."""
    ids = nodes.select("id")
    ok = edges.where("src <> dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    merged = ok.groupBy("src", relation, "dst").agg(F.max_by("weight", F.struct(*order)).alias("weight"))
    lost = edges.where("src <> dst").join(ids.withColumnRenamed("id", "src").withColumn("s_in", F.lit(True)), "src", "left").join(ids.withColumnRenamed("id", "dst").withColumn("d_in", F.lit(True)), "dst", "left")
    return merged, lost.where("s_in is null or d_in is null").groupBy(relation).agg(F.count(F.lit(1)).alias("missing"))


def first_edges(edges: DataFrame, keys: list[str], order: str, tie: str) -> DataFrame:
    return edges.groupBy(*keys).agg(F.min(F.struct(order, tie)).alias("f")).select(*keys, f"f.{tie}", f"f.{order}")


#: Rows in a partition of cooccurrence(): more rows go into more partitions, so a task holds the same however many there are.
COOCCURRING = 400_000


def cooccurrence(df: DataFrame, frame: str, entity: str) -> DataFrame:
    """(a, b, n): pairs of distinct entities of one frame, a < b, with the number of frames; a frame lists few entities."""
    rows = df.select(frame, entity).where(F.col(frame).isNotNull() & F.col(entity).isNotNull())
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // COOCCURRING))
    held = rows.repartition(parts, frame).groupBy(frame).agg(F.array_sort(F.collect_set(entity)).alias("held_c")).where(F.size("held_c") > 1)
    firsts = held.select("held_c", F.posexplode("held_c").alias("i_c", "a"))
    pairs = firsts.select("a", F.explode(F.slice("held_c", F.col("i_c") + 2, F.size("held_c"))).alias("b"))
    # few pairs come twice in one task, so they are counted after the shuffle only
    return pairs.repartition(parts, "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def sanitise_relation(c: Column) -> Column:
    """Upper case, other characters than A-Z, 0-9 and _ to _, 64 characters, without _ at the ends, RELATES_TO if empty."""
    s = F.regexp_replace(F.substring(F.regexp_replace(F.upper(F.trim(c)), "[^A-Z0-9_]", "_"), 1, 64), "^_+|_+$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", "RELATES_TO").otherwise(s)


def humanise(c: Column) -> Column:
    return F.lower(F.replace(c, F.lit("_"), F.lit(" ")))


def resolve_triples(triples: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(src, relation, dst): subject and object through the first of ``levels`` (name, id) that knows them; else the edge goes."""
    out = triples
    for end in ("subject", "object"):
        for i, names in enumerate(levels):
            out = out.join(names.groupBy(F.lower(F.trim("name")).alias(f"{end}_n{i}")).agg(F.min("id").alias(f"{end}_i{i}")), F.lower(F.trim(F.col(end))) == F.col(f"{end}_n{i}"), "left")
        out = out.withColumn("src" if end == "subject" else "dst", F.coalesce(*[F.col(f"{end}_i{i}") for i in range(len(levels))]))
    return out.where("src is not null and dst is not null and src <> dst").select("src", sanitise_relation(F.col("predicate")).alias("relation"), "dst")


def sequence_edges(scenes: DataFrame, key: str, scene: str, at: str, mood: str, tension: Column) -> DataFrame:
    """(key, src, dst, relation, weight): FOLLOWS with 1 / max(gap, 1), EMOTIONAL_SHIFT where the mood changes, weighted by the
    change of tension."""
    first = scenes.groupBy(key, scene).agg(F.min(at).alias("at_s"), F.min_by(mood, at).alias("mood_s"), F.min_by(tension, at).alias("tension_s"))
    w = Window.partitionBy(key).orderBy("at_s", scene)
    nxt = lambda c: F.lead(c).over(w)
    rows = first.withColumn("dst", nxt(scene)).withColumn("gap", nxt("at_s") - F.col("at_s")).withColumn("shift", nxt("mood_s") != F.col("mood_s")).withColumn("delta", F.abs(nxt("tension_s") - F.col("tension_s"))).where("dst is not null")
    follows = rows.select(key, F.col(scene).alias("src"), "dst", F.lit("FOLLOWS").alias("relation"), (1 / F.greatest(F.col("gap"), F.lit(1.0))).alias("weight"))
    return follows.unionByName(rows.where("shift").select(key, F.col(scene).alias("src"), "dst", F.lit("EMOTIONAL_SHIFT").alias("relation"), F.col("delta").cast("double").alias("weight")))


def with_endpoints(edges: DataFrame, src: DataFrame, dst: DataFrame) -> DataFrame:
    """Edges with the labels of both ends, from (id, label)."""
    return edges.join(src.select(F.col("id").alias("src"), F.col("label").alias("src_label")), "src").join(dst.select(F.col("id").alias("dst"), F.col("label").alias("dst_label")), "dst")


def canonicalise(edges: DataFrame, mapping: DataFrame, ontology: DataFrame) -> DataFrame:
    """Edges with ``canonical``: the mapping's (raw, target) if the target is in the ontology (relation), else OTHER."""
    m = mapping.join(ontology.withColumnRenamed("relation", "target"), "target", "left_semi").select(F.col("raw").alias("relation"), F.col("target").alias("canonical"))
    return edges.join(m, "relation", "left").withColumn("canonical", F.coalesce("canonical", F.lit("OTHER")))


def other_share(edges: DataFrame) -> DataFrame:
    each = edges.select("relation", "canonical").distinct()
    return each.agg(F.count(F.lit(1)).alias("relations"), F.avg((F.col("canonical") == "OTHER").cast("double")).alias("other_share"))


#: Sources of a target from which it is heavy: they are dealt into blocks of about so many. Heavy targets that are broadcast.
BLOCK, HEAVY = 10_000, 1_000_000


def meetings(edges: DataFrame, who: Column | None = None, block: int = BLOCK) -> DataFrame:
    """(a, b) for each common target of two sources. The sources of a heavy target are dealt into blocks, each with its own
    join key, and those that are asked for go to every block: so no task has a target whole."""
    e = edges.select("src", "dst").distinct()
    heavy = e.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("dst", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    n = heavy.count()
    marked = e.join(F.broadcast(heavy) if n <= HEAVY else heavy, "dst", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))) if n else e.withColumn("blocks", F.lit(1))
    a = (marked.where(who) if who is not None else marked).select(F.col("src").alias("a"), "dst", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    b = marked.select(F.col("src").alias("b"), "dst", F.pmod(F.xxhash64("src"), F.col("blocks")).cast("int").alias("block"))
    return a.join(b, ["dst", "block"]).where("a <> b").select("a", "b")


def shared_neighbours(edges: DataFrame, who: Column | None = None, block: int = BLOCK) -> DataFrame:
    """(a, b, n): pairs of sources with common targets and how many they have, a <> b; ``who`` limits a."""
    return meetings(edges, who, block).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def chain(edges: DataFrame, start: DataFrame, hops: int = 10) -> DataFrame:
    """(start, node, depth): nodes on paths of 1 .. ``hops`` edges (src, dst) from (node); an edge isn't used twice on a path."""
    checkpoints(edges.sparkSession)
    e = edges.select("src", "dst").distinct()
    at = start.select(F.col("node").alias("start"), "node", F.array().cast("array<string>").alias("path"))
    out = None
    for depth in range(1, hops + 1):
        edge = F.concat_ws(">", F.col("src").cast("string"), F.col("dst").cast("string"))
        at = at.join(e, F.col("node") == F.col("src")).where(~F.array_contains("path", edge)).select("start", F.col("dst").alias("node"), F.array_append("path", edge).alias("path")).checkpoint()
        if not at.take(1):
            break
        found = at.select("start", "node", F.lit(depth).alias("depth")).distinct()
        out = found if out is None else out.unionByName(found)
    return out


def degree(edges: DataFrame, k: int | None = None) -> DataFrame:
    """(node, degree), the ``k`` largest if given, ties to the smaller node."""
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return ends.orderBy(F.desc("degree"), "node").limit(k) if k else ends
