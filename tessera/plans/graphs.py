"""Queries for the graph: suppliers and parts are nodes, line items edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs as G
from .registry import query
from .views import sql, view


def edges(s, d):
    return view(s, d, "edges")


@query("g1_extract_nodes", "with n as (select 'Emotion' as node_type, event_type as v from events union all select 'Theme', unnest([event_type || ' ', upper(event_type)]) from events union all select 'Person', user_id::varchar from events) select node_type, lower(node_type) || ':' || lower(trim(v)) as ref_id, min(v) as label from n group by all")
def g1(s, d):
    return G.extract_nodes(view(s, d, "events"), {"Emotion": F.col("event_type"), "Theme": F.array(F.concat("event_type", F.lit(" ")), F.upper("event_type")), "Person": F.col("user_id")})


@query("g2_structure_graph", sql("select 'video:' || video_id as src, 'shot:' || video_id || ':' || shot_index as dst from shots union all select 'shot:' || s.video_id || ':' || s.shot_index, 'frame:' || f.video_id || ':' || frame_index from shots s join frames f on f.video_id = s.video_id and frame_index between start_frame and end_frame", "shots"))
def g2(s, d):
    sh = view(s, d, "shots")
    shot = F.concat_ws(":", F.lit("shot"), "video_id", "shot_index")
    inside = view(s, d, "frames").drop("shot_index").join(sh, "video_id").where(F.col("frame_index").between(F.col("start_frame"), F.col("end_frame")))
    return sh.select(F.concat_ws(":", F.lit("video"), "video_id").alias("src"), shot.alias("dst")).unionByName(inside.select(shot.alias("src"), F.concat_ws(":", F.lit("frame"), "video_id", "frame_index").alias("dst")))


@query("g3_dedup_nodes", "select l_suppkey as id, arg_max(l_returnflag || l_linestatus, {'a': l_shipdate, 'b': l_orderkey, 'c': l_linenumber, 'd': l_partkey}) as label from lineitem group by 1")
def g3(s, d):
    rows = view(s, d, "lineitem").select(F.col("l_suppkey").alias("id"), F.concat("l_returnflag", "l_linestatus").alias("label"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey").alias("o"))
    return G.dedup_nodes(rows, ["id"], "o").select("id", "label")


@query("g3_merge_nodes", "select o_custkey as id, arg_min(o_orderpriority, o_orderkey) filter (o_orderstatus <> 'F') as label, arg_max(o_orderstatus, o_orderkey) as status, count(distinct 'k' || o_orderkey % 3) as n_extra from orders group by 1")
def g3b(s, d):
    rows = view(s, d, "orders").select(F.col("o_custkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderpriority")).alias("label"), F.create_map(F.lit("status"), F.col("o_orderstatus"), F.concat(F.lit("k"), F.col("o_orderkey") % 3), F.lit("x")).alias("properties"), F.col("o_orderkey").alias("o"))
    m = G.dedup_nodes(rows, ["id"], "o", "merge")
    return m.select("id", "label", F.element_at("properties", F.lit("status")).alias("status"), (F.size("properties") - 1).cast("bigint").alias("n_extra"))


@query("g4_frame_edges", sql("select distinct 'p' || key as src, relation, case relation when 'EXPRESSES' then 'm:' || label else 'd:' || floor(sec / 86400)::bigint end as dst from observations, (values ('EXPRESSES'), ('APPEARS_IN')) r(relation)", "observations"))
def g4(s, d):
    o = view(s, d, "observations")
    who = F.concat(F.lit("p"), "key").alias("src")
    says = o.select(who, F.lit("EXPRESSES").alias("relation"), F.concat(F.lit("m:"), "label").alias("dst"))
    return says.unionByName(o.select(who, F.lit("APPEARS_IN").alias("relation"), F.concat(F.lit("d:"), F.floor(F.col("sec") / 86400)).alias("dst"))).distinct()


@query("g5_first_edges", sql("select src, relation, (min({'ts': ts, 'dst': dst})).dst as dst from edges group by 1, 2", "edges"))
def g5(s, d):
    return G.first_edges(edges(s, d), ["src", "relation"], "ts", "dst").select("src", "relation", "dst")


KIND = {"click": "TALKS_TO", "purchase": "GIVES_TO"}


@query("g6_interaction_edges", sql("select src, dst, relation, count(*) as n from (select key as src, lead(key) over (order by frame) as dst, case label when 'click' then 'TALKS_TO' when 'purchase' then 'GIVES_TO' else 'INTERACTS_WITH' end as relation from observations) where src <> dst group by all", "observations"))
def g6(s, d):
    o = view(s, d, "observations")
    nxt = o.select((F.col("frame") - 1).alias("frame"), F.col("key").alias("dst"))
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in KIND.items() for x in kv]), F.col("label")), F.lit("INTERACTS_WITH"))
    return o.join(nxt, "frame").where("key <> dst").groupBy(F.col("key").alias("src"), "dst", kind.alias("relation")).agg(F.count(F.lit(1)).alias("n"))


@query("g7_cooccurrence", "with e as (select distinct l_orderkey as f, l_suppkey as s from lineitem) select a.s as a, b.s as b, count(*) as n from e a join e b on a.f = b.f and a.s < b.s group by 1, 2")
def g7(s, d):
    return G.cooccurrence(view(s, d, "lineitem"), "l_orderkey", "l_suppkey")


@query("g8_held_by", "select doc_id, source as holder from documents where contains(lower(text), lower('Licensed')) and lang = 'en'")
def g8(s, d):
    return view(s, d, "documents").where(F.contains(F.lower("text"), F.lit("licensed")) & (F.col("lang") == "en")).select("doc_id", F.col("source").alias("holder"))


@query("g9_triple_edges", "with t as (select l_orderkey as k, 'Supplier' as x, s_name as subject, lower(l_returnflag) || '-is ' || l_linestatus as predicate, case when l_linenumber % 2 = 0 then upper(p_name) else 'frame-' || l_linenumber end as object from lineitem join supplier on s_suppkey = l_suppkey join part on p_partkey = l_partkey), n as (select lower(trim(p_name)) as name, min('p' || p_partkey) as id from part group by 1), f as (select lower(trim(s_name)) as name, min('s' || s_suppkey) as id from supplier group by 1) select src, relation, dst, count(*) as n from (select f.id as src, upper(replace(replace(predicate, '-', '_'), ' ', '_')) as relation, n.id as dst from t join f on f.name = lower(trim(subject)) join n on n.name = lower(trim(object))) group by all")
def g9(s, d):
    sup, part = view(s, d, "supplier"), view(s, d, "part")
    t = view(s, d, "lineitem").join(sup, F.col("s_suppkey") == F.col("l_suppkey")).join(part, F.col("p_partkey") == F.col("l_partkey"))
    t = t.select(F.col("s_name").alias("subject"), F.concat(F.lower("l_returnflag"), F.lit("-is "), "l_linestatus").alias("predicate"), F.when(F.col("l_linenumber") % 2 == 0, F.upper("p_name")).otherwise(F.concat(F.lit("frame-"), "l_linenumber")).alias("object"))
    levels = [sup.select(F.col("s_name").alias("name"), F.concat(F.lit("s"), "s_suppkey").alias("id")), part.select(F.col("p_name").alias("name"), F.concat(F.lit("p"), "p_partkey").alias("id"))]
    return G.resolve_triples(t, levels).groupBy("src", "relation", "dst").agg(F.count(F.lit(1)).alias("n"))


@query("g10_sequence_edges", sql("with f as (select key, floor(sec / 86400)::bigint as scene, min(sec) as a, arg_min(label, sec) as mood, arg_min(length(label), sec) as tension from observations group by all), n as (select key, scene as src, lead(scene) over w as dst, lead(a) over w - a as gap, lead(mood) over w <> mood as shift, abs(lead(tension) over w - tension) as delta from f window w as (partition by key order by a, scene)) select key, src, dst, 'FOLLOWS' as relation, round(1 / greatest(gap, 1.0), 9) as weight from n where dst is not null union all select key, src, dst, 'EMOTIONAL_SHIFT', delta::double from n where shift", "observations"))
def g10(s, d):
    o = view(s, d, "observations").withColumn("scene", F.floor(F.col("sec") / 86400))
    return G.sequence_edges(o, "key", "scene", "sec", "label", F.length("label")).withColumn("weight", F.round("weight", 9))


def node_ids(s, d):
    return view(s, d, "part").where("p_size > 5").select(F.col("p_partkey").alias("id")).unionByName(view(s, d, "supplier").where("s_nationkey < 20").select(F.col("s_suppkey").alias("id"))).distinct()


IDS = "ids as (select p_partkey as id from part where p_size > 5 union select s_suppkey from supplier where s_nationkey < 20)"


@query("g11_merge_edges", sql(f"with {IDS} select src, relation, dst, arg_max(weight, {{'ts': ts, 'ok': ok, 'ln': ln, 'q': q, 'p': p}}) as weight from edges where src <> dst and src in (select id from ids) and dst in (select id from ids) group by 1, 2, 3", "edges"))
def g11(s, d):
    return G.merge_edges(edges(s, d), node_ids(s, d), ["ts", "ok", "ln", "q", "p"])[0]


@query("g11_missing_ends", sql(f"with {IDS} select relation, count(*) as missing from edges where src <> dst and (src not in (select id from ids) or dst not in (select id from ids)) group by 1", "edges"))
def g11b(s, d):
    return G.merge_edges(edges(s, d), node_ids(s, d), ["ts", "ok", "ln", "q", "p"])[1]


@query("g12_with_endpoints", sql("select src, dst, relation, s_name as src_label, p_name as dst_label, ok, ln, q from edges join supplier on s_suppkey = src join part on p_partkey = dst", "edges"))
def g12(s, d):
    a, b = view(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label")), view(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"))
    return G.with_endpoints(edges(s, d), a, b).select("src", "dst", "relation", "src_label", "dst_label", "ok", "ln", "q")


@query("g13_distinct_relations", sql("select distinct src, relation from edges", "edges"))
def g13(s, d):
    return edges(s, d).select("src", "relation").distinct()


def canon(s, d):
    mapping = s.createDataFrame([("A_F", "ENDED"), ("R_F", "ENDED"), ("N_O", "OPEN"), ("N_F", "MISSING")], "raw string, target string")
    return G.canonicalise(edges(s, d), mapping, s.createDataFrame([("ENDED",), ("OPEN",)], "relation string"))


CANON = "ca as (select *, case when relation in ('A_F', 'R_F') then 'ENDED' when relation = 'N_O' then 'OPEN' else 'OTHER' end as canonical from edges)"


@query("g14_canonicalise", sql(f"with {CANON} select count(*) as relations, round(avg((canonical = 'OTHER')::int), 6) as other_share from (select distinct relation, canonical from ca)", "edges"))
def g14(s, d):
    return G.other_share(canon(s, d)).withColumn("other_share", F.round("other_share", 6))


@query("g15_humanise", sql("select distinct relation, lower(replace(relation, '_', ' ')) as words from edges", "edges"))
def g15(s, d):
    return edges(s, d).select("relation", G.humanise(F.col("relation")).alias("words")).distinct()


@query("g16_canonical_edges", sql(f"with {CANON} select src, canonical, dst, count(*) as n, round(max(weight), 4) as weight from ca where canonical <> 'OTHER' group by 1, 2, 3", "edges"))
def g16(s, d):
    return canon(s, d).where("canonical <> 'OTHER'").groupBy("src", "canonical", "dst").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("weight"), 4).alias("weight"))


@query("g17_two_hop", "select distinct l_suppkey as who, o_custkey as scene from lineitem join orders on o_orderkey = l_orderkey")
def g17(s, d):
    return view(s, d, "lineitem").join(view(s, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("l_suppkey").alias("who"), F.col("o_custkey").alias("scene")).distinct()


@query("g18_object_trail", "select l_partkey as obj, o_custkey as scene, min(o_orderdate)::varchar as first_at from lineitem join orders on o_orderkey = l_orderkey group by 1, 2")
def g18(s, d):
    rows = view(s, d, "lineitem").join(view(s, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.groupBy(F.col("l_partkey").alias("obj"), F.col("o_custkey").alias("scene")).agg(F.min("o_orderdate").cast("string").alias("first_at"))


@query("g19_shared_neighbours", sql("with e as (select distinct src, dst from edges) select a.src as a, b.src as b, count(*) as n from e a join e b on a.dst = b.dst and a.src <> b.src where a.src % 100 = 0 group by 1, 2", "edges"))
def g19(s, d):
    return G.shared_neighbours(edges(s, d), F.col("src") % 100 == 0)


def links(s, d):
    """Customer k to the customers of the two next orders, as a sparse graph."""
    return view(s, d, "customer").select(F.col("c_custkey").alias("src"), ((F.col("c_custkey") * 7 + 3) % 1500).alias("dst"))


@query("g20_chain", "with recursive e as (select distinct c_custkey as src, (c_custkey * 7 + 3) % 1500 as dst from customer), r as (select src as start, dst as node, 1 as depth, [src || '>' || dst] as path from e where src % 100 = 0 union all select start, e.dst, depth + 1, list_append(path, e.src || '>' || e.dst) from r join e on e.src = r.node where depth < 6 and not list_contains(path, e.src || '>' || e.dst)) select distinct start, node, depth from r")
def g20(s, d):
    e = links(s, d)
    return G.chain(e, e.where("src % 100 = 0").select(F.col("src").alias("node")), 6)


@query("g21_arc", sql("select key, string_agg(label, '>' order by sec, frame) as arc from observations group by 1", "observations"))
def g21(s, d):
    o = view(s, d, "observations")
    return o.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sec", "frame", "label"))), lambda x: x["label"]), ">").alias("arc"))


@query("g22_degree", sql("select node, count(*) as degree from (select src as node from edges union all select dst from edges) group by 1", "edges"))
def g22(s, d):
    return G.degree(edges(s, d))


@query("g22_node_counts", sql("select node_type, count(*) as n from nodes group by 1", "nodes"))
def g22b(s, d):
    return view(s, d, "nodes").groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))


@query("g23_relation_stats", sql(f"with {CANON} select relation, canonical, count(*) as n from ca group by 1, 2", "edges"))
def g23(s, d):
    return canon(s, d).groupBy("relation", "canonical").agg(F.count(F.lit(1)).alias("n"))
