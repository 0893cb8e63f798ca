"""Queries for table maintenance. The state is ``customer`` or ``orders``; changes come from other rows of the same table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import maintain as M
from .registry import query
from .views import view

CUR = "cur as (select c_custkey as k, c_nationkey as n, c_acctbal as b, c_mktsegment as m from customer where c_custkey % 3 <> 0), new as (select c_custkey as k, c_nationkey + 100 as n, case when c_custkey % 4 = 0 then null else c_acctbal * 2 end as b, 'NEW' as m from customer where c_custkey % 2 = 0)"


def cur(s, d):
    return view(s, d, "customer").where("c_custkey % 3 <> 0").selectExpr("c_custkey k", "c_nationkey n", "c_acctbal b", "c_mktsegment m")


def new(s, d):
    return view(s, d, "customer").where("c_custkey % 2 = 0").selectExpr("c_custkey k", "c_nationkey + 100 n", "case when c_custkey % 4 = 0 then null else c_acctbal * 2 end b", "'NEW' m")


@query("w1_upsert", f"with {CUR} select * from new union all select * from cur where k not in (select k from new)")
def w1(s, d):
    return M.upsert(cur(s, d), new(s, d), ["k"])


@query("w2_upsert_coalesce", f"with {CUR} select coalesce(new.k, cur.k) as k, coalesce(cur.n, new.n) as n, coalesce(new.b, cur.b) as b, coalesce(new.m, cur.m) as m from cur full join new using (k)")
def w2(s, d):
    return M.upsert(cur(s, d), new(s, d), ["k"], coalesce=("b",), keep=("n",))


@query("w3_insert_ignore", f"with {CUR} select * from cur union all select * from new where k not in (select k from cur)")
def w3(s, d):
    return M.insert_ignore(cur(s, d), new(s, d), ["k"])


@query("w4_upsert_if", f"with {CUR}, held as (select k from cur where b >= 0) select *, false as refused from (select * from new where k not in (select k from held) union all select * from cur where k not in (select k from new where k not in (select k from held))) union all select *, true from new where k in (select k from held)")
def w4(s, d):
    state, refused = M.upsert_if(cur(s, d), new(s, d), ["k"], F.col("b") < 0)
    return state.withColumn("refused", F.lit(False)).unionByName(refused.withColumn("refused", F.lit(True)))


@query("w5_dedup_latest", "select o_custkey, o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) where rn = 1")
def w5(s, d):
    return M.dedup_latest(view(s, d, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("w6_cascade_delete", "with c as (select * from customer where c_nationkey >= 5), o as (select * from orders where o_custkey not in (select c_custkey from customer where c_nationkey < 5)), l as (select * from lineitem where l_orderkey not in (select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_nationkey < 5))) select 'customer' as tbl, count(*) as n from c union all select 'orders', count(*) from o union all select 'lineitem', count(*) from l")
def w6(s, d):
    doomed = view(s, d, "nation").where("n_nationkey < 5").select(F.col("n_nationkey").alias("id"))
    names, chain = ("customer", "orders", "lineitem"), [(view(s, d, "customer"), "c_nationkey", "c_custkey"), (view(s, d, "orders"), "o_custkey", "o_orderkey"), (view(s, d, "lineitem"), "l_orderkey", "l_linenumber")]
    out = None
    for name, left in zip(names, M.cascade_delete(doomed, chain)):
        row = left.agg(F.count(F.lit(1)).alias("n")).withColumn("tbl", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query("w7_merge_maps", "select o_orderkey, o_orderstatus as status, 'new' as src, o_orderpriority as priority from orders")
def w7(s, d):
    o = view(s, d, "orders")
    old, fresh = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("src"), F.lit("old")), F.create_map(F.lit("src"), F.lit("new"), F.lit("priority"), F.col("o_orderpriority"))
    m = o.select("o_orderkey", M.merge_maps(old, fresh).alias("m"))
    return m.select("o_orderkey", *[F.element_at("m", F.lit(k)).alias(k) for k in ("status", "src", "priority")])


VERSIONS = "v as (select o_custkey as k, row_number() over (partition by o_custkey order by o_orderkey) as version, case when o_orderstatus = 'F' then 'final' when o_orderstatus = 'O' then 'draft' else 'other' end as status, o_totalprice as price from orders)"


def versions(s, d):
    from pyspark.sql import Window

    status = F.when(F.col("o_orderstatus") == "F", "final").when(F.col("o_orderstatus") == "O", "draft").otherwise("other")
    return view(s, d, "orders").select(F.col("o_custkey").alias("k"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("version"), status.alias("status"), F.col("o_totalprice").alias("price"))


@query("w8_latest", f"with {VERSIONS} select * from v qualify row_number() over (partition by k order by version desc) = 1")
def w8(s, d):
    return M.latest(versions(s, d), ["k"], "version")


@query("w8_latest_final", f"with {VERSIONS} select * from v where status = 'final' qualify row_number() over (partition by k order by version desc) = 1")
def w8b(s, d):
    return M.latest(versions(s, d), ["k"], "version", F.col("status") == "final")


@query("w9_next_version", f"with {VERSIONS} select k, version + (status <> 'draft')::int as next from v qualify row_number() over (partition by k order by version desc) = 1")
def w9(s, d):
    return M.next_version(versions(s, d), ["k"], "version", "status")


@query("w10_audit", "select 'lineitem' as \"table\", 'unique l_orderkey,l_linenumber' as rule, count(*) as n from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1) union all select 'lineitem', 'refers l_partkey', count(*) from lineitem where l_partkey not in (select p_partkey from part where p_size < 40) union all select 'lineitem', 'allowed l_returnflag', count(*) from lineitem where l_returnflag not in ('A', 'N') union all select 'lineitem', 'range l_quantity', count(*) from lineitem where l_quantity not between 2 and 49")
def w10(s, d):
    return M.audit(view(s, d, "lineitem"), "lineitem", ["l_orderkey", "l_linenumber"], {"l_partkey": (view(s, d, "part").where("p_size < 40"), "p_partkey")}, {"l_returnflag": ["A", "N"]}, {"l_quantity": (2, 49)})


@query("w11_clone", "select sha256(o_orderkey || ':copy') as o_orderkey, sha256(o_custkey || ':copy') as o_custkey, o_orderstatus, c_mktsegment from orders join customer on c_custkey = o_custkey where c_nationkey = 3")
def w11(s, d):
    c = view(s, d, "customer").where("c_nationkey = 3")
    o = view(s, d, "orders").join(c.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    mine = M.clone(c, ["c_custkey"], "copy")
    return M.clone(o, ["o_orderkey", "o_custkey"], "copy").join(mine, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "o_orderstatus", "c_mktsegment")


@query("w12_reset_level", "select o_orderkey, case when o_orderstatus in ('F', 'P') then 'pending' else o_orderstatus end as status from orders")
def w12(s, d):
    o = view(s, d, "orders")
    return o.select("o_orderkey", F.when(F.col("o_orderstatus").isin("F", "P"), "pending").otherwise(F.col("o_orderstatus")).alias("status"))


@query("w13_update_status", "select o_orderkey as k, case when o_orderkey % 2 = 0 then case when o_orderkey % 4 = 0 then 'running' else 'done' end else 'queued' end as status, case when o_orderkey % 4 = 0 then o_orderdate end as started, case when o_orderkey % 4 = 2 then o_orderdate end as completed from orders")
def w13(s, d):
    o = view(s, d, "orders")
    jobs = o.select(F.col("o_orderkey").alias("k"), F.lit("queued").alias("status"), F.lit(None).cast(o.schema["o_orderdate"].dataType).alias("started"), F.lit(None).cast(o.schema["o_orderdate"].dataType).alias("completed"))
    changes = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 4 == 0, "running").otherwise("done").alias("status"), F.col("o_orderdate").alias("at"))
    return M.update_status(jobs, changes, "k")


@query("w14_remap", "select l_orderkey, l_linenumber, l_quantity, case when l_partkey % 5 = 0 then l_partkey + 1000000 else l_partkey end as l_partkey from lineitem")
def w14(s, d):
    m = view(s, d, "part").where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("old"), (F.col("p_partkey") + 1000000).alias("new"))
    return M.remap(view(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey"), m, "l_partkey")


OV = "ov as (select o_custkey as c_custkey, 'c_mktsegment' as field, o_orderpriority as value, o_orderkey as o from orders where o_orderkey % 3 = 0 union all select o_custkey, 'c_name', 'name-' || o_orderkey, o_orderkey from orders where o_orderkey % 5 = 0)"


def ov(s, d):
    o = view(s, d, "orders")
    a = o.where("o_orderkey % 3 = 0").selectExpr("o_custkey c_custkey", "'c_mktsegment' field", "o_orderpriority value", "o_orderkey o")
    return a.unionByName(o.where("o_orderkey % 5 = 0").selectExpr("o_custkey c_custkey", "'c_name' field", "concat('name-', o_orderkey) value", "o_orderkey o"))


@query("w15_apply_overrides", f"with {OV}, m as (select c_custkey, field, arg_max(value, o) as v from ov group by all) select c.c_custkey, coalesce(a.v, c.c_name) as c_name, coalesce(b.v, c.c_mktsegment) as c_mktsegment from customer c left join m a on a.c_custkey = c.c_custkey and a.field = 'c_name' left join m b on b.c_custkey = c.c_custkey and b.field = 'c_mktsegment'")
def w15(s, d):
    return M.apply_overrides(view(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), ov(s, d), "c_custkey", ["c_name", "c_mktsegment"], "o")


@query("w15_correction_events", f"with {OV}, own as (select c_custkey, 'c_name' as field, c_name as own from customer union all select c_custkey, 'c_mktsegment', c_mktsegment from customer) select ov.c_custkey, ov.field, coalesce(lag(value) over (partition by ov.c_custkey, ov.field order by o), own) as before, value as after, o from ov join own using (c_custkey, field)")
def w15b(s, d):
    return M.correction_events(view(s, d, "customer"), ov(s, d), "c_custkey", ["c_name", "c_mktsegment"], "o")


@query("w16_merge_report", f"with {CUR} select 'customer' as \"table\", count(*) filter (k not in (select k from cur)) as inserted, count(*) filter (k in (select k from cur)) as updated from new")
def w16(s, d):
    return M.merge_report({"customer": (cur(s, d), new(s, d), ["k"])})
