"""Inverted lists: recall against the exact search, what is read of the disk, odd vectors."""

import uuid

import numpy as np
import pytest

from tessera.operators import lists as L
from tessera.operators import picks as P
from tessera.operators.shared import shared_dir

SCHEMA = "vec_id long, embedding array<double>"


def table(spark, n, groups=60, dim=24, seed=0, spread=0.45):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    x = centres[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dim))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)


def folder(spark):
    return f"{shared_dir(spark)}/lists-{uuid.uuid4().hex}"


@pytest.fixture(scope="module")
def large(spark):
    df = table(spark, 20_000).repartition(8).persist()
    index = L.build_lists(df, folder(spark), "vec_id")
    yield df, index
    df.unpersist()


def test_recall_and_share_read_on_20000_vectors(large):
    df, index = large
    assert len(index.centres) == L.list_count(20_000) == 141 and index.total == 20_000
    q = df.where("vec_id % 100 = 7")
    curve = L.recall_curve(index, q, df, 10, "vec_id", "vec_id")
    probes, recall, share = L.fewest_probes(curve, 0.95)
    assert recall >= 0.95 and share < 0.25
    exact = {(r.query, r.id) for r in P.knn(q, df, 10, "vec_id", "vec_id").collect()}
    got = L.search_lists(index, q, 10, "vec_id", probes).collect()
    assert len({(r.query, r.id) for r in got} & exact) / len(exact) == pytest.approx(recall, abs=1e-9)
    assert sorted({r.rank for r in got}) == list(range(1, 11))
    rows = [r for r in curve.orderBy("probes").collect()]
    assert rows[-1].recall == 1.0 and rows[-1].share_read == pytest.approx(1.0) and [r.recall for r in rows] == sorted(r.recall for r in rows)


def test_only_the_probed_lists_are_read(large):
    df, index = large
    one = L.search_lists(index, df.where("vec_id = 5"), 3, "vec_id", 2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [list" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert one.count() == 3
    assert index.rows.where("list = 3").count() == index.counts[3]


def test_all_lists_give_the_exact_result(spark):
    df = table(spark, 300)
    index = L.build_lists(df, folder(spark), "vec_id", lists=9)
    q = df.where("vec_id % 50 = 0")
    assert sorted(map(tuple, L.search_lists(index, q, 4, "vec_id", 9).collect())) == sorted((r.query, r.id, r.score, r["rank"]) for r in P.knn(q, df, 4, "vec_id", "vec_id").collect())


def test_more_queries_than_a_pass(spark, monkeypatch):
    monkeypatch.setattr(P, "PASS", 40)
    df = table(spark, 300)
    index = L.build_lists(df, folder(spark), "vec_id", lists=9)
    few = sorted(map(tuple, L.search_lists(index, df, 2, "vec_id", 9).collect()))
    assert few == sorted((r.query, r.id, r.score, r["rank"]) for r in P.knn(df, df, 2, "vec_id", "vec_id").collect())


def test_odd_vectors(spark):
    rows = [(0, [0.0, 0.0]), (1, None), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 2.0]), (5, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, SCHEMA)
    index = L.build_lists(df, folder(spark), "vec_id", lists=2)
    assert index.total == 5
    got = {(r.query, r.id) for r in L.search_lists(index, df.where("vec_id < 3"), 1, "vec_id", 2).collect()}
    assert got == {(0, 2), (2, 3)}
    none = L.build_lists(df.limit(0), folder(spark), "vec_id")
    assert none.total == 0 and L.search_lists(none, df, 1, "vec_id", 1).count() == 0
    assert L.fewest_probes(L.recall_curve(none, df, df.limit(0), 1, "vec_id", "vec_id"))[0] == 1


def test_a_block_of_rows_with_all_their_lists_is_bounded(spark):
    import pyarrow as pa

    class Sent:
        value = np.eye(64).repeat(8, axis=0)

    part = pa.RecordBatch.from_arrays([pa.array(range(2048)), pa.array(np.random.default_rng(1).normal(size=(2048, 64)).tolist())], ["query", "q"])
    sizes = [b.num_rows for b in L._nearest(Sent, 512)([part])]
    assert sum(sizes) == 2048 * 512 and max(sizes) * 64 <= L.OUT
