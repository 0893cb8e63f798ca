"""Steps whose tasks must not grow with the tables, or whose tables must be read once."""

import random
from itertools import combinations

import pytest
from conftest import SF
from pyspark.sql import functions as F

from tessera.operators import frames as O
from tessera.operators import graphs as G
from tessera.operators import spans as S
from tessera.plans import registry

QUERIES, _ = registry.load()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def test_cooccurrence_takes_more_partitions_for_more_rows(spark, monkeypatch):
    monkeypatch.setattr(G, "COOCCURRING", 10)
    rows = [(f, e) for f in range(20) for e in {f % 7, f % 5, f % 3}] + [(None, 1), (None, 2), (1, None), (2, 2), (2, 2)]
    out = G.cooccurrence(spark.createDataFrame(rows, "f int, e int"), "f", "e")
    want: dict = {}
    for f in range(20):
        for p in combinations(sorted({b for a, b in rows if a == f and b is not None}), 2):
            want[p] = want.get(p, 0) + 1
    assert {(r.a, r.b): r.n for r in out.collect()} == want
    assert out.rdd.getNumPartitions() == -(-len(rows) // 10)


@pytest.mark.parametrize(("name", "scans", "shuffles"), [("c6_hue_peaks", 1, 2), ("c26_sanitise", 1, 1)])
def test_tables_are_read_and_shuffled_once(spark, name, scans, shuffles):
    text = plan(QUERIES[name](spark, SF))
    assert text.count("FileScan parquet") == scans and text.count("Exchange hashpartitioning") <= shuffles


def test_sample_points_are_not_shuffled(spark):
    ends = spark.createDataFrame([(1, 0.5, 4.0), (1, 3.0, 5.5), (2, 0.2, 0.7), (None, 1.0, 2.0)], "k int, a double, b double")
    forced = spark.createDataFrame([(1, 2.0), (1, 2.5), (1, 2.5), (1, None), (3, -0.0), (None, 2.0), (3, float("nan"))], "k int, at double")
    out = S.sample_points(ends, "k", "a", "b", forced)
    got = sorted((str(tuple(r)) for r in out.collect()))
    want = [(1, 1.0, False), (1, 2.0, True), (1, 3.0, False), (1, 4.0, False), (1, 5.0, False), (1, 2.5, True), (1, None, True), (3, 0.0, True), (3, float("nan"), True), (None, 1.0, False), (None, 2.0, True)]
    assert got == sorted(str(r) for r in want)
    assert plan(out).count("Exchange hashpartitioning") == 1
    twos = S.sample_points(ends.where("k = 1"), "k", "a", "b", forced.where("k = 1"), 2)
    assert sorted(r.at for r in twos.where(F.col("at").isNotNull()).collect()) == [2.0, 2.5, 4.0]


def labels(scenes: list[tuple]) -> list[tuple]:
    """By key, frame by frame."""
    out, last = [], {}
    for k, start, end in sorted(scenes):
        if k in last:
            out += [(k, f, int(f == (last[k] + start) // 2), 1) for f in range(last[k], start + 1)]
        last[k] = end
    return sorted(out)


def test_frame_labels_of_transitions_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(O, "LABELS", 5)
    scenes = [(1, -9, -8), (1, -3, -3), (1, -2, 0), (1, 4, 7), (1, 8, 8), (1, 16, 30), (2, 5, 6), (3, 0, 3), (3, 31, 32)]
    out = O.frame_labels(spark.createDataFrame(scenes, "k long, start_frame long, end_frame long"), "k", 4)
    want = labels(scenes)
    assert sorted(tuple(r) for r in out.collect()) == want
    assert out.rdd.getNumPartitions() == -(-len(want) // 5)
    assert O.frame_labels(spark.createDataFrame(scenes[:0], "k long, start_frame long, end_frame long"), "k").count() == 0


def test_frame_labels_take_little_room_in_files(spark, tmp_path):
    draw, scenes = random.Random(3), []
    for k in range(60):
        at = sorted(draw.sample(range(9000), 24))
        scenes += [(k, a, b) for a, b in zip(at[::2], at[1::2])]
    O.frame_labels(spark.createDataFrame(scenes, "k long, start_frame long, end_frame long"), "k").write.parquet(str(tmp_path / "labels"))
    rows = spark.read.parquet(str(tmp_path / "labels"))
    assert sorted(tuple(r) for r in rows.collect()) == labels(scenes)
    # in order of key and frame a label takes nearly two bytes here
    assert sum(f.stat().st_size for f in (tmp_path / "labels").glob("*.parquet")) < rows.count()
