"""Ordered state: rows swapped between micro-batches give what the batch twin gives, and silence leaves no state."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import spans as B
from tessera.plans.streams import folder
from tessera.streaming import ordered
from tessera.streaming import spans as T

SCHEMA = "k int, i long, sec double, label string, v double"
END = (99, 10**6, 1e7, "z", 1.0)


@pytest.fixture
def run(spark, tmp_path):
    """A stream of the batches, one file each: what it puts out, and how many rows of state stay."""

    def go(batches, op, schema=SCHEMA):
        for i, b in enumerate(batches):
            spark.createDataFrame(b, schema).withColumn("ts", F.timestamp_millis(F.round(F.col("sec") * 1000).cast("bigint"))).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i:03}"))
        source = spark.readStream.schema(schema + ", ts timestamp").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = folder(spark)
        stream = op(source)
        stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start(out).awaitTermination()
        held = {name: spark.read.format("statestore").option("stateVarName", name).load(f"{out}-log").select("key.*").distinct().count() for name in ("at", "waiting")}
        return spark.read.schema(stream.schema).parquet(out), held

    return go


def observations(seed=1, keys=6, n=60):
    """Rows in order by key; seconds go up by less than the delay, or by a long silence."""
    rng, out = random.Random(seed), []
    for k in range(keys):
        sec = 1000.0
        for i in range(n):
            sec = round(sec + rng.choice([0.001, 0.5, 3.0, 3.0, 500.0]), 3)
            out.append((k, i, sec, rng.choice("aab"), rng.choice([0.1, 0.5, 0.6, 0.9])))
    return out


def swapped(rows, parts=3, late=40.0):
    """The rows dealt into batches in which up to ``late`` seconds come in any order, then a row far ahead that closes all."""
    rng = random.Random(7)
    mixed = sorted(rows, key=lambda r: r[2] + rng.uniform(0, late))
    size = -(-len(mixed) // parts)
    return [mixed[a : a + size] for a in range(0, len(mixed), size)] + [[END]]


def listed(df, *cols):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())


LATE = "41 seconds"


def test_a_late_row_takes_its_place(run):
    batches = [[(1, 0, 10.0, "a", 1.0), (1, 1, 20.0, "a", 1.0)], [(1, 2, 15.0, "b", 1.0)], [(1, 3, 25.0, "a", 1.0)], [END]]
    got, held = run(batches, lambda s: T.open_spans(s, "k", "sec", "label", 60.0, late=LATE))
    assert listed(got, "label", "start_s", "end_s", "n") == [("a", 10.0, 15.0, 1), ("a", 20.0, 25.0, 2), ("b", 15.0, 20.0, 1)]
    assert held == {"at": 0, "waiting": 1}


def test_a_row_that_comes_after_the_watermark_is_left_out(run):
    # what is late is told by the watermark of the batch before
    batches = [[(1, 0, 1000.0, "a", 1.0)], [(2, 0, 1100.0, "a", 1.0)], [(2, 1, 1101.0, "a", 1.0)], [(1, 1, 1050.0, "b", 1.0)], [END]]
    got, _ = run(batches, lambda s: T.open_spans(s, "k", "sec", "label", 60.0, late=LATE))
    assert listed(got, "k", "label", "n") == [(1, "a", 1), (2, "a", 2)]


def test_spans_of_swapped_batches(spark, run):
    rows = observations()
    got, held = run(swapped(rows), lambda s: T.open_spans(s, "k", "sec", "label", 60.0, late=LATE))
    want = B.spans(spark.createDataFrame(rows, SCHEMA), "k", "sec", "label", "v", 60.0)
    assert listed(got, "k", "label", "start_s", "end_s", "n") == listed(want, "k", "label", "start_s", "end_s", "n")
    assert held["at"] == 0


@pytest.mark.parametrize("mode", ["majority", "ema", "hybrid"])
def test_smoothing_of_swapped_batches(spark, run, mode):
    rows = observations(2)
    got, held = run(swapped(rows), lambda s: T.smooth_stream(s, "k", "i", "sec", "label", "v", mode, ["a", "b"], 1e5, late=LATE))
    want = B.smooth(spark.createDataFrame(rows, SCHEMA), "k", "i", "label", "v", mode, ["a", "b"])
    assert listed(got, "k", "i", "smoothed") == listed(want, "k", "i", "smoothed")
    assert held["at"] == 0


def test_votes_of_swapped_batches(spark, run):
    rows = observations(3)
    got, held = run(swapped(rows), lambda s: T.vote_stream(s, "k", "i", "sec", "label", "v", 1e5, late=LATE))
    want = B.identity_vote(spark.createDataFrame(rows, SCHEMA), "k", "i", "label", "v")
    assert listed(got, "k", "i", "voted", "vote_mean") == listed(want, "k", "i", "voted", "vote_mean")
    assert held["at"] == 0


def test_silence_forgets_votes(run):
    rows = [(1, i, 10.0 + i, "a", 1.0) for i in range(4)] + [(1, 4, 500.0, "b", 1.0)]
    got, _ = run([rows, [END]], lambda s: T.vote_stream(s, "k", "i", "sec", "label", "v", 100.0, late=LATE))
    assert [v for _, v in listed(got, "i", "voted")] == ["a"] * 4 + ["b"]


def test_cuts_of_swapped_batches(spark, run):
    rng = random.Random(4)
    hist = lambda k, i: [float(x) for x in ([9, 1, 1, 0] if i // 11 % 2 else [0, 1, 8, 9])] if i % 5 else [rng.random() for _ in range(4)]
    rows = [(*r, hist(*r[:2])) for r in observations(5)]
    schema = SCHEMA + ", hist array<double>"
    batches = swapped(rows)
    batches[-1] = [(*END, [1.0, 2.0, 3.0, 4.0])]
    got, held = run(batches, lambda s: T.cut_stream(s, "k", "i", "sec", "hist", 7, 1e5, least=10**6, late=LATE), schema)
    want = B.histogram_cuts(spark.createDataFrame(rows, schema), "k", "i", "hist", 0.35, 7)
    assert listed(got, "k", "i", "score") == listed(want, "k", "i", "score") and held["at"] == 0


def test_changes_of_swapped_batches(spark, run):
    rows = observations(6)
    got, held = run(swapped(rows), lambda s: T.emit_changes_stream(s, "k", "sec", "label", 5.0, late=LATE))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("forced", F.lit(False))
    want = B.emit_changes(df, "k", "sec", "label", "forced", 5.0)
    assert listed(got, "k", "sec", "label") == listed(want, "k", "sec", "label") and held["at"] == 0


def test_processors_need_no_package_on_the_path():
    import subprocess
    import sys

    from pyspark import cloudpickle

    processor = ordered.InOrder(["k"], "k int", "n int", ["k"], ["k"], lambda at, row: (B.Smoother("ema", ["a"]), B.Vote()), T.open_spans, None)
    ordered.by_value(ordered.__name__, T.__name__, __name__)
    out = subprocess.run([sys.executable, "-c", "import pickle, sys; p = pickle.loads(sys.stdin.buffer.read()); print(p.push(None, None)[1].labels)"], input=cloudpickle.dumps(processor), cwd="/", env={"PATH": "/usr/bin:/bin"}, capture_output=True)
    assert out.stdout.strip() == b"[]", out.stderr[-500:]


def test_state_is_kept_by_bucket_and_keys_stay_what_they_are(run, monkeypatch):
    monkeypatch.setattr(ordered, "BUCKETS", 2)
    keys = [None, 2**53 + 1, *range(30)]
    got, held = run([[(k, i, 10.0 + i, "a", 1.0) for k in keys for i in range(3)], [END], [(k, 9, 1.1e7, "a", 1.0) for k in keys]], lambda s: T.open_spans(s, "k", "sec", "label", 60.0, late=LATE), SCHEMA.replace("k int", "k long"))
    assert sorted(got.where("label = 'a'").select("k", "n").collect(), key=str) == sorted([(k, 3) for k in keys], key=str)
    assert held["waiting"] <= 2 and held["at"] == 0
