"""The table that micro-batches keep up: equal to a scan in order, written in proportion to the batch, safe to run again."""

import os
import random

import pytest

from tessera.streaming.merge import KeyedTable

SCHEMA = "k int, o long, v string"


def rows_of(table):
    return {r.k: (r.o, r.v) for r in table.read().collect()}


def files(folder):
    return {os.path.join(p, n): os.path.getsize(os.path.join(p, n)) for p, _, names in os.walk(folder) for n in names}


def batches(seed, n=12, keys=40):
    rng = random.Random(seed)
    return [[(rng.randrange(keys), rng.randrange(10**6), f"{i}-{j}") for j in range(rng.choice((0, 1, 3, 30)))] for i in range(n)]


@pytest.mark.parametrize("most,share", [(16, 0.5), (2, 100.0), (1, 0.01)])
def test_equals_a_scan_in_order(spark, tmp_path, most, share):
    table = KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, ["k"], "o", buckets=4, share=share, most=most)
    want = {}
    assert rows_of(table) == {}
    for n, batch in enumerate(batches(most)):
        table.merge(spark.createDataFrame(batch, SCHEMA), n)
        want |= {k: (o, v) for k, o, v in sorted(batch, key=lambda r: r[1])}
        if n % 4 == 3 or n == 2:
            assert rows_of(table) == want
    assert rows_of(table) == want
    assert len(os.listdir(tmp_path / "t" / "manifest")) == 2


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, ["k"], "o", buckets=3, most=2)
    frames = [spark.createDataFrame(b, SCHEMA) for b in batches(5, 6)]
    for n, f in enumerate(frames):
        table.merge(f, n)
        once = rows_of(table)
        table.merge(f, n)
        assert rows_of(table) == once


def test_a_batch_that_failed_on_its_way_is_not_seen(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, ["k"], "o", buckets=2, share=0.1)
    first, second = spark.createDataFrame([(i, 1, "old") for i in range(20)], SCHEMA), spark.createDataFrame([(i, 0, "new") for i in range(15, 25)], SCHEMA)
    table.merge(first, 0)
    before, write, calls = rows_of(table), table._write, []

    def breaks(rows, to):
        calls.append(to)
        if to.startswith("base"):
            raise OSError("lost")
        return write(rows, to)

    monkeypatch.setattr(table, "_write", breaks)
    with pytest.raises(OSError):
        table.merge(second, 1)
    assert calls == ["delta/1", "base/1"] and rows_of(table) == before
    monkeypatch.undo()
    table.merge(second, 1)
    assert rows_of(table) == before | {i: (0, "new") for i in range(15, 25)}


def test_what_is_written_follows_the_batch(spark, tmp_path):
    folder = str(tmp_path / "t")
    table = KeyedTable(spark, f"file://{folder}", SCHEMA, ["k"], "o", buckets=16)
    table.merge(spark.range(200_000).selectExpr("cast(id as int) k", "id o", "sha2(cast(id as string), 256) v"), 0)
    base = files(folder)
    for n, size in ((1, 5), (2, 5), (3, 500)):
        before = files(folder)
        table.merge(spark.createDataFrame([(7 * i, n, f"new {n} {i}") for i in range(size)], SCHEMA), n)
        new = {f: s for f, s in files(folder).items() if f not in before and f.endswith(".parquet")}
        assert len(new) <= min(size, 16) and sum(new.values()) < 2500 * min(size, 16) + 40 * size
    assert sum(base.values()) > 8_000_000 and set(base) - {f for f in base if "manifest" in f} <= set(files(folder))
    kept = rows_of(table)
    assert len(kept) == 200_000 and kept[7] == (3, "new 3 1") and kept[1][0] == 1


def test_as_a_sink_of_a_stream(spark, tmp_path):
    for i, batch in enumerate(batches(9, 4)):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    table = KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, ["k"], "o", buckets=4)
    source = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    source.writeStream.foreachBatch(table.sink()).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    assert set(rows_of(table)) == {r[0] for b in batches(9, 4) for r in b}
