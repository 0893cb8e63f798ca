"""Rows of a stream, key by key in order of time, whatever order they come in.

Rows wait in a list of state, in bundles, until the watermark has passed them: from then on none can come before them. They
then go in order through a function that has the key's state, and a timer is set for the next row that waits, or for the silence
after which the key is forgotten. So a row that is late by less than the watermark's delay takes its place, one that is
later is left out by Spark, and a key that has fallen silent leaves nothing behind. State is kept by RocksDB, on disk, for
buckets of keys; of a bucket, the rows of one delay are in memory at once.
"""

from __future__ import annotations

import math
import pickle
import sys
from collections.abc import Callable, Iterator
from operator import itemgetter
from types import SimpleNamespace

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Microseconds of the row's time and its bucket, under names that callers don't use.
US, BUCKET = "__us", "__bucket"
#: Buckets of keys, and rows in one entry of the list of state at most. State is asked for over a socket, and a call for each
#: row or key would take most of the time; a bucket's keys that are not forgotten are written again when one of them moves.
BUCKETS, BUNDLE = 1024, 4096


class InOrder(StatefulProcessor):
    """See in_order(). Of a row, the key comes first and US last; of an entry of ``at``, the key first and its end last."""

    def __init__(self, names: list[str], rows: str, state: str, out: list[str], order: list[str], push: Callable, wait: Callable, flush: Callable | None):
        self.names, self.schema, self.state, self.out = names, rows, state, out
        self.by = [names.index(c) for c in order]
        self.push, self.wait, self.flush = push, wait, flush

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.at = handle.getListState("at", self.state)
        self.done = set()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            # by place, after the bucket: names that Python doesn't take are not kept
            new = list(zip(*(frame.iloc[:, i].tolist() for i in range(1, len(self.names) + 1))))
            for i in range(0, len(new), BUNDLE):
                self.waiting.appendValue((pickle.dumps(new[i : i + BUNDLE]),))
            least = min(r[-1] for r in new)
            first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if key in self.done:  # several timers of a bucket run out at one watermark
            return iter(())
        self.done.add(key)
        passed = timerValues.getCurrentWatermarkInMs()
        rows = [r for (bundle,) in self.waiting.get() for r in pickle.loads(bundle)] if self.waiting.exists() else []
        due, rest = [r for r in rows if r[-1] <= passed * 1000], [r for r in rows if r[-1] > passed * 1000]
        due.sort(key=itemgetter(*self.by))
        held = {k: (at, ends) for k, *at, ends in self.at.get()} if self.at.exists() else {}
        now, out = {}, []
        for r in due:
            k = r[0]
            now[k], more = self.push(now[k] if k in now else list(held[k][0]) if k in held else None, SimpleNamespace(**dict(zip(self.names, r))))
            out += more
        ended = held | {k: (at, math.ceil(round(self.wait(at), 3))) for k, at in now.items()}
        live = {k: (at, ends) for k, (at, ends) in ended.items() if ends > passed}
        if self.flush:
            for k, (at, ends) in ended.items():
                out += self.flush(k, at) if ends <= passed else []
        if due and rest:
            self.waiting.put([(pickle.dumps(rest[i : i + BUNDLE]),) for i in range(0, len(rest), BUNDLE)])
        elif due:
            self.waiting.clear()
        if live and (now or len(live) < len(held)):
            self.at.put([(k, *at, ends) for k, (at, ends) in live.items()])
        elif held and not live:
            self.at.clear()
        if live or rest:
            self.handle.registerTimer(min([-(-r[-1] // 1000) for r in rest] + [ends for _, ends in live.values()]))
        return iter([pd.DataFrame(out, columns=self.out)] if out else ())

    def close(self) -> None:
        pass


def on_disk(spark: SparkSession) -> None:
    """State of this session's streams in RocksDB, which keeps lists and timers; a provider of the user's own stays."""
    if "HDFSBacked" in spark.conf.get(PROVIDER):
        spark.conf.set(PROVIDER, ROCKSDB)


def by_value(*modules: str) -> None:
    """Send what these modules define along with the functions that use it: the worker on the driver in which Spark sets up
    a query's state gets none of the files that the application was given."""
    for name in modules:
        if name != "__main__":
            register_pickle_by_value(sys.modules[name])


def in_order(stream: DataFrame, key: str, order: list[str], columns: list[str], ts: str, late: str, result: str, state: str, push: Callable, wait: Callable, flush: Callable | None = None) -> DataFrame:
    """Rows of each key through ``push(state, row)``, which gives the new state and the rows to put out; state: a list as
    ``state`` has it, or None at first. Rows come in order of ``order``, which must not go against ``ts``, once the
    watermark, ``late`` behind the newest ``ts``, has passed them. When it has passed ``wait(state)`` (milliseconds since
    the epoch), the key puts out ``flush(key, state)`` and is forgotten. ``push`` and ``flush`` get the key as text and put
    it out first."""
    on_disk(stream.sparkSession)
    by_value(__name__, *(f.__module__ for f in (push, wait, flush) if f))
    kind = stream.schema[key].dataType
    rows = stream.withWatermark(ts, late).withColumn(US, F.unix_micros(ts)).withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(BUCKETS)))
    # as text, a null key next to whole numbers stays what it is
    rows = rows.withColumn(key, F.col(key).cast("string"))
    names = list(dict.fromkeys([key, *order, *columns, US]))
    out = [f.split()[0] for f in result.split(", ")]
    processor = InOrder(names, "bundle binary", f"__key string, {state}, __ends bigint", out, order, push, wait, flush)
    result = ", ".join([f"{key} string", *result.split(", ")[1:]])
    # frames, as Row objects are made cell by cell
    put = rows.select(BUCKET, *names, ts).groupBy(BUCKET).transformWithStateInPandas(processor, result, "Append", "EventTime")
    return put.withColumn(key, F.col(key).cast(kind))
