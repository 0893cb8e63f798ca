"""Observation operators on streams. Each gives, on a stream that ends, what its batch twin gives on the rows that the
watermark has passed, whatever order they came in; release_in_order() takes rows as they come."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.spans import Smoother, Vote
from .ordered import by_value, in_order

by_value(Smoother.__module__)


def sessions(stream: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """(key, start_at, end_at, n): sessions of a key closed by ``gap`` without observation."""
    rows = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(key, F.col("w.start").alias("start_at"), F.col("w.end").alias("end_at"), "n")


def period_counts(stream: DataFrame, keys: list[str], ts: str, size: str, late: str, slide: str | None = None) -> DataFrame:
    """(keys, start_at, n, mean, p95) of ``value`` by tumbling or sliding window."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    rows = stream.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.approx_percentile("value", F.lit(0.95), F.lit(10000)).alias("p95"))
    return rows.select(*keys, F.col("w.start").alias("start_at"), "n", "mean", "p95")


def distinct_events(stream: DataFrame, ids: list[str], ts: str, late: str) -> DataFrame:
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(ids)


def _as_they_come(stream: DataFrame, key: str, order: list[str], columns: list[str], ts: str, late: str, result: str, state: str, push, wait, flush=None) -> DataFrame:
    """Rows of each key, those of a micro-batch in order, through ``push(state, row)``, which gives the new state and the rows to put out; state: a
    list, or None at first. A key whose state hasn't changed for ``wait(state)`` (milliseconds since the epoch; the
    watermark, ``late`` behind the newest ``ts``, has passed it) puts out ``flush(state)`` and is forgotten, so what is kept
    is the keys of late."""
    names = [f.split()[0] for f in result.split(", ")]

    def run(k: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        at, out = (list(held.get) if held.exists else None), []
        if held.hasTimedOut:
            out = flush(k[0], at) if flush else []
            held.remove()
        else:
            rows = pd.concat(list(parts)).sort_values(order)
            for row in rows.itertuples(index=False):
                at, more = push(at, row)
                out += more
            held.update(tuple(at))
            held.setTimeoutTimestamp(max(int(wait(at)), held.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=names)

    rows = stream.withWatermark(ts, late).select(*dict.fromkeys([key, *order, *columns, ts]))
    return rows.groupBy(key).applyInPandasWithState(run, result, state, "append", GroupStateTimeout.EventTimeTimeout)


def _field(stream: DataFrame, *names: str) -> str:
    return ", ".join(f"{c} {stream.schema[c].dataType.simpleString()}" for c in names)


def smooth_stream(stream: DataFrame, key: str, order: str, sec: str, label: str, confidence: str, mode: str, labels: list[str], silence: float, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """(key, order, smoothed): the labels of a track in order; a track begins anew after ``silence`` seconds (of ``sec``)."""

    def push(at, row):
        s, now = Smoother(mode, labels), getattr(row, sec)
        if at and now - at[3] <= silence:
            s.restore(*at[:3])
        out = s.push(getattr(row, label), getattr(row, confidence))
        return [*s.state(), now], [(getattr(row, key), getattr(row, order), out)]

    return in_order(stream, key, [sec, order], [sec, label, confidence], ts, late, f"{_field(stream, key, order)}, smoothed string", "held string, mean string, label string, last double", push, lambda at: (at[3] + silence) * 1000)


def vote_stream(stream: DataFrame, key: str, order: str, sec: str, label: str, value: str, silence: float, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """(key, order, voted, vote_mean): identity_vote() of a track in order; after ``silence`` seconds its votes are stale and go."""

    def push(at, row):
        v, now = Vote(), getattr(row, sec)
        if at and now - at[3] <= silence:
            v.labels, v.values, v.label = at[0].split("\t"), [float(x) for x in at[1].split("\t")], at[2]
        mean = v.push(getattr(row, label), getattr(row, value))
        return ["\t".join(v.labels), "\t".join(map(repr, v.values)), v.label, now], [(getattr(row, key), getattr(row, order), v.label, mean)]

    return in_order(stream, key, [sec, order], [sec, label, value], ts, late, f"{_field(stream, key, order)}, voted string, vote_mean double", "labels string, vals string, label string, last double", push, lambda at: (at[3] + silence) * 1000)


def cut_stream(stream: DataFrame, key: str, order: str, sec: str, hist: str, gap: int, silence: float, base: float = 0.35, factor: float = 3.0, offset: float = 0.08, last: int = 48, least: int = 12, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """(key, order, score): rows whose histogram differs from the one before of the key by the limit at least, and which come
    ``gap`` or more (of ``order``) after the last cut. The limit follows the last scores, as in adaptive_threshold()."""

    def push(at, row):
        now, i, h = getattr(row, sec), getattr(row, order), np.asarray(getattr(row, hist), float)
        if at is None or now - at[3] > silence:
            return [h.tolist(), [], None, now], []
        a, scores, cut = np.asarray(at[0], float), list(at[1]), at[2]
        x, y = a - a.mean(), h - h.mean()
        both = math.sqrt(max(float(x @ x) * float(y @ y), 0.0))
        score = 1 - (float(x @ y) / both if both else 0.0)
        scores = [*scores, score][-last:]
        held = sorted(scores)
        middle = (held[(len(held) - 1) // 2] + held[len(held) // 2]) / 2
        limit = max(base, factor * middle + offset) if len(scores) >= least else base
        hit = score >= limit and (cut is None or i - cut >= gap)
        return [h.tolist(), scores, i if hit else cut, now], [(getattr(row, key), i, score)] if hit else []

    return in_order(stream, key, [sec, order], [sec, hist], ts, late, f"{_field(stream, key, order)}, score double", "hist array<double>, scores array<double>, cut bigint, last double", push, lambda at: (at[3] + silence) * 1000)


def release_in_order(stream: DataFrame, key: str, seq: str, sec: str, first: int, wait: float, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """(key, seq, forced): the numbers of a key from ``first`` on, each once all before it have gone out. Those held back for
    a number that doesn't come go out, in order and marked as forced, when nothing came for ``wait`` seconds; so does,
    at once, a number whose turn has passed."""

    def push(at, row):
        due, held, _ = at or [first, [], 0.0]
        k, i, out = getattr(row, key), getattr(row, seq), []
        if i < due:
            return [due, held, getattr(row, sec)], [(k, i, True)]
        held = sorted({*held, i})
        while held and held[0] == due:
            out.append((k, due, False))
            held, due = held[1:], due + 1
        return [due, held, getattr(row, sec)], out

    def flush(k, at):
        return [(k, i, True) for i in at[1]]

    return _as_they_come(stream, key, [sec, seq], [], ts, late, f"{_field(stream, key, seq)}, forced boolean", "due bigint, held array<bigint>, last double", push, lambda at: (at[2] + wait) * 1000, flush)


def open_spans(stream: DataFrame, key: str, order: str, label: str, gap: float, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """(key, label, start_s, end_s, n): spans as they close, by another label or by more than ``gap`` seconds of silence,
    whether a row tells of it or the watermark."""

    def push(at, row):
        t, l, out = getattr(row, order), getattr(row, label), []
        if at and (t - at[2] > gap or l != at[0]):
            out, at = [(getattr(row, key), at[0], at[1], at[2] if t - at[2] > gap else t, at[3])], None
        return [l, t, t, 1] if at is None else [at[0], at[1], t, at[3] + 1], out

    def flush(k, at):
        return [(k, *at)]

    return in_order(stream, key, [order, label], [], ts, late, f"{_field(stream, key)}, label string, start_s double, end_s double, n bigint", "label string, start_s double, last_s double, n bigint", push, lambda at: (at[2] + gap) * 1000, flush)


def emit_changes_stream(stream: DataFrame, key: str, order: str, label: str, window: float, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """(key, order, label): rows whose label differs from the last one emitted or comes more than ``window`` after it. Once
    the window is over any row goes out, so the key is forgotten."""

    def push(at, row):
        t, l = getattr(row, order), getattr(row, label)
        if at and l == at[0] and t - at[1] <= window:
            return at, []
        return [l, t], [(getattr(row, key), t, l)]

    return in_order(stream, key, [order, label], [], ts, late, _field(stream, key, order, label), "label string, last double", push, lambda at: (at[1] + window) * 1000)

