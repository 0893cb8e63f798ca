"""From observations (one row for each sighting) to votes, smoothed labels, spans and summaries, all keyed and in batch."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pearson(a: Column | str, b: Column | str) -> Column:
    """Correlation of two arrays; 0 if either is constant."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    n = F.size(a).cast("double")
    sa, sb = total(a), total(b)
    cov = total(F.zip_with(a, b, lambda x, y: x * y)) - sa * sb / n
    va, vb = total(F.transform(a, lambda x: x * x)) - sa * sa / n, total(F.transform(b, lambda x: x * x)) - sb * sb / n
    return F.coalesce(F.try_divide(cov, F.sqrt(F.greatest(va * vb, F.lit(0.0)))), F.lit(0.0))


def histogram_cuts(df: DataFrame, key: str, order: str, hist: str, threshold: float = 0.35, gap: int = 0) -> DataFrame:
    """(key, order, score): rows whose histogram correlates with the one before by 1 - threshold at most. With ``gap``,
    rows nearer than that to a cut that was kept are passed over, key by key."""
    before = F.lag(hist).over(Window.partitionBy(key).orderBy(order))
    rows = df.withColumn("score", F.when(before.isNotNull(), 1 - pearson(before, hist))).where(F.col("score") >= threshold).select(key, order, "score")
    return with_gap(rows, key, order, gap) if gap else rows


def with_gap(rows: DataFrame, key: str, order: str, gap: float) -> DataFrame:
    """Rows in order, each at least ``gap`` after the last one kept. A group holds one entity's candidates."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        keep, last = [], None
        for at in pdf[order]:
            ok = last is None or at - last >= gap
            keep.append(ok)
            last = at if ok else last
        return pdf[np.array(keep, bool)]

    return rows.groupBy(key).applyInPandas(run, rows.schema)


def adaptive_threshold(df: DataFrame, key: str, order: str, score: str, base: float = 0.35, factor: float = 3.0, offset: float = 0.08, last: int = 48, least: int = 12) -> DataFrame:
    """``df`` with ``limit``: max(base, factor * median of the last scores + offset) once there are ``least``; base before."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(last - 1), 0)
    held = F.collect_list(score).over(w)
    rows = df.withColumn("held_t", F.sort_array(held))
    n = F.size("held_t")
    median = (F.get("held_t", F.floor((n - 1) / 2).cast("int")) + F.get("held_t", F.floor(n / 2).cast("int"))) / 2
    return rows.withColumn("limit", F.when(n >= least, F.greatest(F.lit(base), factor * median + offset)).otherwise(base)).drop("held_t")


def stride_sample(df: DataFrame, key: str, order: str, cut: str, stride: int = 4, boost: int = 12) -> DataFrame:
    """Rows within ``boost`` of the last cut, and each ``stride``-th row counted from it (from the first row before any cut)."""
    w = Window.partitionBy(key).orderBy(order)
    rows = df.withColumn("i_s", F.row_number().over(w) - 1)
    anchor = F.last(F.when(F.col(cut), F.col("i_s")), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("anchor_s", anchor)
    since = F.col("i_s") - F.coalesce("anchor_s", F.lit(0))
    return rows.where((F.col("anchor_s").isNotNull() & (since < boost)) | (since % stride == 0)).drop("i_s", "anchor_s")


def quality_gate(df: DataFrame, least_size: float, least_confidence: float, most_yaw: float, least_sharp: float) -> DataFrame:
    """``df`` (size, confidence, yaw, sharp) with ``reasons`` against it, ``passed`` and a score that is the product of four parts."""
    why = F.array_compact(F.array(
        F.when(F.col("size") < least_size, F.lit("small")), F.when(F.col("confidence") < least_confidence, F.lit("unsure")),
        F.when(F.col("yaw") > most_yaw, F.lit("turned")), F.when(F.col("sharp") < least_sharp, F.lit("blurred")),
    ))
    share = lambda c, full: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c) / full))
    score = share("size", 2 * least_size) * F.col("confidence") * (1 - share("yaw", 2 * most_yaw)) * share("sharp", 2 * least_sharp)
    return df.withColumn("reasons", why).withColumn("passed", F.size("reasons") == 0).withColumn("gate_score", score)


def salvage_best(df: DataFrame, keys: list[str], passed: str, score: str, tie: str, n: int = 3) -> DataFrame:
    """Rows that passed; of groups where none did, the best ``n``."""
    g = Window.partitionBy(*keys)
    rows = df.withColumn("any_s", F.max(F.col(passed).cast("int")).over(g)).withColumn("rank_s", F.row_number().over(g.orderBy(F.desc(score), tie)))
    return rows.where(F.col(passed) | ((F.col("any_s") == 0) & (F.col("rank_s") <= n))).drop("any_s", "rank_s")


def best_per_group(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    return df.withColumn("rank_b", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rank_b = 1").drop("rank_b")


def identity_vote(df: DataFrame, key: str, order: str, label: str, value: str, window: int = 5, least: int = 3) -> DataFrame:
    """``df`` with ``voted`` and ``vote_mean``. The label with most of the last ``window`` votes holds once it has ``least``
    of them (or all, while there are fewer); until another one does so, it stays. Equal counts go to the label seen first
    in the window. The mean is of the window's votes for the label that holds; without any, the row's own value."""
    w = Window.partitionBy(key).orderBy(order)
    rows = df.withColumn("held_i", F.collect_list(F.struct(F.col(label).alias("l"), F.col(value).alias("v"))).over(w.rowsBetween(-(window - 1), 0)))
    names = F.array_distinct(F.transform("held_i", lambda x: x["l"]))
    counted = F.transform(names, lambda n: F.struct(F.size(F.filter("held_i", lambda x: x["l"] == n)).alias("n"), (-F.array_position(names, n)).alias("first"), n.alias("l")))
    rows = rows.withColumn("best_i", F.array_max(counted))
    holds = F.when(F.col("best_i.n") >= F.least(F.lit(least), F.size("held_i")), F.col("best_i.l"))
    rows = rows.withColumn("voted", F.last(holds, True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = F.filter("held_i", lambda x: x["l"] == F.col("voted"))
    mean = F.when(F.size(own) > 0, F.aggregate(own, F.lit(0.0), lambda s, x: s + x["v"]) / F.size(own)).otherwise(F.col(value))
    return rows.withColumn("vote_mean", mean).drop("held_i", "best_i")


def most_voted(votes: list[str]) -> tuple[str, int]:
    """The label with most votes, the one that came first of several, and their number."""
    best = max(dict.fromkeys(votes), key=votes.count)
    return best, votes.count(best)


class Vote:
    """Identity of one track from its last votes, as identity_vote() has it row by row."""

    def __init__(self, window: int = 5, least: int = 3):
        self.window, self.least = window, least
        self.labels: list[str] = []
        self.values: list[float] = []
        self.label: str | None = None

    def push(self, label: str, value: float) -> float:
        self.labels, self.values = [*self.labels, label][-self.window :], [*self.values, value][-self.window :]
        best, n = most_voted(self.labels)
        if n >= min(self.least, len(self.labels)):
            self.label = best
        own = [v for x, v in zip(self.labels, self.values) if x == self.label]
        return sum(own) / len(own) if own else value


class Smoother:
    """State of one track: trusted labels seen lately, running averages by label, the label that holds.

    Rows under ``trust`` never vote. The majority takes over when it has ``agree`` of the last ``window`` votes and more
    than the label that holds; the first one when it has ``agree`` or all of them. The averages (EMA) take over at
    ``trust`` or more. Hybrid: the majority, but a row of ``fast`` or more that the averages agree with takes over at once.
    As long as no label holds, a row keeps its own."""

    def __init__(self, mode: str, labels: list[str], window: int = 7, agree: int = 4, alpha: float = 0.45, fast: float = 0.55, trust: float = 0.4):
        self.mode, self.labels, self.window, self.agree, self.alpha, self.fast, self.trust = mode, sorted(labels), window, agree, alpha, fast, trust
        self.held: list[str] = []
        self.mean: list[float] = []
        self.label: str | None = None

    def _majority(self) -> str | None:
        if not self.held:
            return self.label
        best, n = most_voted(self.held)
        need = min(self.agree, len(self.held)) if self.label is None else max(self.agree, self.held.count(self.label) + 1)
        return best if n >= need else self.label

    def push(self, label: str, confidence: float) -> str:
        if confidence >= self.trust:
            self.held = [*self.held, label][-self.window :]
        now = [confidence if k == label else 0.0 for k in self.labels]
        self.mean = [self.alpha * p + (1 - self.alpha) * m for p, m in zip(now, self.mean)] if self.mean else now
        high = max(self.mean)
        top = self.labels[self.mean.index(high)]
        if self.mode == "ema":
            if self.label is None or high >= self.trust:
                self.label = top
        elif self.mode == "hybrid" and confidence >= max(self.fast, self.trust) and top == label:
            self.label = label
        else:
            self.label = self._majority()
        return self.label or label

    def state(self) -> tuple:
        return "\t".join(self.held), "\t".join(map(repr, self.mean)), self.label or ""

    def restore(self, held: str, mean: str, label: str) -> Smoother:
        self.held = held.split("\t") if held else []
        self.mean = [float(x) for x in mean.split("\t")] if mean else []
        self.label = label or None
        return self


def smooth(df: DataFrame, key: str, order: str, label: str, confidence: str, mode: str, labels: list[str], **config) -> DataFrame:
    """``df`` with ``smoothed``: ``majority`` of the last labels, ``ema`` of the confidences, or ``hybrid`` of both. The label that
    holds feeds the next decision, so each track goes in order; a group is one track."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = Smoother(mode, labels, **config)
        pdf = pdf.sort_values(order)
        return pdf.assign(smoothed=[s.push(a, b) for a, b in zip(pdf[label], pdf[confidence])])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.groupBy(key).applyInPandas(run, f"{fields}, smoothed string")


def spans(df: DataFrame, key: str, order: str, label: str, confidence: str, gap: float | None = None) -> DataFrame:
    """(key, label, start_s, end_s, n, confidence): a span ends where the next label begins; after more than ``gap`` seconds of
    silence it ends at its last observation, and so does the last one of a key."""
    w = Window.partitionBy(key).orderBy(order, label)
    before, at = F.lag(label).over(w), F.lag(order).over(w)
    late = (F.col(order) - at > gap) if gap is not None else F.lit(False)
    rows = df.withColumn("late_s", F.coalesce(late, F.lit(False))).withColumn("new_s", (before.isNull() | (before != F.col(label)) | F.col("late_s")).cast("int"))
    rows = rows.withColumn("island_s", F.sum("new_s").over(w))
    out = rows.groupBy(key, "island_s").agg(F.min(order).alias("start_s"), F.max(order).alias("last_s"), F.first(label).alias("label"), F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("confidence"), F.max("late_s").alias("late_s"))
    o = Window.partitionBy(key).orderBy("island_s")
    end = F.when(F.lead("late_s").over(o) | F.lead("start_s").over(o).isNull(), F.col("last_s")).otherwise(F.lead("start_s").over(o))
    return out.withColumn("end_s", end).select(key, "label", "start_s", "end_s", "n", "confidence")


def merge_spans(rows: DataFrame, key: str, gap: float = 0.6, least: float = 0.3) -> DataFrame:
    """Spans of one label at most ``gap`` apart become one: means of confidence, and of ``similarity`` if there, weighted by n,
    the last ``end_frame`` and the union of ``tracks``, in order, if there. A span shorter than ``least`` goes into the one
    before, which gets its end only; without one before, a short span of one observation is dropped. A group is one key's
    spans."""
    means = [c for c in ("confidence", "similarity") if c in rows.columns]
    ends = [c for c in ("end_s", "end_frame") if c in rows.columns]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        for r in pdf.sort_values(["start_s", "end_s"]).to_dict("records"):
            last = out[-1] if out else None
            short = r["end_s"] - r["start_s"] < least
            near = last and last["label"] == r["label"] and r["start_s"] - last["end_s"] <= gap
            if last and (near or short):
                last |= {c: max(last[c], r[c]) for c in ends}
            if near:
                n = last["n"] + r["n"]
                last |= {c: (last[c] * last["n"] + r[c] * r["n"]) / max(1, n) for c in means} | {"n": n}
                if "tracks" in r:
                    last["tracks"] = sorted({*last["tracks"], *r["tracks"]})
            elif (last and not short) or (not last and (not short or r["n"] > 1)):
                out.append(dict(r))
        return pd.DataFrame(out, columns=pdf.columns)

    return rows.groupBy(key).applyInPandas(run, rows.schema)


def entity_summary(rows: DataFrame, key: str) -> DataFrame:
    """(key, first_seen, last_seen, total_s, spans, changes): changes count moves to another label."""
    before = F.lag("label").over(Window.partitionBy(key).orderBy("start_s", "end_s"))
    marked = rows.withColumn("change", F.coalesce((before != F.col("label")).cast("int"), F.lit(0)))
    return marked.groupBy(key).agg(F.min("start_s").alias("first_seen"), F.max("end_s").alias("last_seen"), F.sum(F.col("end_s") - F.col("start_s")).alias("total_s"), F.count(F.lit(1)).alias("spans"), F.sum("change").alias("changes"))


def label_totals(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum(F.col("end_s") - F.col("start_s")).alias("seconds"), F.count(F.lit(1)).alias("spans"))


def active_at(rows: DataFrame, t: Column | float) -> DataFrame:
    return rows.where((F.col("start_s") <= t) & (F.col("end_s") >= t))


def assign_pids(entities: DataFrame, video: str, entity: str, first_seen: str, known: Column) -> DataFrame:
    """``entities`` with ``pid``: P1, P2, ... by first appearance, PU1, ... for unknown ones."""
    rank = F.row_number().over(Window.partitionBy(video, "known_p").orderBy(first_seen, entity))
    return entities.withColumn("known_p", known).withColumn("pid", F.concat(F.when(F.col("known_p"), "P").otherwise("PU"), rank)).drop("known_p")


def sample_points(spans_of: DataFrame, key: str, start: str, end: str, forced: DataFrame, every: int = 1) -> DataFrame:
    """(key, at, forced): whole multiples of ``every`` seconds from start to end, with the forced points (key, at) marked. A key's
    ends and forced points meet in one row, so the points themselves are never shuffled; a row's points are in memory at once."""
    lo, hi = F.ceil(F.col(start) / every).cast("bigint"), F.floor(F.col(end) / every).cast("bigint")
    rows = spans_of.select(key, F.when(lo <= hi, F.struct(lo.alias("lo"), hi.alias("hi"))).alias("span_s"), F.lit(None).cast("struct<at:double>").alias("at_s"))
    # a struct, as a point may be null; + 0.0, as -0.0 is 0.0
    points = forced.select(key, F.lit(None).cast(rows.schema["span_s"].dataType).alias("span_s"), F.struct((F.col("at").cast("double") + 0.0).alias("at")).alias("at_s"))
    rows = rows.unionByName(points).groupBy(key).agg(F.collect_set("span_s").alias("spans_s"), F.collect_set("at_s").alias("ats_s"))
    whole = F.flatten(F.transform("spans_s", lambda x: F.sequence(x["lo"], x["hi"])))
    ats = F.transform("ats_s", lambda x: x["at"])
    hits = F.filter(F.transform(F.filter(ats, lambda x: F.abs(x) < 2.0**53), lambda x: F.floor(x / every)), lambda i: F.array_contains(ats, (i * every).cast("double")))
    out = F.concat(F.transform(F.array_except(whole, hits), lambda i: F.struct((i * every).cast("double").alias("at"), F.lit(False).alias("forced"))), F.transform(ats, lambda x: F.struct(x.alias("at"), F.lit(True).alias("forced"))))
    return rows.select(key, F.explode(out).alias("o_s")).select(key, "o_s.at", "o_s.forced")


def emit_changes(points: DataFrame, key: str, at: str, label: str, forced: str, window: float = 5.0) -> DataFrame:
    """Points whose label differs from the last one emitted, comes more than ``window`` after it, or is forced."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at)
        keep, last, when = [], None, None
        for t, l, f in zip(pdf[at], pdf[label], pdf[forced]):
            ok = bool(f) or l != last or t - when > window
            keep.append(ok)
            if ok:
                last, when = l, t
        return pdf[np.array(keep, bool)]

    return points.groupBy(key).applyInPandas(run, points.schema)


def entity_key(df: DataFrame, known: str, track: str, keep_unknown: bool = True) -> DataFrame:
    out = df.withColumn("entity", F.coalesce(F.col(known).cast("string"), F.concat(F.lit("track:"), F.col(track))))
    return out if keep_unknown else out.where(F.col(known).isNotNull())


def reid_due(df: DataFrame, key: str, order: str, label: str, value: str, interval: int = 45, threshold: float = 0.38, unknown: str = "unknown") -> DataFrame:
    """``df`` with ``due``: a track is looked at when new, ``interval`` rows after the last look, and as long as it is known
    but the mean of the votes for it, to nine digits, is under ``threshold``. Each look is a vote (see identity_vote)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        due, vote, since, mean = [], Vote(), 0, 0.0
        for l, v in zip(pdf[label], pdf[value]):
            since += 1
            ask = vote.label is None or since >= interval or (vote.label != unknown and round(mean, 9) < threshold)
            if ask:
                mean, since = vote.push(l, v), 0
            due.append(ask)
        return pdf.assign(due=due)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.groupBy(key).applyInPandas(run, f"{fields}, due boolean")


def suppress_overlaps(boxes: DataFrame, keys: list[str], score: str, tie: str, limit: float = 0.4) -> DataFrame:
    """Boxes (x1, y1, x2, y2) of each frame by score, without those that overlap a kept one by more than ``limit`` (areas
    count the end pixels). The list of a group is one frame's boxes."""
    rest = [c for c in boxes.columns if c not in keys]
    # sorted by (-score, tie): the fields come first in the struct
    box = F.struct((-F.col(score)).alias("order_o"), F.col(tie).alias("tie_o"), *rest)

    def iou(a: Column, b: Column) -> Column:
        side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]) + 1)
        area = lambda r: (r["x2"] - r["x1"] + 1) * (r["y2"] - r["y1"] + 1)
        both = side("x1", "x2") * side("y1", "y2")
        return both / (area(a) + area(b) - both)

    rows = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(box)).alias("list_o"))
    none = F.slice("list_o", 1, 0)
    kept = F.aggregate("list_o", none, lambda s, x: F.when(F.exists(s, lambda y: iou(x, y) > limit), s).otherwise(F.array_append(s, x)))
    return rows.select(*keys, F.explode(kept).alias("one_o")).select(*keys, *[F.col(f"one_o.{c}").alias(c) for c in rest])


def top_labels(df: DataFrame, keys: list[str], scores: str, names: list[str], k: int = 3) -> DataFrame:
    """(keys, label, p, rank): softmax of the score array, the k largest scores, ties to the earlier label; a score so far
    below the largest that its share is 0 keeps its rank."""
    top = F.array_max(scores)
    rows = df.withColumn("e_t", F.transform(scores, lambda x: F.exp(x - top))).withColumn("sum_t", F.aggregate("e_t", F.lit(0.0), lambda s, x: s + x))
    rows = rows.select(*keys, F.posexplode(F.arrays_zip(F.col(scores).alias("x"), F.col("e_t").alias("e"))).alias("i", "o"), "sum_t").select(*keys, "i", "o.x", "o.e", "sum_t")
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("i") + 1)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("x"), "i"))).where(F.col("rank") <= k)
    return rows.select(*keys, label.alias("label"), (F.col("e") / F.col("sum_t")).alias("p"), "rank")
