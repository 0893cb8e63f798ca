"""Quality classifier: random Fourier features over document statistics, ridge regression, isotonic calibration.

Each whole text becomes STATISTICS numbers. After centring and scaling by the labelled rows, FEATURES cosines of random
projections approximate a Gaussian kernel of width ``width``. Every task adds up its own part of the normal equations of
a ridge regression on the label; the parts are added row by row on Spark, and one system of FEATURES + 1 unknowns is
solved. Raw predictions of the labelled rows are counted in CELLS cells, and pooling adjacent violators over the cells
gives a monotone map from prediction to the chance of label 1, interpolated between cells.

What reaches the driver is one matrix and one histogram, of fixed size. The fit uses all labelled rows: no bound.

Nulls and edges: a null text is scored as an empty one, whose statistics are all 0; rows that repeat are scored each; a
null key is never learned from and counts as held out; several labels of one key count as their mean; rows without a
label are scored only. Without any label the score is 0.5; with one kind of label it is that label. Columns beside key
and text are not looked at. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_or_shuffled, staged

FEATURES, CELLS, SEED = 384, 512, 7
RIDGE, WIDTH = 1e-3, 4.0
THRESHOLD = 0.3



def statistics(text: str) -> list[float]:
    """Numbers that describe a whole text; all 0 for one without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    chars = Counter(text)
    total = len(text)
    kinds = Counter()
    for c, m in chars.items():
        kinds["alpha" if c.isalpha() else "digit" if c.isdigit() else "space" if c.isspace() else "mark" if c in ".,;:!?'\"-()" else "symbol"] += m
        if c.isupper():
            kinds["upper"] += m
    entropy = -sum(m / total * math.log2(m / total) for m in chars.values())
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    top = counts.most_common(3)
    pairs = Counter(zip(words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    line_words = [len(x.split()) for x in lines]
    capital = sum(w[0].isupper() for w in words)
    ends = sum(w[-1] in ".!?" for w in words)
    plain = sum(w.isalpha() for w in words)
    starts_upper = sum(x.lstrip()[0].isupper() for x in lines)
    ends_stop = sum(x.rstrip()[-1] in ".!?" for x in lines)
    short = [w for w, _ in counts.most_common(20) if len(w) <= 4]
    return [
        math.log1p(n), math.log1p(total), math.log1p(len(lines)), math.log1p(total / len(lines)),
        float(lengths.mean()), float(lengths.std()), math.log1p(int(lengths.max())),
        len(counts) / n, math.log(len(counts)) / math.log(n) if n > 1 else 1.0,
        top[0][1] / n, sum(c for _, c in top) / n, sum(a == b for a, b in zip(words, words[1:])) / n,
        1 - len(pairs) / max(1, n - 1), (max(pairs.values()) if pairs else 0) / n,
        kinds["alpha"] / total, kinds["digit"] / total, kinds["space"] / total, kinds["mark"] / total, kinds["symbol"] / total,
        kinds["upper"] / max(1, kinds["alpha"]), capital / n, ends / n, plain / n,
        1 - len(set(lines)) / len(lines), max(line_words) / n, float(np.std(line_words)) / (1 + float(np.mean(line_words))), starts_upper / len(lines), ends_stop / len(lines),
        entropy, max(chars.values()) / total, chars["|"] / total, (chars["{"] + chars["}"] + chars["<"] + chars[">"]) / total,
        sum(counts[w] for w in short) / n, text.count("http") / n, float((lengths > 20).mean()), float((lengths == 1).mean()),
    ]


#: What statistics() returns, in its order.
NAMES = (
    "words", "chars", "lines", "line_length", "word_mean", "word_std", "word_max", "types", "type_power", "top_word", "top_three", "doubled", "pair_repeats", "top_pair",
    "alpha", "digit", "space", "mark", "symbol", "upper", "capital", "sentence_ends", "plain_words", "line_repeats", "longest_line", "line_spread", "lines_upper", "lines_stop",
    "entropy", "top_char", "bars", "braces", "short_common", "links", "long_words", "single_chars",
)
STATISTICS = len(NAMES)


def held_out(key: Column, folds: int = 5) -> Column:
    """True where crc32 of the key as text is divisible by ``folds``; true for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(True))


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class Fourier:
    """x -> cosines, after centring and scaling."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, width: float, features: int):
        rng = np.random.default_rng(SEED)
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        self.w = rng.standard_normal((len(mean), features)) / width
        self.b = rng.uniform(0, 2 * math.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -6, 6) @ self.w + self.b
        return np.hstack((np.sqrt(2 / len(self.b)) * np.cos(z), np.ones((len(x), 1))))


def pool(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of ``y`` on increasing ``x`` with weights: centres and levels of the pools."""
    pools: list[list[float]] = []
    for a, b, c in zip(x, y, w):
        pools.append([a * c, b * c, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], last)]
    p = np.array(pools).reshape(-1, 3)
    return p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, x): the statistics of each row's whole text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = [statistics(t or "") for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x, pa.list_(pa.float64()))], ["key", "x"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"key {kind}, x array<double>")


def fit(train: DataFrame, width: float = WIDTH, ridge: float = RIDGE, features: int = FEATURES):
    """From (x, label) a function that scores rows of statistics; None without labels."""
    spark = train.sparkSession
    train = staged(train.select("x", F.col("label").cast("double").alias("label")))
    sums = train.select(F.posexplode("x"), "label").groupBy("pos").agg(F.avg("col").alias("m"), F.stddev_pop("col").alias("s"), F.avg("label").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("pos").collect()
    if not sums:
        return None
    phi = Fourier(np.array([r.m for r in sums]), np.array([r.s for r in sums]), width, features)
    sent = spark.sparkContext.broadcast(phi)

    def parts_of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = None
        for part in parts:
            if part.num_rows:
                z = np.hstack((sent.value(_rows(part.column(0), STATISTICS)), part.column(1).to_numpy()[:, None]))
                a = z.T @ z if a is None else a + z.T @ z
        if a is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(a)), pa.int32()), pa.array(list(a), pa.list_(pa.float64()))], ["i", "v"])

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, np.ndarray] = {}
        for part in parts:
            for i, v in zip(part.column(0).to_pylist(), _rows(part.column(1), features + 2)):
                rows[i] = rows[i] + v if i in rows else v.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), pa.array(list(rows.values()), pa.list_(pa.float64()))], ["i", "v"])

    shape = "i int, v array<double>"
    gram = train.mapInArrow(parts_of, shape).repartition("i").mapInArrow(add, shape).collect()
    a = np.zeros((features + 2, features + 2))
    for r in gram:
        a[r.i] += r.v
    n = a[-2, -2]
    beta = np.linalg.solve(a[:-1, :-1] + ridge * n / features * np.diag([1.0] * features + [0.0]) + 1e-9 * np.eye(features + 1), a[:-1, -1])
    beta_sent = spark.sparkContext.broadcast(beta)

    def raw(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(sent.value(_rows(part.column(0), STATISTICS)) @ beta_sent.value), part.column(1)], ["raw", "label"])

    cell = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(0.999999), (F.col("raw") + 0.5) / 2)) * CELLS)
    cells = train.mapInArrow(raw, "raw double, label double").groupBy(cell.alias("cell")).agg(F.avg("raw").alias("x"), F.avg("label").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("cell").collect()
    x, y = pool(np.array([r.x for r in cells]), np.array([r.y for r in cells]), np.array([float(r.n) for r in cells]))

    def score(rows: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(phi(rows) @ beta, x, y), 0.0, 1.0)

    return score


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label_key: str = "doc_id", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """(key, held_out, score, predicted) for each row of ``docs``; labels of held-out keys are not used."""
    kind = docs.schema[key].dataType.simpleString()
    x = staged(measured(docs, key, text))
    known = labels.where(F.col(f"`{label}`").isNotNull() & ~held_out(F.col(f"`{label_key}`"))).groupBy(F.col(f"`{label_key}`").alias("key")).agg(F.avg(f"`{label}`").alias("label"))
    score = fit(x.join(known, "key").select("x", "label"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                s = score(_rows(part.column(1), STATISTICS)) if score else np.full(part.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s)], ["key", "score"])

    scored = x.mapInArrow(run, f"key {kind}, score double")
    return scored.select("key", held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label_key: str = "doc_id", label: str = "quality", threshold: float = THRESHOLD, broadcast_rows: int = 2_000_000) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more; each row is judged by its own text, and texts aren't shuffled
    while the labelled keys are few enough to broadcast."""
    known = staged(labels.where(F.col(f"`{label}`").isNotNull() & ~held_out(F.col(f"`{label_key}`"))).groupBy(F.col(f"`{label_key}`").alias("key")).agg(F.avg(f"`{label}`").alias("label")))
    some = small_or_shuffled(known, known.count(), broadcast_rows)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    score = fit(measured(rows.join(some.select("key"), "key", "left_semi"), "key", "text").join(some, "key").select("x", "label"))
    if score is None:
        return docs if threshold <= 0.5 else docs.limit(0)
    at = docs.columns.index(text)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                s = score(np.array([statistics(t or "") for t in part.column(at).to_pylist()]))
                yield part.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)
