"""Approximate search over inverted lists that lie on disk, one folder a list, of which a search reads those it probes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import picks
from .picks import knn
from .products import matrix, nearest, parted, units
from .shared import staged

#: Rows a list for the fit at most, lists at most, queries on which probes are chosen at most.
FIT_ROWS, MOST_LISTS, TRIALS = 64, 65_536, 256
#: Numbers that a block of rows, each with its lists, holds at most.
OUT = 1 << 21


def list_count(rows: int) -> int:
    """Lists for a table of ``rows``: the root, which makes finding lists as long as reading one."""
    return min(MOST_LISTS, max(1, round(math.sqrt(rows))))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length at unit length; zero vectors stay."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    x = flat.reshape(len(column), -1)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1.0)


@dataclass
class Lists:
    """An index: its folder, the centres of its lists and the number of rows in each."""

    rows: DataFrame
    centres: np.ndarray
    counts: dict[int, int]

    @property
    def total(self) -> int:
        return sum(self.counts.values())


def _nearest(centres, most: int) -> Callable:
    """(.., list, r): the ``most`` lists of nearest centres of each row's vector, which is the last column."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centres.value
        for part in parts:
            width = len(part.columns[-1].flatten()) // max(1, part.num_rows) + len(c)
            step = max(1, min(2048, OUT // max(1, most * width)))
            for a in range(0, part.num_rows, step):
                some = part.slice(a, step)
                score = _matrix(some.columns[-1]) @ c.T if c.any() else np.zeros((some.num_rows, len(c)))
                near = np.argsort(-score, axis=1, kind="stable")[:, :most] if most > 1 else np.argmax(score, axis=1)[:, None]
                at = pa.array(np.repeat(np.arange(some.num_rows), near.shape[1]))
                ranks = np.tile(np.arange(1, near.shape[1] + 1, dtype=np.int32), some.num_rows)
                yield pa.RecordBatch.from_arrays([*[x.take(at) for x in some.columns], pa.array(near.ravel().astype(np.int32)), pa.array(ranks)], [*some.schema.names, "list", "r"])

    return run


def _listed(rows: DataFrame, centres: np.ndarray, most: int) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(centres)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_nearest(sent, most), f"{schema}, list int, r int")


def build_lists(corpus: DataFrame, path: str, cid: str, vector: str = "embedding", lists: int | None = None, seed: int = 1) -> Lists:
    """Write every row of ``corpus`` that has a vector, all of one length, under ``path``, in the list of its nearest centre.
    Centres are fitted by k-means for cosine on FIT_ROWS rows a list at most, drawn by hash of the id."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = corpus.where(F.col(vector).isNotNull()).select(F.col(cid).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    n = rows.count()
    lists = lists or list_count(n)
    share = min(1.0, lists * FIT_ROWS / max(1, n))
    some = rows.where((F.xxhash64("id", F.lit(seed)) % 1_000_003 + 1_000_003) % 1_000_003 < int(share * 1_000_003) + 1).where(F.exists("v", lambda x: x != 0))
    fitted = some.select(array_to_vector("v").alias("features")).persist()
    if fitted.take(1):
        centres = np.array(KMeans(k=lists, seed=seed, maxIter=8, distanceMeasure="cosine", initSteps=2).fit(fitted).clusterCenters())
    else:
        centres = np.zeros((1, 1))
    fitted.unpersist()
    _listed(rows, centres, 1).drop("r").repartition("list").write.partitionBy("list").mode("overwrite").parquet(path)
    stored = rows.sparkSession.read.schema(f"id {rows.schema['id'].dataType.simpleString()}, v array<double>, list int").parquet(path)
    return Lists(stored, centres, {r[0]: r[1] for r in stored.groupBy("list").count().collect()})


def search_lists(index: Lists, queries: DataFrame, k: int, qid: str, probes: int, vector: str = "embedding") -> DataFrame:
    """(query, id, rank, score): top k by cosine of each query among the rows of its ``probes`` nearest lists. Queries go to
    the tasks in passes of bounded size, each vector once and the lists as places of it; a list's rows meet its queries as
    products, and no vector is shuffled."""
    q = queries.where(F.col(vector).isNotNull()).select(F.col(qid).alias("query"), F.col(vector).cast("array<double>").alias("q"))
    kinds = [x.schema[n].dataType.simpleString() for x, n in ((q, "query"), (index.rows, "id"))]
    found, read = None, set()
    for part in parted(q, "query", picks.PASS):
        names, x = part.column("query").to_numpy(), units(matrix(part.column("q")))
        by_list = _places(x, index.centres, probes)
        read |= by_list.keys()
        sent = index.rows.sparkSession.sparkContext.broadcast((names, x, by_list))
        some = index.rows.where(F.col("list").isin(list(by_list))).mapInArrow(nearest(sent, k), f"query {kinds[0]}, id {kinds[1]}, score double")
        found = some if found is None else found.unionByName(some)
    if found is None:
        return q.join(index.rows, F.lit(False)).select("query", "id", F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    return picks.ranked(found, index.rows.where(F.col("list").isin(list(read))).select("id", "v"), q, k)


def _places(x: np.ndarray, centres: np.ndarray, probes: int) -> dict[int, np.ndarray]:
    """Of each list, the places of the vectors that it is among the ``probes`` nearest lists of."""
    near = np.concatenate([np.argsort(-(x[a : a + 256] @ centres.T if centres.any() else np.zeros((len(x[a : a + 256]), len(centres)))), axis=1, kind="stable")[:, :probes] for a in range(0, len(x), 256)])
    at, lists = np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()
    order = np.argsort(lists, kind="stable")
    values, first = np.unique(lists[order], return_index=True)
    return dict(zip(values.tolist(), np.split(at[order], first[1:])))


def recall_curve(index: Lists, queries: DataFrame, corpus: DataFrame, k: int, qid: str, cid: str, vector: str = "embedding") -> DataFrame:
    """(probes, recall, share_read) for every number of probes: the share of the exact k nearest of ``queries`` that so many
    lists hold, which is the recall of a search of them, and the share of all rows that they hold. TRIALS queries at most,
    those of least hash."""
    some = queries.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(qid), qid).limit(TRIALS)
    exact = knn(some, corpus, k, qid, cid, vector).select("query", "id")
    lists = staged(_listed(some.select(F.col(qid).alias("query"), F.col(vector).cast("array<double>").alias("q")), index.centres, len(index.centres)).select("query", "list", "r"))
    held = exact.join(index.rows.select("id", "list"), "id").join(lists, ["query", "list"]).groupBy("r").agg(F.count(F.lit(1)).alias("hits"))
    spark = index.rows.sparkSession
    sizes = spark.createDataFrame(sorted(index.counts.items()), "list int, n long")
    read = lists.join(F.broadcast(sizes), "list", "left").groupBy("r").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("m"))
    upto = Window.orderBy("r")
    sums = read.join(held, "r", "left").select("r", F.sum("n").over(upto).alias("n"), "m", F.sum(F.coalesce("hits", F.lit(0))).over(upto).alias("hits"), F.sum("hits").over(Window.partitionBy(F.lit(1))).alias("of"))
    return sums.select(F.col("r").alias("probes"), (F.col("hits") / F.col("of")).alias("recall"), (F.col("n") / (F.col("m") * F.lit(max(1, index.total)))).alias("share_read"))


def fewest_probes(curve: DataFrame, recall: float = 0.95) -> tuple[int, float, float]:
    """(probes, recall, share_read) of the fewest probes that reach ``recall``; all lists where none are measured."""
    hit = curve.where(F.col("recall") >= recall).orderBy("probes").first() or curve.orderBy(F.desc("probes")).first()
    return tuple(hit) if hit else (1, 1.0, 1.0)
