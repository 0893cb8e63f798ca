"""Approximate nearest neighbours by a forest of random-projection trees.

TREES trees are grown from a sample of at most SAMPLE distinct vectors (the fit's bound; the whole index is not
sampled): each node splits its points by the plane halfway between two of them, drawn at random, until LEAF or fewer
are left. The index has every vector of the table with its leaf of each tree, in blocks of at most BLOCK rows. A query
goes down all trees through one priority queue, ordered by the squares of the distances to the planes on whose wrong
side a branch lies, added up along it, and takes leaves until those of the sample in them number PROBE. The points in
VOTES or more of these leaves are its candidates; where a block has fewer than k + 1 such points, all points in any of
the leaves are. Candidates are measured on the original vectors in double precision, and the k + 1 nearest of each
block are ranked again over all blocks. Neither pairs nor vectors are shuffled.

Queries are packed in blocks too; a pass joins at most about PASS of them, broadcast, with the index blocks, and writes
what it found before the next pass begins, so what is broadcast and planned is bounded however many queries there are.

Vectors that are equal are one point of the index, which keeps the k + 1 smallest of their ids: none of the others could
be among k nearest. So a vector that occurs a million times is neither compared nor moved a million times.

Nulls and edges: vectors that are null, empty, all zero, or hold null or non-finite components take no part, neither do
null ids, nor vectors of another dimension than the most frequent one (the smaller, if two are). Rows that repeat id
and vector count once. With k candidates or fewer all are returned. Ties in distance go to the smaller id. An empty
table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_staged, staged

TREES, LEAF, SAMPLE, PROBE, VOTES = 48, 24, 20_000, 12_000, 2
#: Queries in a pass, queries in a block of them, and points in a block of the index.
PASS, TOGETHER, BLOCK = 8192, 512, 8192
SEED = 20_011


class Tree:
    """Arrays over nodes: plane (normal, offset), children; a leaf has child -1 and a number."""

    def __init__(self, x: np.ndarray, rng: np.random.Generator, leaf: int):
        self.normal, self.offset, self.low, self.high, self.leaf, self.size = [], [], [], [], [], []
        self.n_leaves = 0
        todo = [(np.arange(len(x)), None, 0)]
        while todo:
            at, parent, side = todo.pop()
            node = len(self.low)
            if parent is not None:
                (self.high if side else self.low)[parent] = node
            split = None
            if len(at) > leaf:
                for _ in range(4):
                    a, b = x[rng.choice(at, 2, replace=False)]
                    normal = a - b
                    offset = float(normal @ (a + b) / 2)
                    above = x[at] @ normal > offset
                    if 0.05 < above.mean() < 0.95:
                        split = normal / np.linalg.norm(normal), offset / np.linalg.norm(normal), above
                        break
                else:
                    normal = rng.standard_normal(x.shape[1])
                    normal /= np.linalg.norm(normal)
                    far = x[at] @ normal
                    above = far > np.median(far)
                    if above.any() and not above.all():
                        split = normal, float(np.median(far)), above
            self.low.append(-1), self.high.append(-1), self.size.append(len(at))
            self.normal.append(np.zeros(x.shape[1]) if split is None else split[0])
            self.offset.append(0.0 if split is None else split[1])
            self.leaf.append(self.n_leaves if split is None else -1)
            if split is None:
                self.n_leaves += 1
            else:
                todo += [(at[~split[2]], node, 0), (at[split[2]], node, 1)]
        self.normal, self.offset = np.array(self.normal, np.float32), np.array(self.offset, np.float32)
        self.low, self.high, self.leaf = np.array(self.low, np.int32), np.array(self.high, np.int32), np.array(self.leaf, np.int32)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int32)
        while True:
            inner = np.flatnonzero(self.low[at] >= 0)
            if not len(inner):
                return self.leaf[at]
            n = at[inner]
            above = np.einsum("ij,ij->i", x[inner], self.normal[n]) > self.offset[n]
            at[inner] = np.where(above, self.high[n], self.low[n])


def search(trees: list[Tree], q: np.ndarray, probe: int) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of the shared queue, until ``probe`` sample points are in them."""
    queue = [(0.0, t, 0) for t in range(len(trees))]
    found, have = [], 0
    while queue and have < probe:
        wrong, t, node = heapq.heappop(queue)
        tree = trees[t]
        while tree.low[node] >= 0:
            margin = float(tree.normal[node] @ q - tree.offset[node])
            near, far = (tree.high[node], tree.low[node]) if margin > 0 else (tree.low[node], tree.high[node])
            heapq.heappush(queue, (wrong + margin * margin, t, int(far)))
            node = int(near)
        found.append((t, int(tree.leaf[node])))
        have += tree.size[node]
    return found


def usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _grown(sample, leaf: int):
    """Trees by number, each from its own seed."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for t in part.column(0).to_pylist():
                tree = Tree(sample.value, np.random.default_rng([SEED, t]), leaf)
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int64()), pa.array([pickle.dumps(tree)], pa.binary())], ["t", "tree"])

    return run


def _indexed(sent):
    """Blocks of points: ids, vectors, and by tree the points in the order of their leaves."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for a in range(0, part.num_rows, BLOCK):
                rows = part.slice(a, BLOCK)
                x = _matrix(rows.column(1))
                leaves = np.stack([t.leaves(x.astype(np.float32)) for t in sent.value]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([rows.column(0).to_numpy().tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary()), pa.array([leaves.tobytes()], pa.binary())], ["p", "x", "leaves"])

    return run


def _asked(sent, probe: int):
    """Blocks of queries: ids, vectors, the leaves to look into (as tree * 2**20 + leaf) and where each query's end."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for a in range(0, part.num_rows, TOGETHER):
                rows = part.slice(a, TOGETHER)
                x = _matrix(rows.column(1))
                found = [np.array([(t << 20) + n for t, n in search(sent.value, v, probe)], np.int64) for v in x.astype(np.float32)]
                ends = np.cumsum([len(f) for f in found])
                cells = [rows.column(0).to_numpy(), x, np.concatenate(found), ends]
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells], ["qp", "qx", "cells", "ends"])

    return run


def _measured(k: int, votes: int, n_trees: int):
    """(qp, p, score): the ``k`` nearest candidates that each query of a block has in a block of the index."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for part in parts:
            for i in range(part.num_rows):
                p_raw, x_raw, leaf_raw, qp, qx, cells, ends = (part.column(c)[i].as_py() for c in range(7))
                if p_raw != last:
                    last, p = p_raw, np.frombuffer(p_raw, np.int64)
                    x = np.frombuffer(x_raw).reshape(len(p), -1)
                    key = (np.frombuffer(leaf_raw, np.int32).reshape(n_trees, -1) + (np.arange(n_trees, dtype=np.int64) << 20)[:, None]).ravel()
                    by = np.argsort(key, kind="stable")
                    key, point = key[by], by % len(p)
                qp, cells, ends = (np.frombuffer(b, np.int64) for b in (qp, cells, ends))
                qx = np.frombuffer(qx).reshape(len(qp), -1)
                lo, hi = np.searchsorted(key, cells), np.searchsorted(key, cells, side="right")
                out = []
                for j, (a, b) in enumerate(zip(np.append(0, ends[:-1]), ends)):
                    many = hi[a:b] - lo[a:b]
                    hits = point[np.repeat(lo[a:b] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
                    count = np.bincount(hits, minlength=len(p))
                    at = np.flatnonzero(count >= votes)
                    if len(at) < k:
                        at = np.flatnonzero(count)
                    d = np.sqrt(((x[at] - qx[j]) ** 2).sum(axis=1))
                    best = np.lexsort((p[at], d))[:k]
                    out.append((np.full(len(best), qp[j]), p[at][best], d[best]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["qp", "p", "score"])

    return run


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding",
    trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, probe: int = PROBE, votes: int = VOTES,
) -> DataFrame:
    """(query_id, rank, <key>, score): the k nearest found of each row for which ``is_query`` holds."""
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    own = vectors.where(F.col(f"`{key}`").isNotNull() & usable(F.col(f"`{vector}`"))).select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").alias("v"), is_query.alias("q"))
    result = f"query_id {kind}, rank int, {key} {kind}, score double"
    own = staged(own)
    sizes = own.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], result)
    own = own.where(F.size("v") == sizes[0][0])
    # the row limit by rank is applied before the rows are shuffled as well as after
    ranked = own.select("v", "id").distinct().withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    points = staged(ranked.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.get("ids", 0).cast("bigint").alias("p"), "v", "ids"))
    fit = points.select("v", F.xxhash64("p").alias("h")).orderBy("h").limit(sample).select("v").toPandas()
    drawn = spark.sparkContext.broadcast(np.array(fit["v"].tolist(), np.float32))
    grown = spark.range(0, trees, 1, min(trees, 16)).mapInArrow(_grown(drawn, leaf), "t bigint, tree binary")
    sent = spark.sparkContext.broadcast([pickle.loads(r.tree) for r in sorted(grown.collect(), key=lambda r: r.t)])

    index = staged(points.select("p", "v").mapInArrow(_indexed(sent), "p binary, x binary, leaves binary"))
    asked = staged(own.where("q").select("id", "v").distinct().join(points.select("p", "v"), "v").select("id", "p"))
    wanted = points.join(asked.select("p").distinct(), "p", "left_semi").select("p", "v")
    n_queries = wanted.count()
    wanted = wanted.repartition(max(1, -(-n_queries // TOGETHER)), "p").mapInArrow(_asked(sent, probe), "qp binary, qx binary, cells binary, ends binary")
    wanted = staged(wanted.withColumn("pass", F.monotonically_increasing_id()))
    passes = -(-n_queries // PASS)
    near = []
    for i in range(passes):
        # blocks of queries are dealt by a hash of their place, about PASS / TOGETHER to a pass
        block = wanted.where(F.pmod(F.xxhash64("pass"), F.lit(passes)) == i).drop("pass")
        near.append(staged(index.join(F.broadcast(block)).mapInArrow(_measured(k + 1, votes, trees), "qp bigint, p bigint, score double")))
    if not near:
        return spark.createDataFrame([], result)
    sent.unpersist()
    found = near[0]
    for other in near[1:]:
        found = found.unionByName(other)
    by_score = Window.partitionBy("qp").orderBy("score", "p")
    found = found.withColumn("r", F.row_number().over(by_score)).where(F.col("r") <= k + 1).drop("r")
    # equal distances of different points: all of them are kept up to k + 1 ids
    ids = found.join(points.select("p", "ids"), "p").select("qp", "score", F.explode("ids").alias("other"))
    best = staged(ids.withColumn("r", F.row_number().over(Window.partitionBy("qp").orderBy("score", "other"))).where(F.col("r") <= k + 1).drop("r"))
    drop_staged(index, wanted, *near)
    pairs = asked.join(best, asked["p"] == best["qp"]).where(F.col("id") != F.col("other"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("score", "other")).cast("int")).where(F.col("rank") <= k)
    return ranked.select(F.col("id").alias("query_id"), "rank", F.col("other").alias(key), "score")
