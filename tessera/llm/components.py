"""Connected components of an edge table, by contraction on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (x, y): root is the smallest node that can be reached.

    Each round every node points at its smallest neighbour if that is smaller than itself, pointers are followed to
    their ends, and edges are drawn between the ends; each round at least halves the nodes that have edges. A hub of
    many edges is an aggregate with partial sums and a join, never a list.
    """
    edges = staged(edges.select("x", "y").where("x <> y").distinct())
    found = None
    while edges.take(1):
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        up = staged(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("p")).select("node", F.least("node", "p").alias("p")))
        while True:
            far = up.select(F.col("node").alias("p"), F.col("p").alias("q"))
            step = staged(up.join(far, "p").select("node", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")))
            up = step.select("node", "p")
            if not step.where("moved").take(1):
                break
        ends = up.withColumnRenamed("p", "root")
        found = ends if found is None else staged(
            found.join(ends.select(F.col("node").alias("root"), F.col("root").alias("r")), "root", "left").select("node", F.coalesce("r", "root").alias("root"))
        )
        at = lambda c: up.select(F.col("node").alias(c), F.col("p").alias(f"p{c}"))
        edges = staged(edges.join(at("x"), "x").join(at("y"), "y").select(F.col("px").alias("x"), F.col("py").alias("y")).where("x <> y").distinct())
    return found if found is not None else edges.select(F.col("x").alias("node"), F.col("y").alias("root"))
