"""Connected components of an edge table by distributed union-find (alternating stars)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atalaya.llm.common import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges to (node, root): root is the smallest node that can be reached; isolated nodes have no row.

    Each round links every node's larger neighbours to its smallest one (large star) and then its smaller
    neighbours too (small star). Neighbour minima are partial aggregates, and joins start from written tables, so
    that a node with very many edges is split by adaptive execution. Rounds grow with the logarithm of the
    component's diameter. Edges with a null end and loops are ignored; repeated edges count once.
    """
    pair = [F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")]
    current = checkpointed(edges.where("a <> b").select(*pair).distinct())
    seen = None
    while True:
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return current.select(F.col("v").alias("node"), F.col("u").alias("root"))
        seen = mark
        current = checkpointed(_small_star(_large_star(current)))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(
        edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
    )
    low = checkpointed(both.groupBy("x").agg(F.least("x", F.min("y")).alias("low")))
    out = both.where("y > x").join(low, "x").select(F.col("y").alias("v"), F.col("low").alias("u"))
    return checkpointed(out.distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    low = checkpointed(edges.groupBy("v").agg(F.min("u").alias("low")))
    moved = edges.join(low, "v").where("u <> low").select(F.col("u").alias("v"), F.col("low").alias("u"))
    return moved.unionByName(low.select("v", F.col("low").alias("u"))).distinct()
