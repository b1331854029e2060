"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafonda.session import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    low = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
    return both.where("dst > src").join(low, "src").where("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("src").agg(F.min("dst").alias("low"))
    joined = edges.join(low, "src")
    return joined.where("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst")).unionAll(low.select("src", F.col("low").alias("dst"))).distinct()


def _digest(edges: DataFrame) -> tuple:
    """Number and sum of hashes of distinct edges: the same for the same set."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) of an undirected graph (src, dst): component is the least node of the component.

    Edges are contracted to stars around least nodes: the large-star step moves every node's larger
    neighbours to its least neighbour, the small-star step its smaller ones, so the number of
    edges never grows and rounds stay logarithmic even on paths. Each round is written to the shared
    folder, so lineage is short and a lost executor costs one round. Loops and null ends are dropped.
    """
    current = materialise(edges.where("src is not null and dst is not null and src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "edges")
    for _ in range(max_rounds):
        following = materialise(_small_star(_large_star(current).select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))), "edges")
        settled = _digest(following) == _digest(current)
        current = following
        if settled:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return current.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionAll(current.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
