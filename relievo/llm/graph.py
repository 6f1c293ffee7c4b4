"""Connected components of an undirected graph, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """(node, root): the smallest node of its component for every node that has an edge.

    Alternates two steps until nothing changes: every node hangs its larger neighbours on its
    smallest neighbour, then its smaller ones. Both steps are an aggregation for the smallest
    neighbour, which combines before it shuffles, and a join back that Spark can split, so a star
    with very many leaves is not gathered anywhere. Rounds grow with the logarithm of the longest
    path. Each round is written to the shared folder, which keeps plans short and survives lost
    executors. Loops and repeated edges do no harm.
    """
    def rooted(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("n"), F.col("b").alias("m"))
        if large:
            both = both.unionByName(e.select(F.col("b").alias("n"), F.col("a").alias("m")))
        least = both.groupBy("n").agg(F.min("m").alias("r")).select("n", F.least("n", "r").alias("r"))
        hung = both.join(least, "n")
        if large:
            out = hung.where("m > n").select(F.col("m").alias("a"), F.col("r").alias("b"))
        else:
            out = hung.select(F.col("m").alias("a"), F.col("r").alias("b")).unionByName(
                least.select(F.col("n").alias("a"), F.col("r").alias("b")))
        return out.where("a <> b").distinct()

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = stored(edges.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).where("a <> b").distinct(), "graph")
    seen = state(now)
    while seen[0]:
        # In both steps an edge runs from the larger node `a` to the smaller node `b`.
        now = stored(rooted(rooted(now, True), False), "graph")
        fresh = state(now)
        if fresh == seen:
            break
        seen = fresh
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
