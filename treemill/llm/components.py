"""Connected components of a graph given as pairs, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treemill.llm.common import settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours linked to the least of them and itself: the larger, or the others."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    centre = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = both.join(centre, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(centre.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """node and component (the least node reachable) for each node in ``pairs`` (a, b).

    Pairs may repeat, point either way or to themselves.  Every round's minima are pre-aggregated
    before the shuffle and its result is checkpointed; the rounds end when the pairs stay as
    they were, after about the logarithm of the longest path.
    """
    edges = settle(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (now["n"], now["s"]) == mark or not now["n"]:
            break
        mark = now["n"], now["s"]
        edges = settle(_star(_star(edges, large=True), large=False))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
