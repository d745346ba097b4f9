"""Connected components of an edge list, by alternating large-star and small-star steps on DataFrames.

Each step joins edges with the least neighbour of each node (pre-aggregated before its shuffle) and is written to the
shared folder; the edge list never grows past its first size and never leaves the executors. An edge is a row (a, b) with b < a, so a
step is one aggregation, one join and one distinct: its plan, which the driver holds, stays small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, forget


def _large_star(edges: DataFrame) -> DataFrame:
    """Links the upper end of each edge to the least of its lower end and all of that one's neighbours."""
    ends = edges.select(F.col("b").alias("node"), F.least("a", "b").alias("m")).unionByName(edges.select(F.col("a").alias("node"), F.col("b").alias("m")))
    least = ends.groupBy("node").agg(F.min("m").alias("m"))
    return edges.join(least, F.col("b") == F.col("node")).select("a", F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its lower neighbours to the least of these."""
    least = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    # The edge to the least neighbour stands for the node itself, every other one for the neighbour.
    return edges.join(least, F.col("a") == F.col("node")).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()


def _seen(edges: DataFrame) -> tuple:
    """The number of edges and a sum of their hashes, which tell whether the set of edges has changed."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b); root is the least node that it is linked to."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    last = _seen(now)
    if not last[0]:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while True:
        for star in (_large_star, _small_star):
            before, now = now, cut(star(now), "stars")
            forget(before)
        seen = _seen(now)
        if seen == last:
            break
        last = seen
    found = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
