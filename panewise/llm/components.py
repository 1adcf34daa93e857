"""Connected components of an edge table, by alternating large and small stars.

Every round is two aggregations and joins on keys, written in the shared folder, so the links
never meet in one task or on the driver. The rounds grow with the logarithm of the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links every larger (or every smaller or equal) neighbour of a node with the least one."""
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    near = edges.union(turned) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    joined = near.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b); component is the least node reachable.
    Loops and repeated edges do no harm; nulls are left out; without edges the result is empty."""
    now = kept(edges.select("a", "b").where("a <> b").distinct(), "edges")
    mark = None
    while True:
        n = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if tuple(n) == mark or not n["n"]:
            break
        mark = tuple(n)
        now = kept(_star(_star(now, True), False), "star")
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.union(ends.select(F.col("component").alias("node"), "component").distinct())
