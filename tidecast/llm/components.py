"""Connected components of an edge table by alternating large and small stars.

Every round is a pair of grouped minima and joins over the edges; a vertex with
very many neighbours is combined before the shuffle and split by the skew join.
Edges live in tables of the shared folder; only two sums reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v).  Large star: every larger neighbour of u joins u's minimum;
    small star: u and its smaller neighbours join the minimum."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select(
            F.col("u").alias("at"), F.least("low", "u").alias("low"))
        moved = both.where("v > u").join(low, F.col("u") == F.col("at")).select(F.col("low").alias("u"), "v")
    else:  # here u > v
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("low")).withColumnRenamed("u", "at")
        moved = down.join(low, F.col("u") == F.col("at")).select(F.col("low").alias("u"), "v").unionByName(
            low.select(F.col("low").alias("u"), F.col("at").alias("v")))
    return moved.where("u <> v").select("u", "v").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(u, v) -> one row per vertex: node, component (the smallest vertex that it
    reaches).  Vertices without edges are not listed.  Columns may be of any
    ordered type; no edges give no rows."""
    now = shared_table(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
                       .distinct(), "links")
    mark = None
    while True:
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found[0] == 0 or tuple(found) == mark:
            break
        mark = tuple(found)
        now = shared_table(_star(_star(now, True), False), "links")
    leaves = now.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return leaves.unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
