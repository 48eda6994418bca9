"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, discard


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of ``edges(a, b)``: component is the smallest node reachable.

    Each round is one minimum per node, joined back to the node's edges, and written to the shared folder; nothing is
    gathered per node, so a hub of any degree is split like any skewed join. The rounds end when all that is left is
    stars, which one aggregate with map-side combine tells.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        old, now = now, cut(small, "edges")
        discard(old)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def stars(edges: DataFrame) -> bool:
    """Whether each u of ``edges(u, v)``, u > v, has one edge, and none to it: the centres are the smallest nodes then."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("ups"), F.lit(0).alias("downs")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("ups"), F.lit(1).alias("downs")))
    return ends.groupBy("node").agg(F.sum("ups").alias("ups"), F.max("downs").alias("downs")).where("ups > 1 or (ups = 1 and downs = 1)").isEmpty()
