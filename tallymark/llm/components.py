"""Connected components of an edge table, wholly distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b); a component is its least node.

    Alternates two rewirings until only stars are left: each node hands its larger neighbours to its least one, then its
    smaller neighbours and itself.  Both are a minimum per node, pre-aggregated in each task, and a join back, which
    adaptive execution splits where one node has very many edges.  The number of rounds follows the logarithm of the
    components' extents.
    """
    links = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while not _only_stars(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stored(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .filter("u <> v")
            .distinct()
        )
        links = stored(small, "links")
    centers = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centers)


def _only_stars(links: DataFrame) -> bool:
    """Whether every node is either the end of one link or a center: its component is then its least node."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    sums = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return sums.filter("out > 1 or (out > 0 and into > 0)").isEmpty()
