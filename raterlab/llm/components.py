"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raterlab.llm.common import drop_tables, scratch_table


def _stars(edges: DataFrame) -> bool:
    """Whether every node is either a centre or hangs on one centre alone."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not ends.filter("up > 1 or (up > 0 and down > 0)").take(1)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b; long): the smallest node that
    links reach. Each step groups edges by node (pre-aggregated minimum) and joins it back, so a
    node with very many links never has to be held in one place; steps end when only stars are
    left, and their number grows with the logarithm of the components' size."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = scratch_table(edges, "edges")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        # large star: larger neighbours move to the smallest neighbour
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # small star: smaller neighbours and the node itself move to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.filter("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges, last = scratch_table(small, "edges"), edges
        drop_tables(last)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
