"""Connected components of an edge list, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the least node of its component.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each keeps connectivity and
    never adds edges; O(log n) rounds in practice.  Minima are aggregated before the shuffle, and the
    joins with them are plain equi-joins, so a node with very many neighbours can be split.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    now = checkpoint(edges.filter("a <> b").select(high.alias("a"), low.alias("b")).distinct())
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).withColumn("_m", F.least("a", "_m"))
        # large star: every larger neighbour of a node now points to the least of its neighbourhood
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()
        # small star: a node's smaller neighbours point to the least of them, and so does the node
        small = large.groupBy("a").agg(F.min("b").alias("_m"))
        star = large.join(small, "a").select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("_m").alias("b"))
        then = checkpoint(star.filter("a <> b").distinct())
        # done once no node has two parents and no parent has a parent
        twice = then.groupBy("a").count().filter("count > 1").limit(1)
        deep = then.join(then.select(F.col("a").alias("b")), "b", "left_semi").limit(1).select("a")
        if twice.select("a").unionByName(deep).isEmpty():
            roots = then.select("b").distinct()
            return then.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                roots.select(F.col("b").alias("node"), F.col("b").alias("root"))
            )
        now = then
