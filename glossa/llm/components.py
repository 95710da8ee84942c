"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable; nodes without edges are absent.

    ``edges`` has columns a and b of one orderable type.  Each round hooks every node to the least
    node of its neighbourhood; rounds are about the logarithm of the longest path.  A round is grouped
    minima (combined before their shuffles) and joins, written below the checkpoint folder; nothing but a row
    count and a checksum reaches the driver.
    """
    e = written(edges.filter("a is not null and b is not null and a <> b")
                .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    seen = None
    for _ in range(most_rounds):
        # large star: neighbours above a node are hooked to the least of its neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        # small star: the neighbours below a node, and the node, are hooked to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.distinct().join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        e = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), name)
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
