"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, most: int = 60) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the smallest node that links reach.

    Each round points neighbours at the smallest node known; a node's neighbours are only aggregated (min), never
    collected, so a hub with a third of all edges is pre-aggregated on the map side. Stops when a round changes nothing.
    """
    now = scratch.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    for _ in range(most):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        new = scratch.keep(small)
        mark = [x.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first() for x in (now, new)]
        scratch.drop(now)
        now = new
        if mark[0] == mark[1]:
            break
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
