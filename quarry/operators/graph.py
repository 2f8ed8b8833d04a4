"""PageRank on the import multigraph (dangling mass is dropped), and reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.kept import kept

DAMPING, EPSILON, MOST_ROUNDS = 0.85, 1e-6, 100


def graph_nodes(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    out = edges.select(F.col("src").alias("path")).union(edges.select("dst"))
    return (out.union(nodes.select("path")) if nodes is not None else out).distinct()


def graph_counts(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    return graph_nodes(edges, nodes).agg(F.count(F.lit(1)).alias("nodes")).join(edges.agg(F.count(F.lit(1)).alias("edges")))


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, rounds: int | None = None, damping: float = DAMPING) -> DataFrame:
    """path, rank. Parallel edges count in share and out-degree; nodes without out-edges give nothing on.

    rounds: fixed number; else until the largest change is below 1e-6, 100 at most. Parallel edges are counted once as a
    weight, every few rounds the lineage is cut.
    """
    every = 8
    own = kept(graph_nodes(edges, nodes), "graph")
    n = own.count()
    if n == 0:
        return own.select("path", F.lit(0.0).alias("rank"))
    links = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))
    steps = kept(links.join(edges.groupBy("src").agg(F.count(F.lit(1)).alias("out")), "src").select("src", "dst", (F.col("w") / F.col("out")).alias("share")).repartition("src"), "graph")
    rank = own.select("path", F.lit(1.0 / n).alias("rank"))
    for k in range(rounds if rounds is not None else MOST_ROUNDS):
        given = steps.join(rank, F.col("src") == F.col("path")).groupBy(F.col("dst").alias("to")).agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        new = rank.join(given, F.col("path") == F.col("to"), "left").select("path", F.col("rank").alias("was"), (F.lit((1 - damping) / n) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if rounds is None or k % every == every - 1:
            new = kept(new, "graph")
        if rounds is None and new.agg(F.max(F.abs(F.col("rank") - F.col("was")))).first()[0] < EPSILON:
            return new.select("path", "rank")
        rank = new.select("path", "rank")
    return rank


def normalised(rank: DataFrame) -> DataFrame:
    most = F.broadcast(rank.agg(F.max("rank").alias("most")))
    return rank.join(most).select("path", F.when(F.col("most") > 0, F.col("rank") / F.col("most")).otherwise(F.col("rank")).alias("pagerank"))


def impact(edges: DataFrame, start: str, hops: int) -> DataFrame:
    """path, hops: files that import `start`, directly or through others, up to `hops` edges."""
    back = edges.select(F.col("dst").alias("a"), F.col("src").alias("b")).distinct()
    seen = front = edges.sparkSession.createDataFrame([(start, 0)], "path string, hops int")
    for k in range(1, hops + 1):
        front = back.join(front, back.a == front.path).select(F.col("b").alias("path")).distinct().join(seen, "path", "left_anti").select("path", F.lit(k).alias("hops"))
        seen = seen.unionByName(front)
    return seen
