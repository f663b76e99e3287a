"""Connected components of an undirected graph as bounded DataFrame iterations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.sources.tables import materialise


def connected_components(pairs: DataFrame) -> DataFrame:
    """(node, component) for each node of (a, b): component is the least node that is connected with it.

    Large-star / small-star: each round links every node's neighbours to the least
    of them, so long chains shrink by a factor a round and a node with many
    neighbours needs no row per pair of them. Null ends are left out; repeated
    pairs and self-loops change nothing. It ends when a round leaves all links as they
    were.
    """
    first = pairs.columns
    edges = pairs.select(F.col(first[0]).alias("a"), F.col(first[1]).alias("b")).where("a is not null and b is not null")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b")))
        edges = materialise(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if before == tuple(now):
            break
        before = tuple(now)
    found = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
