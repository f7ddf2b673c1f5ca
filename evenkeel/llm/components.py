"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the least node that it reaches.

    Each round links every neighbour to the least of its neighbourhood, first the larger ones,
    then the smaller ones; the number of edges never grows and rounds go with the logarithm of
    the longest path. Both steps aggregate with map-side combining and join on the node, so that a
    node of very many edges is split by adaptive execution. Lineage is cut by a written table.
    """
    now = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    last = None
    for _ in range(rounds):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
        large = large.where("x <> y").distinct()
        # small star: of each node and its smaller neighbours, all go to the least one
        low = large.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
        floor = low.groupBy("x").agg(F.min("y").alias("m"))
        small = low.join(floor, "x").select(F.col("y").alias("p"), F.col("m").alias("q")).union(floor.select(F.col("x").alias("p"), F.col("m").alias("q")))
        now = cut(small.where("p <> q").select(F.col("q").alias("a"), F.col("p").alias("b")).distinct())
        sums = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (sums["n"], sums["h"]) == last:
            break
        last = (sums["n"], sums["h"])
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("node"), "root")
