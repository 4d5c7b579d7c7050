"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgate.staging import stage

MAX_ROUNDS = 60  # far above the logarithmic number that is needed; reaching it raises


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node that it reaches, itself included.

    Each round points every node to the smallest node around it, first from the larger neighbours, then from the smaller
    ones. Only edges are stored, each round is a written table, and the minimum per node is combined before the shuffle. No
    component is ever gathered in one place. Edges with a null end and edges from a node to itself are ignored.
    """
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    facts = _facts(now)
    for _ in range(MAX_ROUNDS):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: larger neighbours go to the smallest node around
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: smaller neighbours and the node itself go to the smallest neighbour
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        after = stage(small.where("a <> b").distinct())
        if (new := _facts(after)) == facts:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        now, facts = after, new
    raise RuntimeError("components did not settle")


def _facts(edges: DataFrame) -> tuple:
    """What tells tables of distinct edges apart: the number of rows and two independent sums over them."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.hash("a", "b").cast("long"))).first())
