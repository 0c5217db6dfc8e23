"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roostline.session import staged


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and the ``root`` (least node) of its component, for all nodes of ``edges`` (u, v: bigint) but the roots.

    A round hangs all larger neighbours of a node below its least neighbour, then all smaller ones.
    Both sum up by node before the shuffle and join back on it, so that a hub is a skewed join and not one
    group. Every round is a written table: a lost executor costs a reread, plans stay short. The number
    of rounds grows with the logarithm of the longest path.
    """
    state = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    state, before = staged(state, "edges"), None
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least_neighbour(both)
        large = both.join(least, F.col("u") == F.col("c")).where("v > u")
        large = large.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u > v").distinct()
        smallest = _least_neighbour(large)
        small = large.join(smallest, F.col("u") == F.col("c"))
        small = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
        state = staged(small.where("u > v").distinct(), "edges")
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
