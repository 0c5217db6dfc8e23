"""Empirical survivor curves, kept as runs of ranks that share an interval length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roostline.functions import curves

CHUNK = 100_000


def survivor_runs(histogram: DataFrame, keys: Sequence[str] = ("site",)) -> DataFrame:
    """One row per distinct interval: its ranks, heights and the means a fit needs.

    Point ``i`` of ``n`` ascending intervals has height ``(n - i + 1) / n``; ties
    take consecutive ranks. In a run, ``k = n - rank + 1`` goes from ``k_lo`` to
    ``k_hi``. The window holds the distinct intervals of one key, whose number
    the key's time span bounds.
    """
    line = Window.partitionBy(*keys).orderBy(F.col("gap_s").desc())
    longer = line.rowsBetween(Window.unboundedPreceding, 0)
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = histogram.select(
        *keys,
        "gap_s",
        (F.col("gap_s") / 60.0).alias("t"),
        F.col("n").alias("m"),
        F.sum("n").over(longer).alias("k_hi"),
        F.sum("n").over(whole).alias("n"),
    ).withColumn("k_lo", F.col("k_hi") - F.col("m") + 1)
    lo, hi, n = F.col("k_lo"), F.col("k_hi"), F.col("n")
    return ranked.select(
        *keys, "gap_s", "t", "m", "k_lo", "k_hi", "n", curves.run_mean(lo, hi, n).alias("mean_y")
    )


def survivor_points(runs: DataFrame, keys: Sequence[str] = ("site",)) -> DataFrame:
    """Every point of the curves: ``(keys, t, rank, survivor)``.

    A run is first cut into chunks, which are spread over the cluster before
    they are laid out, so that one value with most of the rows is not one task's.
    """
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1, F.lit(CHUNK).cast("bigint"))
    chunks = runs.select(*keys, "t", "m", "k_hi", "n", F.explode(starts).alias("at")).hint("rebalance")
    stop = F.least(F.col("at") + CHUNK, F.col("m")) - 1
    points = chunks.select(*keys, "t", "k_hi", "n", F.explode(F.sequence("at", stop)).alias("i"))
    k = F.col("k_hi") - F.col("i")
    return points.select(
        *keys, "t", (F.col("n") - k + 1).alias("rank"), (k / F.col("n")).alias("survivor")
    )
