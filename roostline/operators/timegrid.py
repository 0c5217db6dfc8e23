"""Date by time-of-day grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roostline.functions.timebins import TimeBins

SITE_DATE = ("site", "date")


def bin_counts(visits: DataFrame, bins: TimeBins = TimeBins(), keys: Sequence[str] = SITE_DATE) -> DataFrame:
    """Visits per key and time bin; rows without a time are left out."""
    return (
        visits.select(*keys, bins.assign(F.col("minute_of_day")).alias("time_bin"))
        .where(F.col("time_bin").isNotNull())
        .na.drop(subset=list(keys))
        .groupBy(*keys, "time_bin")
        .agg(F.count("*").alias("n"))
    )


def dense_grid(visits: DataFrame, bins: TimeBins = TimeBins(), keys: Sequence[str] = SITE_DATE) -> DataFrame:
    """Every bin of every observed date, zero where nothing came, with label and day share.

    A day's counts (at most one entry per bin) are gathered into a map and laid out
    again over all bins. So the visits are read once, and neither a grid nor a
    second pass for the dates has to be joined. ``proportion`` is the bin's share
    of its day, rounded half-even to two places.
    """
    day = bin_counts(visits, bins, keys).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("time_bin", "n"))).alias("__counts"),
        F.sum("n").alias("day_total"),
    )
    every_bin = F.sequence(F.lit(0), F.lit(bins.count - 1))
    laid_out = day.select(*keys, "day_total", "__counts", F.explode(every_bin).alias("time_bin"))
    n = F.coalesce(F.try_element_at("__counts", F.col("time_bin")), F.lit(0))
    return laid_out.select(
        *keys,
        "time_bin",
        bins.label(F.col("time_bin")).alias("label"),
        n.cast("bigint").alias("n"),
        "day_total",
        F.bround(n / F.col("day_total"), 2).alias("proportion"),
    )
