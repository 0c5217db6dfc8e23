"""Whole jobs over acoustic counts: from landed counts to the tables of a report, for any number of regions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roostline.operators import acoustic, diversity
from roostline.plans.analyses import acoustic_daily
from roostline.session import once, scratch
from roostline.sources.tables import write_csv


def station_report(counts: DataFrame, keys: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The tables of a station report per key, from ``date, species_id, n, total``.

    ``daily``: total, richness and Shannon H; ``weekly``: dissimilarity of each week to the one before; ``trends``:
    the line of each year's totals; ``summary``: days, weeks, species, detections and the variation of the totals.
    """
    keys = list(keys)
    cells = once(counts.groupBy(*keys, "date", "species_id").agg(F.sum("n").alias("n"), F.max("total").alias("total")), "station-counts")
    totals = acoustic.daily_totals(cells, keys)
    birds = cells.select(*keys, "date", F.col("species_id").alias("bird"), F.col("n").alias("visits"))
    presence = diversity.weekly_presence(diversity.species_days(birds, keys), keys, "week_start")
    weekly = diversity.consecutive_weeks(diversity.weekly_sorensen(presence, keys))
    sums, spread = acoustic.summary(cells, keys=keys), acoustic.variation(totals, keys).select(*keys, "cv")
    both = sums.join(spread, keys, "left") if keys else sums.withColumn("cv", spread.scalar())
    return {"daily": acoustic_daily(cells, keys), "weekly": weekly, "trends": acoustic.yearly_trend(totals, keys), "summary": both}


def write_station_report(counts: DataFrame, path: str, keys: Sequence[str] = ()) -> None:
    """Writes the daily, weekly and yearly tables and the summary as CSV folders; nothing staged is left behind."""
    with scratch(counts.sparkSession, "station-report"):
        for name, table in station_report(counts, keys).items():
            write_csv(table, f"{path}/{name}")


def write_device_report(daily: DataFrame, path: str) -> None:
    """Writes the counts of all devices, sorted within files by date and species, and a summary per device.

    ``daily``: date, serial_code, species_name, n, and whatever else a document had.
    """
    ordered = daily.where(F.col("date").isNotNull()).repartitionByRange("date", "species_name").sortWithinPartitions("date", "species_name")
    write_csv(ordered, f"{path}/daily")
    write_csv(acoustic.summary(daily, "species_name", ["serial_code"]), f"{path}/summary")
