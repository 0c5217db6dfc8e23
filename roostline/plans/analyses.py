"""The analyses a report is made of: one function each, tables in, table out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roostline.functions.text import SEED
from roostline.operators import calendar, diversity, fitting, phases, survival
from roostline.operators.cleaning import remap, since
from roostline.operators.intervals import interval_histogram
from roostline.session import staged


def diversity_metrics(daily: DataFrame, stage: bool = True) -> DataFrame:
    """Richness, Shannon H, weekly and rolling dissimilarity per date and site.

    All four follow from one aggregate, ``species_days``. It is written once
    (``stage``), so ``daily`` is scanned once and not by every metric.
    """
    base = diversity.species_days(daily)
    if stage:
        base = staged(base, "species-days")
    merged = diversity.merge_metrics(
        [
            diversity.alpha_diversity(base),
            diversity.weekly_sorensen_by_date(base),
            diversity.rolling_sorensen(base),
        ]
    )
    return merged.select("date", "site", "richness", "shannon_h", "sorensen", "rolling_sorensen")


def nightly_by_site(
    migration: DataFrame, regions: DataFrame, after: str | None = None, start: str = "migration_start_utc"
) -> DataFrame:
    """Migration nights ``date, site, millions`` with regions mapped to sites.

    ``after`` is a strict lower bound on the raw ``start`` column. Nights of
    unmapped regions have no site.
    """
    rows = since(migration, start, after, strict=True) if after else migration
    mapped = remap(rows, "region_name", regions)
    return mapped.select(
        F.col(start).cast("date").alias("date"),
        F.col("region_name").alias("site"),
        (F.col("total_birds") / 1e6).alias("millions"),
    )


def migration_overlay(
    daily: DataFrame,
    migration: DataFrame,
    regions: DataFrame,
    changes: DataFrame,
    after: str | None = None,
    start: str = "migration_start_utc",
) -> DataFrame:
    """Daily site totals beside the night's migration, split at phase changes.

    Every night row of a day is kept, so a day with two nights appears twice.
    """
    totals = diversity.site_totals(daily)
    nights = nightly_by_site(migration, regions, after, start).where(F.col("site").isNotNull())
    joined = totals.join(nights, ["date", "site"], "left")
    return phases.segments(joined, changes)


def baseline_series(daily: DataFrame, changes: DataFrame, start: str | None = None) -> DataFrame:
    """Gap-free daily site totals plus one (for a log axis), split at phase changes."""
    totals = diversity.site_totals(daily)
    if start:
        totals = since(totals, "date", start)
    filled = calendar.fill_days(totals)
    offset = filled.withColumn("visits_plus_one", F.col("visits") + 1)
    return phases.segments(offset, changes)


def bout_fits(
    visits: DataFrame, plans: dict[str, fitting.FitPlan], keys: Sequence[str] = ("site",), min_rows: int = 0
) -> DataFrame:
    """Survivor-curve fits of every key with R2 and MAE, one row per key and plan.

    The runs are written once: they are small, and the histogram behind them
    reads every visit.
    """
    runs = staged(survival.survivor_runs(interval_histogram(visits, keys, min_rows), keys), "runs")
    params = fitting.fit_all(runs, plans, keys)
    return fitting.with_quality(runs, params, keys, F.col("log_space"))


def bout_points(visits: DataFrame, changes: DataFrame, baseline: str = SEED) -> DataFrame:
    """Observed survivor points per site with the condition of their visit, as runs.

    ``(site, t, condition, m, survivor_top, n)``: ``m`` intervals of length ``t``
    ended under ``condition``; ``survivor_top`` is the height of the first of
    their length. The condition depends on site and date only, so intervals are
    counted per day before it is joined.
    """
    per_day = interval_histogram(visits, by_date=True)
    labelled = phases.condition_in_force(per_day, changes, baseline=baseline)
    parts = labelled.groupBy("site", "gap_s", "condition").agg(F.sum("n").alias("m"))
    histogram = parts.groupBy("site", "gap_s").agg(F.sum("m").alias("n"))
    runs = survival.survivor_runs(histogram).select("site", "gap_s", "t", "k_hi", "n")
    return parts.join(runs, ["site", "gap_s"]).select(
        "site", "t", "condition", "m", (F.col("k_hi") / F.col("n")).alias("survivor_top"), "n"
    )


def acoustic_daily(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Total, richness and Shannon H per key and date of station counts, in one aggregation.

    ``counts`` has ``date, species_id, n, total`` and is first summed per date and species.
    """
    cells = counts.where(F.col("date").isNotNull()).groupBy(*keys, "date", F.col("species_id").alias("bird")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("visits"),
        F.max("total").alias("total"),
    )
    return diversity.alpha_diversity(
        cells, keys=keys, positive_only=False, extra=[F.max("total").alias("total")]
    )
