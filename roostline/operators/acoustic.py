"""Metrics of acoustic station counts: ``date, species_id, n, total``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roostline.functions.student import correlation_p_value
from roostline.functions.text import week_start

MIN_TREND_DAYS = 6


def daily_totals(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The day's total per key, the largest where several pulls reported one."""
    return counts.groupBy(*keys, "date").agg(F.max("total").alias("total"))


def variation(totals: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sample deviation over mean of the daily totals, null for a single day."""
    ratio = F.stddev_samp("total") / F.nullif(F.avg("total"), F.lit(0.0))
    return totals.groupBy(*keys).agg(
        F.count("total").alias("days"), F.when(F.count("total") > 1, ratio).alias("cv")
    )


def yearly_trend(totals: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of the totals over the days of each year: slope, r and p-value.

    The origin of the day axis moves neither slope nor correlation, so the day of
    the year serves and no first date has to be found. Years with five days or
    fewer are left out.
    """
    x = F.dayofyear("date").cast("double")
    y = F.col("total").cast("double")
    fitted = totals.groupBy(*keys, F.year("date").alias("year")).agg(
        F.count("total").alias("days"),
        F.regr_slope(y, x).alias("slope"),
        F.covar_pop(y, x).alias("shared"),
        F.sqrt(F.var_pop(y) * F.var_pop(x)).alias("spread"),
    )
    # Without any variation the correlation is zero (``corr`` would divide by zero).
    ratio = F.col("shared") / F.nullif("spread", F.lit(0.0))
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(ratio, F.lit(0.0))))
    return (
        fitted.where(F.col("days") >= MIN_TREND_DAYS)
        .withColumn("r", r)
        .withColumn("p", correlation_p_value(F.col("r"), F.col("days")))
        .drop("shared", "spread")
    )


def summary(counts: DataFrame, species: str = "species_id", keys: Sequence[str] = ()) -> DataFrame:
    """Per key: distinct days, weeks and species, and the number of detections.

    Rows are first summed per day and species, so the distinct counts expand that
    small table and not the detections.
    """
    cells = counts.groupBy(*keys, "date", species).agg(F.sum("n").alias("n"))
    return cells.groupBy(*keys).agg(
        F.countDistinct("date").alias("days"),
        F.countDistinct(week_start(F.col("date"))).alias("weeks"),
        F.countDistinct(species).alias("species"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("detections"),
    )


def yearly_counts(device_daily: DataFrame, year: int | None = None) -> DataFrame:
    """Detections per device, year and species."""
    rows = device_daily
    if year is not None:
        rows = rows.where(F.col("date").between(F.make_date(F.lit(year), F.lit(1), F.lit(1)), F.make_date(F.lit(year), F.lit(12), F.lit(31))))
    return rows.groupBy("serial_code", F.year("date").alias("year"), "species_name").agg(F.sum("n").alias("n"))
