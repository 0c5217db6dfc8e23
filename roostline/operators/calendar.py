"""Calendar completion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fill_days(series: DataFrame, keys: Sequence[str] = ("site",), date: str = "date") -> DataFrame:
    """Every day between the first and last of each key; numbers 0, other columns null on new days.

    Each row lays out its own day and the empty ones up to the next row of its
    key. That takes one window over day-level rows and no join with a calendar.
    Several rows on one day are all kept.
    """
    w = Window.partitionBy(*keys).orderBy(date)
    day = F.col(date)
    stop = F.greatest(day, F.date_sub(F.coalesce(F.lead(date).over(w), F.date_add(day, 1)), 1))
    ranges = series.where(day.isNotNull()).withColumn("__days", F.sequence(day, stop))
    days = ranges.withColumn("__day", F.explode("__days"))
    own = F.col("__day") == day
    columns = []
    for field in series.schema.fields:
        if field.name in keys:
            columns.append(F.col(field.name))
        elif field.name == date:
            columns.append(F.col("__day").alias(date))
        elif isinstance(field.dataType, T.NumericType):
            value = F.when(own, F.col(field.name))
            columns.append(F.coalesce(value, F.lit(0).cast(field.dataType)).alias(field.name))
        else:
            columns.append(F.when(own, F.col(field.name)).alias(field.name))
    return days.select(*columns)


def coverage(devices: DataFrame, first: str, last: str, key: str = "serial_code") -> DataFrame:
    """Each device on each day of the closed period: the plan of what should be there."""
    days = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return devices.select(key).distinct().select(key, F.explode(days).alias("date"))


def coverage_gaps(planned: DataFrame, observed: DataFrame, key: str = "serial_code") -> DataFrame:
    """Planned (device, date) pairs without any row."""
    return planned.join(observed.select(key, "date"), [key, "date"], "left_anti")


def days_between(bounds: DataFrame, first: str, last: str) -> DataFrame:
    """One row per day of each closed range."""
    kept = [c for c in bounds.columns if c not in (first, last)]
    return bounds.select(*kept, F.explode(F.sequence(F.col(first), F.col(last))).alias("date"))
