"""Flat tables: consolidated CSV files, Parquet, and their sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roostline.functions.text import blank, day_seconds, epoch_seconds, parse_date, strictly, visit_timestamp
from roostline.functions.timebins import minute_of_day
from roostline.session import staged
from roostline.sources import schemas
from roostline.sources.csv_files import DIALECT, read_csv


def _readable(value, source: str, what: str, strict: bool):
    return strictly(value, F.col(source), what) if strict else value


def typed_visits(raw: DataFrame, strict: bool = True) -> DataFrame:
    """Visit sheet columns to the library's names and types.

    Adds ``ts`` (zone-free, whole seconds), its epoch second ``sec`` and ``minute_of_day``; all three are null
    where the time is missing. A date or time that cannot be read fails the job; with ``strict=False``
    it becomes null, and ``visit_rejects`` tells which rows and why.
    """
    counts = [F.col(c).cast("bigint").alias(c) for c in schemas.VISIT_COUNTS]
    date = _readable(parse_date(F.col("Date")), "Date", "date", strict)
    ts = visit_timestamp(F.col("date"), F.col("time"))
    if strict:
        ts = F.when(F.col("date").isNotNull(), strictly(ts, F.col("time"), "time"))
    return (
        raw.select(
            date.alias("date"),
            F.col("source_sheet").alias("site"),
            F.col("Bird").alias("bird"),
            F.col("Time").alias("time"),
            *counts,
            F.col("Notes").alias("notes"),
            F.col("CoolDown").alias("cool_down"),
        )
        .withColumn("ts", ts)
        .withColumn("sec", epoch_seconds(F.col("ts")))
        .withColumn("minute_of_day", minute_of_day(F.col("ts")))
    )


def visit_rejects(raw: DataFrame) -> DataFrame:
    """The rows of a visit sheet with a date or time that cannot be read, and ``reason``: count them or mend them."""
    no_date = parse_date(F.col("Date")).isNull() & ~blank(F.col("Date"))
    no_time = day_seconds(F.col("Time")).isNull() & ~blank(F.col("Time"))
    reason = F.when(no_date, "unreadable date").when(no_time, "unreadable time")
    return raw.withColumn("reason", reason).where(F.col("reason").isNotNull())


def typed_daily(raw: DataFrame, strict: bool = True) -> DataFrame:
    return raw.select(
        _readable(parse_date(F.col("Date")), "Date", "date", strict).alias("date"),
        F.col("source_sheet").alias("site"),
        F.col("Bird").alias("bird"),
        F.col("Feeder Visits").cast("bigint").alias("visits"),
    )


def typed_phase_changes(raw: DataFrame) -> DataFrame:
    """Site and date are trimmed; a text that is not a date gives null."""
    return raw.select(
        F.trim("LocationOfChange").alias("site"),
        parse_date(F.col("DateChangeStarted")).alias("change_date"),
        F.col("DescriptionOfChange").alias("description"),
    )


def read_visits(spark: SparkSession, path: str, strict: bool = True, multi_line: bool = True) -> DataFrame:
    return typed_visits(read_csv(spark, path, schemas.VISITS_CSV, multi_line), strict)


def read_visit_rejects(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return visit_rejects(read_csv(spark, path, schemas.VISITS_CSV, multi_line))


def read_daily(spark: SparkSession, path: str, strict: bool = True, multi_line: bool = True) -> DataFrame:
    return typed_daily(read_csv(spark, path, schemas.DAILY_CSV, multi_line), strict)


def read_phase_changes(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return typed_phase_changes(read_csv(spark, path, schemas.PHASES_CSV, multi_line))


def identified(visits: DataFrame, id_column: str = "event_id") -> DataFrame:
    """Visits with a unique id, written once so that every later read sees the same ids."""
    return staged(visits.withColumn(id_column, F.monotonically_increasing_id()), "identified")


def read_migration(spark: SparkSession, path: str) -> DataFrame:
    """Nightly migration counts: three columns reach the scan, whatever else the file holds."""
    return spark.read.parquet(path).select(
        F.col("migration_start_utc").cast("timestamp_ntz").alias("migration_start_utc"),
        F.col("region_name"),
        F.col("total_birds").cast("double").alias("total_birds"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    """CSV folder with a header. Dates and timestamps keep their ISO text."""
    df.write.mode("overwrite").options(**DIALECT).csv(path)


def _overwrite(keep_others: bool) -> dict[str, str]:
    """Whether writing by key replaces the folders of the keys that come, or the whole folder."""
    return {"partitionOverwriteMode": "dynamic" if keep_others else "static"}


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), keep_others: bool = False) -> None:
    """Parquet folder. A hot partition value is spread over several files by the rebalance.

    ``keep_others`` replaces only the partitions that ``df`` has rows of, each when the job has succeeded.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    df.write.mode("overwrite").options(**_overwrite(keep_others and bool(partition_by))).partitionBy(*partition_by).parquet(path)


def write_csv_per_key(df: DataFrame, path: str, key: str, keep_others: bool = True) -> None:
    """One CSV folder per value of ``key``, data columns in name order.

    ``rebalance`` gathers the rows of a small key into few files and splits a key
    that holds much of the table over many. The folders of keys without a row in ``df`` stay as they are,
    as one county's file says nothing of another's; ``keep_others=False`` clears them.
    """
    columns = sorted(c for c in df.columns if c != key)
    (
        df.select(key, *columns)
        .hint("rebalance", key)
        .write.mode("overwrite")
        .partitionBy(key)
        .options(**DIALECT, **_overwrite(keep_others))
        .csv(path)
    )
