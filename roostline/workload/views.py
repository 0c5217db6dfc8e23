"""The driver tables seen as visits, daily summaries, migration nights and detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roostline.functions.text import epoch_seconds, whole_seconds
from roostline.functions.timebins import minute_of_day

SPECIES = 25


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def visits(spark: SparkSession, folder: str) -> DataFrame:
    """One visit per event; the species of one user in 25 is unknown."""
    number = F.col("user_id") % SPECIES
    bird = F.when(number != SPECIES - 1, F.concat(F.lit("sp"), F.lpad(number.cast("string"), 2, "0")))
    return table(spark, folder, "events").select(
        "event_id",
        F.col("ts").cast("date").alias("date"),
        whole_seconds(F.col("ts")).alias("ts"),
        epoch_seconds(F.col("ts")).alias("sec"),
        minute_of_day(F.col("ts")).alias("minute_of_day"),
        F.col("event_type").alias("site"),
        bird.alias("bird"),
        "value",
    )


def daily(spark: SparkSession, folder: str) -> DataFrame:
    """Visits per day, site and species; rows of zero are part of it."""
    return visits(spark, folder).groupBy("date", "site", "bird").agg(
        F.sum(F.when(F.col("value") >= 30, 1).otherwise(0)).alias("visits")
    )


UNKNOWN = "unknown"


def named_daily(spark: SparkSession, folder: str) -> DataFrame:
    """``daily`` with a name for the species that has none, for steps that need one on every row."""
    return daily(spark, folder).withColumn("bird", F.coalesce("bird", F.lit(UNKNOWN)))


def species_names() -> list[str]:
    return [f"sp{i:02d}" for i in range(SPECIES - 1)] + [UNKNOWN]


def phase_changes(spark: SparkSession) -> DataFrame:
    rows = [
        ("click", "2024-01-10", "Extinction"),
        ("click", "2024-01-20", "Seed returned"),
        ("view", "2024-01-15", "No seed"),
        ("purchase", "2024-01-08", "Seed extinction"),
        ("purchase", "2023-12-01", "Seed"),
        ("error", "2024-02-15", "Extinct"),
    ]
    raw = spark.createDataFrame(rows, "site STRING, d STRING, description STRING")
    return raw.select("site", F.col("d").cast("date").alias("change_date"), "description")


def migration(spark: SparkSession, folder: str) -> DataFrame:
    night = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 25).cast("int"))
    region = F.concat(F.lit("region-"), F.col("o_orderpriority"))
    return (
        table(spark, folder, "orders")
        .groupBy(night.alias("night"), region.alias("region_name"))
        .agg((F.count("*") * 1000).alias("total_birds"))
    )


def region_map(spark: SparkSession) -> DataFrame:
    rows = [("region-1-URGENT", "click"), ("region-2-HIGH", "view"), ("region-3-MEDIUM", "purchase")]
    return spark.createDataFrame(rows, "from_value STRING, to_value STRING")


def station_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Counts per day and species of a station network, with the day's total on every row."""
    species = F.concat(F.lit("s"), (F.col("o_custkey") % 17).cast("string"))
    counts = (
        table(spark, folder, "orders")
        .groupBy(F.col("o_orderdate").cast("date").alias("date"), species.alias("species_id"))
        .agg(F.count("*").alias("n"))
    )
    # A window of one day's species, at most.
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy("date")))


def device_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Counts per device (site), day and species."""
    species = F.coalesce("bird", F.lit(UNKNOWN)).alias("species_name")
    return visits(spark, folder).groupBy("date", F.col("site").alias("serial_code"), species).agg(
        F.count("*").alias("n")
    )


def boxes(spark: SparkSession) -> DataFrame:
    rows = [("a", 30.00, 30.65, -82.10, -81.20), ("b", 29.55, 30.25, -81.80, -81.05)]
    return spark.createDataFrame(
        rows, "county STRING, sw_lat DOUBLE, ne_lat DOUBLE, sw_lon DOUBLE, ne_lon DOUBLE"
    )


def detections(spark: SparkSession, folder: str) -> DataFrame:
    # Decimal steps, so that a point on the edge of a box is exactly on it.
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        F.expr("CAST(29.4 + (event_id % 140) * 0.01 AS DOUBLE)").alias("lat"),
        F.expr("CAST(-82.2 + (user_id % 130) * 0.01 AS DOUBLE)").alias("lon"),
        F.col("event_type").alias("species_common"),
        (F.col("user_id") % 20).cast("string").alias("station_id"),
    )


def styles(spark: SparkSession) -> DataFrame:
    rows = [
        ("sp00", "#DC143C", "#DC143C", "#DC143C", "o"),
        ("sp01", "#000000", "#FFFFFF", "black", "o"),
        ("sp02", "#708090", "#708090", "black", "^"),
        ("sp03", "#4169E1", None, None, None),
    ]
    return spark.createDataFrame(rows, "bird STRING, color STRING, fill STRING, edge STRING, marker STRING")
