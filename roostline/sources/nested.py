"""Landed API documents (JSON) to flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roostline.sources import schemas


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def station_daily(documents: DataFrame) -> DataFrame:
    """One row per date and species; the day's ``total`` repeats. An empty list gives no row."""
    days = documents.select(F.explode("dailyDetectionCounts").alias("d"))
    counts = days.select("d.date", "d.total", F.explode("d.counts").alias("c"))
    return counts.select(
        F.col("date").try_cast("date").alias("date"),
        F.col("c.key").alias("species_id"),
        F.col("c.count").alias("n"),
        "total",
    )


def device_daily(documents: DataFrame) -> DataFrame:
    """One row per species of a device's day, with the day's total.

    A document without species gives no row. Defaults stand in for *absent* keys.
    """

    def value(entry, key, default):
        return F.when(F.map_contains_key(entry, key), entry[key]).otherwise(F.lit(default))

    def count(entry):
        return value(entry, "count", "0").cast("bigint")

    total = F.aggregate("species", F.lit(0).cast("bigint"), lambda a, s: a + F.coalesce(count(s), F.lit(0)))
    rows = documents.select("date", "serial_code", total.alias("total"), F.explode("species").alias("s"))
    s = F.col("s")
    return rows.select(
        F.col("date").try_cast("date").alias("date"),
        "serial_code",
        value(s, "name", "Unknown").alias("species_name"),
        value(s, "scientific_name", "").alias("species_scientific"),
        count(s).alias("n"),
        F.col("total").alias("total_daily_detections"),
    )


def read_station_daily(spark: SparkSession, path: str) -> DataFrame:
    return station_daily(read_json(spark, path, schemas.STATION_DAILY_JSON))


def read_device_daily(spark: SparkSession, path: str) -> DataFrame:
    return device_daily(read_json(spark, path, schemas.DEVICE_DAILY_JSON))


def page_rows(pages: DataFrame, collection: str) -> DataFrame:
    """The rows of all result pages; a page without rows gives none."""
    return pages.select(F.explode(f"data.{collection}.nodes").alias("node")).select("node.*")


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    pages = read_json(spark, path, schemas.page_schema("stations", schemas.STATION_NODE))
    return page_rows(pages, "stations")


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    pages = read_json(spark, path, schemas.page_schema("detections", schemas.DETECTION_NODE))
    return flatten_detections(page_rows(pages, "detections"))


def flatten_detections(nodes: DataFrame) -> DataFrame:
    """Nested detection to sixteen flat columns; a missing sub-object gives nulls."""
    return nodes.select(
        "id", "timestamp", "certainty", "confidence", "probability", "score",
        F.col("coords.lat").alias("lat"),
        F.col("coords.lon").alias("lon"),
        F.col("species.commonName").alias("species_common"),
        F.col("species.scientificName").alias("species_scientific"),
        F.col("species.ebirdCode").alias("species_ebird"),
        F.col("station.id").alias("station_id"),
        F.col("station.name").alias("station_name"),
        F.col("soundscape.url").alias("sound_url"),
        F.col("soundscape.startTime").alias("sound_start"),
        F.col("soundscape.endTime").alias("sound_end"),
    )


def read_devices(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Device documents ``<serial>.json`` with their serial; empty documents are dropped."""
    docs = (
        spark.read.schema(schema)
        .option("multiLine", True)
        .json(path)
        .withColumn("serial_code", F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", ""))
    )
    return known_devices(docs)


def known_devices(docs: DataFrame) -> DataFrame:
    fields = [c for c in docs.columns if c != "serial_code"]
    return docs.na.drop("all", subset=fields)
