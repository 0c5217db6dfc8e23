"""From a landed workbook to the three consolidated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roostline.functions.text import site_key_from_sheet
from roostline.operators.cleaning import drop_subtotals, union_by_name, unpivot_species
from roostline.sources import schemas
from roostline.sources.sheets import read_layouts, select_sheets


def _with_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` in the given column order, missing columns null."""
    return df.select(
        *[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]
    )


def raw_visits(spark: SparkSession, folder: str, word: str = "raw") -> DataFrame:
    """All visit sheets as one table in canonical column order, ``source_sheet`` as site key."""
    frames = [
        _with_columns(f.withColumn("source_sheet", site_key_from_sheet(F.col("source_sheet"))), schemas.VISITS_COLUMNS)
        for f in read_layouts(spark, select_sheets(spark, folder, word))
    ]
    table = union_by_name(frames)
    for c in schemas.VISIT_COUNTS:
        table = table.withColumn(c, F.col(c).try_cast("double"))
    return table


def count_rejects(spark: SparkSession, folder: str, word: str = "raw") -> DataFrame:
    """Cells of count columns that hold no number: source_sheet, column, value and how often.

    ``raw_visits`` and ``daily_summaries`` leave such cells empty and keep the rest of the row.
    """
    frames = []
    for sheet in read_layouts(spark, select_sheets(spark, folder, word)):
        text = {"Date", "Bird", "Time", "Notes", "CoolDown", "source_sheet"}
        cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in sheet.columns if c not in text]
        if cells:
            frames.append(sheet.select("source_sheet", F.explode(F.array(*cells)).alias("cell")).select("source_sheet", "cell.*"))
    bad = union_by_name(frames).where(F.col("value").isNotNull() & F.col("value").try_cast("double").isNull())
    return bad.groupBy("source_sheet", "column", "value").agg(F.count("*").alias("n"))


def daily_summaries(spark: SparkSession, folder: str, word: str = "daily") -> DataFrame:
    """All daily sheets as one long table.

    A sheet without a ``Bird`` column is wide: its species columns become rows and
    its subtotal rows are dropped.
    """
    frames = []
    for sheet in read_layouts(spark, select_sheets(spark, folder, word)):
        if "Bird" not in sheet.columns:
            sheet = drop_subtotals(unpivot_species(sheet))
        else:
            sheet = sheet.withColumn("Feeder Visits", F.col("`Feeder Visits`").try_cast("double"))
        frames.append(_with_columns(sheet, schemas.DAILY_COLUMNS))
    return union_by_name(frames)


def phase_sheet(spark: SparkSession, folder: str, word: str = "phasechanges") -> DataFrame:
    frames = read_layouts(spark, select_sheets(spark, folder, word))
    return union_by_name(frames).select("LocationOfChange", "DateChangeStarted", "DescriptionOfChange")
