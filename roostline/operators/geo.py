"""Bounding boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roostline.session import staged

# Cells of level n are 2**n degrees wide. A box takes the level at which it touches at most three cells in
# either direction; a centimetre and the whole globe are the ends of the scale.
LEVELS = (-24, 8)
CORNERS = ("sw_lat", "ne_lat", "sw_lon", "ne_lon")


def _cell(degrees: Column, level: Column) -> Column:
    return F.floor(degrees * F.pow(F.lit(2.0), -level))


def _pieces(boxes: DataFrame, key: str) -> DataFrame:
    """Boxes with west and east in order: one that goes over the date line is two, from its west to 180 and from -180 to its east."""
    west, east = F.col("sw_lon"), F.col("ne_lon")
    span = lambda a, b: F.struct(a.cast("double").alias("w"), b.cast("double").alias("e"))
    halves = F.array(span(west, F.lit(180.0)), span(F.lit(-180.0), east))
    lon = F.explode(F.when(west <= east, F.array(span(west, east))).when(west > east, halves))
    cut = boxes.where(F.col("sw_lat") <= F.col("ne_lat")).select(key, "sw_lat", "ne_lat", lon.alias("__lon"))
    return cut.select(key, "sw_lat", "ne_lat", F.col("__lon.w").alias("sw_lon"), F.col("__lon.e").alias("ne_lon"))


def covering_cells(boxes: DataFrame, key: str = "county") -> DataFrame:
    """The cells (``__level``, ``__y``, ``__x``) that cover each box, nine at most for each piece of it."""
    pieces = _pieces(boxes, key)
    extent = F.greatest(F.col("ne_lat") - F.col("sw_lat"), F.col("ne_lon") - F.col("sw_lon"))
    low, high = LEVELS
    level = F.when(extent > 0, F.least(F.greatest(F.ceil(F.log2(extent) - 1), F.lit(low)), F.lit(high))).otherwise(low).cast("int")
    placed = pieces.withColumn("__level", level)
    range_of = lambda a, b: F.sequence(_cell(F.col(a), F.col("__level")), _cell(F.col(b), F.col("__level")))
    rows = placed.withColumn("__y", F.explode(range_of("sw_lat", "ne_lat")))
    return rows.withColumn("__x", F.explode(range_of("sw_lon", "ne_lon"))).select(key, *CORNERS, "__level", "__y", "__x")


def within_boxes(points: DataFrame, boxes: DataFrame, key: str = "county", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Each point once per box (``key, sw_lat, ne_lat, sw_lon, ne_lon``) that contains it, edges included.

    Boxes are covered by cells of a level that fits their size, and joined to points on level and cell, then tested
    exactly. So the join has equality keys: it needs no nested loop, works shuffled as well as broadcast, and a
    crowded cell can be split by AQE. A point is looked up once for each level that some box has. A box whose
    west is greater than its east goes over the date line; one with a null or with south above north holds nothing.
    """
    cells = staged(covering_cells(boxes, key), "cells")
    levels = sorted(r["__level"] for r in cells.select("__level").distinct().collect())
    at = [F.struct(F.lit(n).alias("l"), _cell(F.col(lat), F.lit(n)).alias("y"), _cell(F.col(lon), F.lit(n)).alias("x")) for n in levels]
    none = F.array().cast("array<struct<l: int, y: bigint, x: bigint>>")
    placed = points.withColumn("__c", F.explode(F.array(*at) if at else none) if len(at) != 1 else at[0])
    joined = placed.join(cells, (F.col("__c.l") == F.col("__level")) & (F.col("__c.y") == F.col("__y")) & (F.col("__c.x") == F.col("__x")))
    inside = F.col(lat).between(F.col("sw_lat"), F.col("ne_lat")) & F.col(lon).between(F.col("sw_lon"), F.col("ne_lon"))
    return joined.where(inside).select(key, *points.columns)
