"""Species catalogue: display attributes of a species."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_COLOR = "#808080"
DEFAULT_EDGE = "black"
DEFAULT_MARKER = "o"


def with_styles(df: DataFrame, styles: DataFrame) -> DataFrame:
    """Add ``color, fill, edge, marker`` from ``styles(bird, ...)``; unknown species get defaults."""
    joined = df.join(styles.select("bird", "color", "fill", "edge", "marker"), "bird", "left")
    color = F.coalesce("color", F.lit(DEFAULT_COLOR))
    return (
        joined.withColumn("fill", F.coalesce("fill", "color", F.lit(DEFAULT_COLOR)))
        .withColumn("color", color)
        .withColumn("edge", F.coalesce("edge", F.lit(DEFAULT_EDGE)))
        .withColumn("marker", F.coalesce("marker", F.lit(DEFAULT_MARKER)))
    )


def unstyled(df: DataFrame, styles: DataFrame) -> DataFrame:
    """Observed species without a catalogue entry."""
    seen = df.select("bird").where(F.col("bird").isNotNull()).distinct()
    return seen.join(styles.select("bird"), "bird", "left_anti")
