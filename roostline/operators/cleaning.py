"""Projection, remapping, filtering and reshaping of the input tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remap(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Replace ``column`` through ``mapping(from_value, to_value)``; unmapped values become null.

    A left join on one row per value. Whether the mapping is broadcast is the
    optimizer's decision, taken on its size.
    """
    one_each = mapping.select(F.col("from_value").alias(column), F.col("to_value").alias("__to"))
    kept = [F.col("__to").alias(c) if c == column else F.col(c) for c in df.columns]
    return df.join(one_each, column, "left").select(*kept)


def drop_subtotals(df: DataFrame, column: str = "Date", label: str = "Grand Total") -> DataFrame:
    """Drop the subtotal rows of a sheet; rows with a null in the column stay."""
    return df.where(~F.col(column).eqNullSafe(label))


def since(df: DataFrame, column: str, bound: str, strict: bool = False) -> DataFrame:
    """Lower bound on a raw date or timestamp column, so that it reaches the scan.

    ``strict`` excludes the bound itself: on a timestamp that is the instant of midnight.
    """
    limit = F.lit(bound).cast(df.schema[column].dataType)
    return df.where(F.col(column) > limit if strict else F.col(column) >= limit)


def in_period(df: DataFrame, column: str, first: str, last: str) -> DataFrame:
    """Closed period of days on a timestamp column, as a half-open range of instants."""
    kind = df.schema[column].dataType
    lower = F.lit(first).cast("date").cast(kind)
    upper = F.date_add(F.lit(last).cast("date"), 1).cast(kind)
    return df.where((F.col(column) >= lower) & (F.col(column) < upper))


def recent(df: DataFrame, column: str, hours: int = 8, as_of: str | None = None) -> DataFrame:
    """Rows of the last ``hours`` hours before ``as_of``, by default before the newest row.

    The newest time is a scalar subquery over one column.
    """
    width = F.make_dt_interval(hours=F.lit(hours))
    if as_of is not None:
        end = F.lit(as_of).cast(df.schema[column].dataType)
        return df.where((F.col(column) >= end - width) & (F.col(column) <= end))
    newest = df.agg(F.max(column)).scalar()
    return df.where(F.col(column) >= newest - width)


def excluding(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Drop the given values; rows with a null in the column stay."""
    return df.where(~F.coalesce(F.col(column).isin(*values), F.lit(False))) if values else df


def unpivot_species(
    wide: DataFrame, ids: Sequence[str] = ("Date", "source_sheet"), skip: Sequence[str] = ("Feeder Visits",)
) -> DataFrame:
    """Species columns to rows ``(ids, Bird, Feeder Visits)``; empty cells are kept.

    Every column that is neither an identifier nor skipped is a species. A cell that is no number becomes empty.
    """
    quoted = {c: F.col(f"`{c}`") for c in wide.columns}
    species = [c for c in wide.columns if c not in ids and c not in skip]
    one_type = wide.select(
        *[quoted[c] for c in ids], *[quoted[c].try_cast("double").alias(c) for c in species]
    )
    return one_type.unpivot(
        list(ids), [F.col(f"`{c}`") for c in species], "Bird", "Feeder Visits"
    ).withColumn("Bird", F.replace(F.col("Bird"), F.lit("`"), F.lit("")))


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames by column name, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def matrix(
    df: DataFrame, rows: Sequence[str], columns: str, value: str, wanted: Sequence
) -> DataFrame:
    """Long to wide for presentation. ``wanted`` lists the columns, so the plan has a fixed width."""
    return df.groupBy(*rows).pivot(columns, list(wanted)).agg(F.first(value, ignorenulls=True))
