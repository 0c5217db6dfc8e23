"""Interventions: phase changes as half-open intervals, segments, markers and periods.

``changes`` has ``site``, ``change_date``, ``description``. Rows without a date or a
site never apply.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roostline.functions.text import SEED, condition_from_text, midpoint
from roostline.session import once, staged

# Days of a block of time. A row meets the intervals of its own block only, one a day at most.
BLOCK_DAYS = 64


def _dated(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("site").isNotNull() & F.col("change_date").isNotNull())


def intervals(changes: DataFrame, strict: bool = False) -> DataFrame:
    """``[start_date, end_date)`` with the condition that begins at its start; the last is open.

    Of several changes on one date the last by description counts: the earlier
    ones get intervals of no length, which are dropped. ``segment`` numbers the
    distinct change dates of a site from one.
    """
    w = Window.partitionBy("site").orderBy("change_date", "description")
    whole = _dated(changes).select(
        "site",
        F.col("change_date").alias("start_date"),
        F.lead("change_date").over(w).alias("end_date"),
        F.dense_rank().over(Window.partitionBy("site").orderBy("change_date")).alias("segment"),
        condition_from_text(F.col("description"), strict).alias("condition"),
        "description",
    )
    return whole.where(F.col("end_date").isNull() | (F.col("end_date") > F.col("start_date")))


def _block(day: Column) -> Column:
    return F.floor(F.unix_date(day.cast("date")) / BLOCK_DAYS)


def _joined(df: DataFrame, spans: DataFrame, columns: Sequence[str], date: str) -> DataFrame:
    """Left join on site and range; the intervals of a site are disjoint, so rows stay single.

    Time is cut into blocks: an interval with an end is listed in each block that it touches, and a row looks only
    at those of its site and block. The last interval of a site, which has no end, is joined by site
    alone. So the work is linear in rows however many changes a site has, and intervals are listed no more than once
    per change and block of the site's span. Both joins have equality keys: broadcast while the
    tables are below the session's size threshold, otherwise shuffled, where AQE splits a site that holds much of the table.
    """
    value = F.struct(*columns)
    last = spans.where(F.col("end_date").isNull()).select(F.col("site").alias("__site"), F.col("start_date").alias("__since"), value.alias("__last"))
    blocks = F.sequence(_block(F.col("start_date")), _block(F.date_sub("end_date", 1)))
    ended = spans.where(F.col("end_date").isNotNull()).select(
        F.col("site").alias("__of"), F.explode(blocks).alias("__block"), F.col("start_date").alias("__from"), F.col("end_date").alias("__to"), value.alias("__value")
    )
    day = F.col(date)
    hit = (F.col("site") == F.col("__of")) & (_block(day) == F.col("__block")) & (day >= F.col("__from")) & (day < F.col("__to"))
    both = df.join(last, F.col("site") == F.col("__site"), "left").join(ended, hit, "left")
    found = F.when(day >= F.col("__since"), F.col("__last")).otherwise(F.col("__value"))
    return both.select(*[df[f"`{c}`"] for c in df.columns], *[found[c].alias(c) for c in columns])


def condition_in_force(
    df: DataFrame, changes: DataFrame, date: str = "date", baseline: str = SEED, strict: bool = False
) -> DataFrame:
    """As-of join: the condition set by the latest change at or before each row's date.

    ``baseline`` before the first change; null where the date is null.
    """
    out = _joined(df, intervals(changes, strict), ["condition"], date)
    return out.withColumn(
        "condition", F.when(F.col(date).isNotNull(), F.coalesce("condition", F.lit(baseline)))
    )


def segments(
    series: DataFrame, changes: DataFrame, keys: Sequence[str] = ("site",), date: str = "date"
) -> DataFrame:
    """Number the runs of each series between phase changes from one, skipping empty ones.

    ``raw_segment`` counts the change dates passed, ``segment`` the non-empty runs.
    """
    spans = intervals(changes).withColumnRenamed("segment", "raw_segment")
    raw = F.when(F.col(date).isNotNull(), F.coalesce("raw_segment", F.lit(0)))
    numbered = once(_joined(series, spans, ["raw_segment"], date).withColumn("raw_segment", raw), "segments")
    # The runs are numbered among themselves, one row each, and not over the rows of a series.
    runs = numbered.where(F.col("raw_segment").isNotNull()).select(*keys, "raw_segment").distinct()
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("raw_segment"))
    named = runs.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("raw_segment").alias("__raw"), place.alias("segment"))
    same = F.col("raw_segment") == F.col("__raw")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return numbered.join(named, same, "left").select(*numbered.columns, "segment")


def _neighbours(dates: DataFrame, changes: DataFrame) -> DataFrame:
    """Per change: the observed dates around it and the last two dates of its site.

    Dates and changes of a site are laid on one line, a change before a date of
    the same day, and each change looks left and right along it. The work is
    linear in days plus changes; pairs of the two are never formed.
    """
    observed = dates.select("site", "date").na.drop().distinct().select(
        "site",
        F.col("date").alias("at"),
        F.lit(1).alias("kind"),
        F.col("date").alias("seen"),
        F.lit(None).cast("string").alias("description"),
    )
    marks = _dated(changes).select(
        "site",
        F.col("change_date").alias("at"),
        F.lit(0).alias("kind"),
        F.lit(None).cast("date").alias("seen"),
        "description",
    )
    order = Window.partitionBy("site").orderBy("at", "kind", "description")
    left = order.rowsBetween(Window.unboundedPreceding, -1)
    right = order.rowsBetween(1, Window.unboundedFollowing)
    site = Window.partitionBy("site")
    line = observed.unionByName(marks).select(
        "site",
        "at",
        "kind",
        "description",
        F.last("seen", ignorenulls=True).over(left).alias("before"),
        F.first("seen", ignorenulls=True).over(right).alias("after"),
        "seen",
    )
    line = line.withColumn("last_date", F.max("seen").over(site)).withColumn(
        "previous_date", F.max_by("before", "seen").over(site)
    )
    return line.where("kind = 0").select(
        "site", F.col("at").alias("change_date"), "description", "before", "after", "previous_date", "last_date"
    )


def markers_before(dates: DataFrame, changes: DataFrame) -> DataFrame:
    """Marker half way between the last date before a change and the change; none without one."""
    found = _neighbours(dates, changes).where(F.col("before").isNotNull())
    at = midpoint(F.col("before"), F.col("change_date"))
    return found.select("site", "change_date", "description", at.alias("marker"))


def markers_between(dates: DataFrame, changes: DataFrame) -> DataFrame:
    """Marker half way between the observed dates on both sides of a change.

    A change outside the data takes the site's last two dates, or its only one.
    A site without dates gets no marker.
    """
    found = _neighbours(dates, changes).where(F.col("last_date").isNotNull())
    both = F.col("before").isNotNull() & F.col("after").isNotNull()
    start = F.when(both, F.col("before")).otherwise(F.coalesce("previous_date", "last_date"))
    end = F.when(both, F.col("after")).otherwise(F.col("last_date"))
    return found.select("site", "change_date", "description", midpoint(start, end).alias("marker"))


def primary_markers(dates: DataFrame, changes: DataFrame) -> DataFrame:
    """Per site: the marker of its first change, and all markers in order of change."""
    marks = markers_between(dates, changes)
    entry = F.struct("change_date", "description", "marker")
    ordered = F.array_sort(F.collect_list(entry))
    return marks.groupBy("site").agg(
        F.min_by("marker", F.struct("change_date", "description")).alias("primary_marker"),
        F.transform(ordered, lambda e: e["marker"]).alias("markers"),
    )


def periods(
    dates: DataFrame, changes: DataFrame, baseline: str = SEED, strict: bool = False
) -> DataFrame:
    """Labelled periods of each observed site: first date, its changes in order, last date.

    The first period carries ``baseline``; a later one the condition of the change
    at its start, of several on one date the first by description. Bounds are
    taken in this order even where a change lies outside the data.
    """
    # One row per site, written: it is needed three times, the dates once.
    span = staged(
        dates.where(F.col("site").isNotNull())
        .groupBy("site")
        .agg(F.min("date").alias("first_date"), F.max("date").alias("last_date")),
        "spans",
    )
    tied = Window.partitionBy("site", "change_date").orderBy("description")
    label = F.first(condition_from_text(F.col("description"), strict)).over(tied)
    starts = _dated(changes).select(
        "site", F.lit(1).alias("rank"), F.col("change_date").alias("start_date"), label.alias("condition"), "description"
    )
    first = span.select(
        "site",
        F.lit(0).alias("rank"),
        F.col("first_date").alias("start_date"),
        F.lit(baseline).alias("condition"),
        F.lit(None).cast("string").alias("description"),
    )
    w = Window.partitionBy("site").orderBy("rank", "start_date", "description")
    bounds = first.unionByName(starts.join(span.select("site"), "site", "left_semi"))
    numbered = bounds.select(
        "site",
        F.row_number().over(w).alias("phase_no"),
        "start_date",
        F.lead("start_date").over(w).alias("next_start"),
        "condition",
    )
    end = F.coalesce("next_start", "last_date")
    return numbered.join(span.select("site", "last_date"), "site").select(
        "site",
        "phase_no",
        "start_date",
        end.alias("end_date"),
        "condition",
        midpoint(F.col("start_date"), end).alias("middle"),
    )
