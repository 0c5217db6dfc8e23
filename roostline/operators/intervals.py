"""Inter-visit intervals.

All steps start from *ticks*: the visits of a key counted per second. Visits within
one second are zero apart, so a tick of ``n`` visits stands for ``n - 1`` intervals
of zero and one interval back to the previous tick. Counting is combined on the map
side, which takes the weight out of any hot site, hour or second before a shuffle.

Windows then run over the distinct seconds of one (key, hour) - 3,600 rows at most -
and over the hours of one key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roostline.session import staged

BUCKET_SECONDS = 3600
WHOLE = Window.unboundedPreceding, Window.unboundedFollowing


def _bucket(sec: Column) -> Column:
    return F.floor(sec / BUCKET_SECONDS)


def interval_histogram(
    visits: DataFrame, keys: Sequence[str] = ("site",), min_rows: int = 0, by_date: bool = False
) -> DataFrame:
    """``(keys, gap_s, n)``: how many intervals of a key last ``gap_s`` seconds.

    Rows with a null key are left out. ``min_rows`` drops keys with fewer rows,
    counted with the rows that have no time. ``by_date`` also splits by the
    ``date`` on which an interval ends.

    The distinct gaps of one key add up to no more than its time span, so there
    are at most ``sqrt(2 * span)`` of them: about 25,000 for ten years, whatever
    the number of visits. Later steps build on this bound.
    """
    keys = list(keys)
    ticks = (
        visits.na.drop(subset=keys)
        .groupBy(*keys, "sec")
        .agg(F.count("*").alias("n"))
        .withColumn("bucket", _bucket(F.col("sec")))
    )
    hour = Window.partitionBy(*keys, "bucket").orderBy("sec")
    gaps = ticks.withColumn("gap_s", F.col("sec") - F.lag("sec").over(hour))
    # Per hour and gap within it (at most 85 distinct ones and a null). The aggregation keeps the
    # partitioning of the window and does not shuffle. Written, since the hours and the gaps both come from it.
    per_gap = staged(
        gaps.groupBy(*keys, "bucket", "gap_s").agg(
            F.count("*").alias("n"), F.sum("n").alias("rows"), F.min("sec").alias("lo"), F.max("sec").alias("hi")
        ),
        "gaps",
    )
    # Visits without a time form the null bucket. It sorts first and its ``hi`` is null.
    hours = _lined(
        per_gap.groupBy(*keys, "bucket").agg(
            F.sum("rows").alias("rows"), F.sum("n").alias("seconds"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
        ),
        keys,
    )
    one = F.lit(1).cast("bigint")
    timed = hours.where(F.col("bucket").isNotNull() & (F.col("key_rows") >= min_rows))
    bridges = timed.select(*keys, "bucket", (F.col("lo") - F.col("previous_hi")).alias("gap_s"), one.alias("n"))
    zeros = timed.select(*keys, "bucket", F.lit(0).cast("bigint").alias("gap_s"), (F.col("rows") - F.col("seconds")).alias("n"))
    inner = per_gap.select(*keys, "bucket", "gap_s", "n")
    if min_rows:
        inner = inner.join(_small(hours, keys, min_rows), keys, "left_anti")
    day = F.date_from_unix_date(F.floor(F.col("bucket") * BUCKET_SECONDS / 86400).cast("int"))
    counted = inner.unionByName(bridges).unionByName(zeros).where("gap_s IS NOT NULL AND n > 0")
    group = [*keys, day.alias("date"), "gap_s"] if by_date else [*keys, "gap_s"]
    # Summed up before the shuffle, so a hot key's gaps come from all tasks and meet as sums.
    return counted.groupBy(*group).agg(F.sum("n").alias("n"))


def _lined(hours: DataFrame, keys: list[str]) -> DataFrame:
    """One slim row per key and hour, with the last second before it and the rows of its key."""
    line = Window.partitionBy(*keys).orderBy("bucket")
    return hours.withColumns(
        {"previous_hi": F.lag("hi").over(line), "key_rows": F.sum("rows").over(line.rowsBetween(*WHOLE))}
    )


def _small(hours: DataFrame, keys: list[str], min_rows: int) -> DataFrame:
    """The keys to leave out, of which each has few rows."""
    return hours.where(F.col("key_rows") < min_rows).select(*keys).distinct()


def interval_rows(
    visits: DataFrame, keys: Sequence[str] = ("site",), id_column: str = "event_id", min_rows: int = 0
) -> DataFrame:
    """The visits with ``gap_s`` and ``ivi_minutes`` since the previous visit of their key.

    The first visit of a key and visits without a time are left out. Within one
    second the smallest ``id_column`` comes first and the others follow at zero.
    Intervals return to their rows on that unique id, a join that no hot key can
    skew.
    """
    keys = list(keys)
    seen = visits.na.drop(subset=keys)
    ticks = staged(
        seen.groupBy(*keys, "sec")
        .agg(F.count("*").alias("n"), F.min(id_column).alias("first_id"))
        .withColumn("bucket", _bucket(F.col("sec"))),
        "ticks",
    )
    hours = _lined(ticks.groupBy(*keys, "bucket").agg(F.max("sec").alias("hi"), F.sum("n").alias("rows")), keys)
    hour = Window.partitionBy(*keys, "bucket").orderBy("sec")
    inside = ticks.where(F.col("sec").isNotNull()).withColumn("previous", F.lag("sec").over(hour))
    firsts = inside.join(hours, [*keys, "bucket"]).select(
        F.col("first_id").alias(id_column),
        (F.col("sec") - F.coalesce("previous", "previous_hi")).alias("__gap"),
        F.lit(True).alias("__first"),
    )
    timed = seen.where(F.col("sec").isNotNull())
    if min_rows:
        timed = timed.join(_small(hours, keys, min_rows), keys, "left_anti")
    gap = F.when(F.col("__first"), F.col("__gap")).otherwise(F.lit(0).cast("bigint"))
    joined = timed.join(firsts, id_column, "left").select(*visits.columns, gap.alias("gap_s"))
    return joined.where(F.col("gap_s").isNotNull()).withColumn("ivi_minutes", F.col("gap_s") / 60.0)


def histogram_of(df: DataFrame, minutes: str = "IVI (mins)", keys: Sequence[str] = ("site",)) -> DataFrame:
    """Histogram from a table that already holds intervals in minutes, kept to the second."""
    return (
        df.select(*keys, F.round(F.col(f"`{minutes}`") * 60).cast("bigint").alias("gap_s"))
        .na.drop()
        .groupBy(*keys, "gap_s")
        .agg(F.count("*").alias("n"))
    )


def large_keys(df: DataFrame, keys: Sequence[str], min_rows: int = 5) -> DataFrame:
    """Keys with at least ``min_rows`` rows, with their size."""
    counted = df.na.drop(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= min_rows)
