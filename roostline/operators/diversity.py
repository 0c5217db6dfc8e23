"""Diversity of species per site and period.

Input is ``daily``: ``date, site, bird, visits``. Presence stays in rows
(site, period, species) throughout: species sets are never gathered into arrays,
so neither a rich site nor a long period makes a large group. Ratios that have no
value are null. The dissimilarities need their input more than once, so they stage it
unless it is staged already.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roostline.functions.text import iso_week, week_start
from roostline.session import once, staged

SITE = ("site",)


def species_days(daily: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """``daily`` summed to one row per date, key and species - what all metrics need of it.

    ``any_positive``: some row had visits. ``any_complete``: some row had no null
    at all. ``complete_visits``: the visits of such rows.
    """
    complete = F.lit(True)
    for c in daily.columns:
        complete = complete & F.col(c).isNotNull()
    return (
        daily.na.drop(subset=["date", *keys])
        .groupBy("date", *keys, "bird")
        .agg(
            F.coalesce(F.sum("visits"), F.lit(0)).alias("visits"),
            F.coalesce(F.max(F.col("visits") > 0), F.lit(False)).alias("any_positive"),
            F.max(complete).alias("any_complete"),
            F.coalesce(F.sum(F.when(complete, F.col("visits"))), F.lit(0)).alias("complete_visits"),
        )
    )


def site_totals(daily: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """Visits of all species per date and key; a day of nulls only totals zero."""
    return (
        daily.na.drop(subset=["date", *keys])
        .groupBy("date", *keys)
        .agg(F.coalesce(F.sum("visits"), F.lit(0)).alias("visits"))
    )


def richness(base: DataFrame, keys: Sequence[str] = SITE, positive_only: bool = True) -> DataFrame:
    """Species per date, from ``species_days``.

    ``positive_only`` looks only at rows with visits. A day on which only the
    unknown species was seen has richness zero.
    """
    rows = base.where("any_positive") if positive_only else base
    return rows.groupBy("date", *keys).agg(F.count("bird").alias("richness"))


def _shannon(visits: Column) -> Column:
    """``ln N - sum(c ln c) / N`` over the species' counts, zero for an empty day."""
    total = F.sum(visits).cast("double")
    weighted = F.sum(F.when(visits > 0, visits * F.log(visits.cast("double"))))
    value = F.log(total) - weighted / total
    return F.when(total > 0, F.greatest(value, F.lit(0.0))).otherwise(F.lit(0.0))


def shannon(base: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """Shannon H per date, from ``species_days``; unknown species do not count."""
    known = base.where(F.col("bird").isNotNull())
    return known.groupBy("date", *keys).agg(_shannon(F.col("visits")).alias("shannon_h"))


def alpha_diversity(
    base: DataFrame, keys: Sequence[str] = SITE, positive_only: bool = True, extra: Sequence[Column] = ()
) -> DataFrame:
    """Richness and Shannon H in one aggregation; equals their full outer join.

    ``extra`` aggregates ride along.
    """
    counted = F.col("any_positive") if positive_only else F.lit(True)
    known = F.col("bird").isNotNull()
    h = _shannon(F.when(known, F.col("visits")))
    both = base.groupBy("date", *keys).agg(
        F.max(counted).alias("has_richness"),
        F.max(known).alias("has_h"),
        F.count(F.when(counted, F.col("bird"))).alias("richness"),
        h.alias("shannon_h"),
        *extra,
    )
    rest = [c for c in both.columns if c not in ("has_richness", "has_h", "richness", "shannon_h")]
    return both.where("has_richness OR has_h").select(
        *rest,
        F.when(F.col("has_richness"), F.col("richness")).alias("richness"),
        F.when(F.col("has_h"), F.col("shannon_h")).alias("shannon_h"),
    )


def weekly_presence(
    base: DataFrame, keys: Sequence[str] = SITE, week_key: str = "iso_week", complete_only: bool = False
) -> DataFrame:
    """``(keys, week, bird, present)`` from ``species_days``: visits summed over the week above zero.

    ``week_key`` is ``iso_week`` (a number without its year, so the same week of
    different years is one) or ``week_start`` (the Monday). ``complete_only``
    leaves out rows with any null.
    """
    week = week_start(F.col("date")) if week_key == "week_start" else iso_week(F.col("date"))
    rows = base.where("any_complete") if complete_only else base
    visits = F.col("complete_visits") if complete_only else F.col("visits")
    return (
        rows.where(F.col("bird").isNotNull())
        .groupBy(*keys, week.alias("week"), "bird")
        .agg((F.sum(visits) > 0).alias("present"))
    )


# Species in one bitmap.
BITS = 64


def presence_bitmaps(present: DataFrame, groups: Sequence[str]) -> DataFrame:
    """``(groups, part, bits)`` from ``(groups, bird)``: the species of each group as bitmaps of 64.

    Species are numbered once, over the whole table; there are as many rows in that window as there are species.
    """
    number = F.row_number().over(Window.orderBy("bird")) - 1
    numbers = staged(present.select("bird").distinct().select("bird", number.alias("no")), "species")
    bit = F.expr(f"shiftleft(1L, no % {BITS})")
    marked = present.join(numbers, "bird").withColumns({"part": F.floor(F.col("no") / BITS), "bit": bit})
    return marked.groupBy(*groups, "part").agg(F.bit_or("bit").alias("bits"))


def _compared(
    present: DataFrame, periods: DataFrame, period: str, keys: list[str], recent: Sequence[int], earlier: Sequence[int]
) -> DataFrame:
    """Dissimilarity of the species of two windows of periods, for each observed period.

    ``present`` has ``(keys, period, bird)``, ``periods`` all observed ``(keys, period)``.
    The windows are offsets into the past, counted in observed periods. The species of a
    period travel as bitmaps: each is handed on to the periods whose windows reach back to it, and a window is
    their union, compared by counting bits. Windows cut off by the start
    count as they are; where none of ``earlier`` exists the value is null.
    """
    # The nulls a join would filter out go first, so that both uses below are one exchange.
    for c in [*keys, period]:
        periods = periods.where(F.col(c).isNotNull())
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(period))
    placed = periods.select(*keys, period, place.alias("place"))
    steps = [F.struct(F.lit(i).alias("by"), F.lit(True).alias("recent")) for i in recent]
    steps += [F.struct(F.lit(i).alias("by"), F.lit(False).alias("recent")) for i in earlier]
    # Brought together before they multiply: what is handed on stays in its task.
    maps = presence_bitmaps(present, [*keys, period])
    together = maps.join(placed, [*keys, period]).repartition(*keys, "part")
    handed = together.select(*keys, "part", "bits", "place", F.explode(F.array(*steps)).alias("s"))
    union = lambda chosen: F.bit_or(F.when(chosen, F.col("bits")))
    windows = (
        handed.groupBy(*keys, (F.col("place") + F.col("s.by")).alias("place"), "part")
        .agg(union(F.col("s.recent")).alias("b"), union(~F.col("s.recent")).alias("a"))
        .select(*keys, "place", F.lit(None).cast(periods.schema[period].dataType).alias(period), "a", "b")
    )
    # One row per observed period joins the sums, so that empty ones are kept and
    # places past the end, which have no period, are dropped.
    none = F.lit(None).cast("bigint")
    observed = placed.select(*keys, "place", period, none.alias("a"), none.alias("b"))
    species = lambda bits: F.coalesce(F.sum(F.bit_count(bits)), F.lit(0))
    sums = windows.unionByName(observed).groupBy(*keys, "place").agg(
        F.max(period).alias(period),
        species(F.col("a")).alias("a"),
        species(F.col("b")).alias("b"),
        species(F.col("a").bitwiseAND(F.col("b"))).alias("shared"),
    )
    reached = (F.col("place") > min(earlier)) & (F.col("a") + F.col("b") > 0)
    value = F.when(reached, 1.0 - 2.0 * F.col("shared") / (F.col("a") + F.col("b")))
    return sums.where(F.col(period).isNotNull()).select(*keys, period, "place", value.alias("value"))


def weekly_sorensen(presence: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """Dissimilarity of each observed week to the observed week before it; the first is null."""
    keys, presence = list(keys), once(presence, "presence")
    present = presence.where("present").select(*keys, "week", "bird")
    weeks = presence.select(*keys, "week").distinct()
    return _compared(present, weeks, "week", keys, [0], [1]).withColumnRenamed("value", "sorensen")


def weekly_sorensen_by_date(
    base: DataFrame, keys: Sequence[str] = SITE, week_key: str = "iso_week", complete_only: bool = True
) -> DataFrame:
    """Weekly dissimilarity, repeated on every observed date of its week."""
    base = once(base, "species-days")
    week = week_start(F.col("date")) if week_key == "week_start" else iso_week(F.col("date"))
    weekly = weekly_sorensen(weekly_presence(base, keys, week_key, complete_only), keys)
    dates = base.where("any_complete") if complete_only else base
    dates = dates.select("date", *keys).distinct().withColumn("week", week)
    return dates.join(weekly, [*keys, "week"], "left").select("date", *keys, "sorensen")


def consecutive_weeks(weekly: DataFrame) -> DataFrame:
    """Only the weeks that have one before them."""
    return weekly.where("place > 1").drop("place")


def rolling_sorensen(
    base: DataFrame, keys: Sequence[str] = SITE, width: int = 3, lag: int = 7
) -> DataFrame:
    """Species of the last ``width`` observed dates against those ``lag`` observed dates earlier."""
    keys, base = list(keys), once(base, "species-days")
    known = base.where(F.col("bird").isNotNull())
    present = known.where("visits > 0").select(*keys, "date", "bird")
    dates = known.select(*keys, "date").distinct()
    recent = range(width)
    rolled = _compared(present, dates, "date", keys, recent, [lag + i for i in recent])
    return rolled.select("date", *keys, F.col("value").alias("rolling_sorensen"))


def merge_metrics(frames: Sequence[DataFrame], keys: Sequence[str] = ("date", "site")) -> DataFrame:
    """Full outer merge of metric tables that have one row per key.

    Stacking and regrouping them is the same as a chain of full joins and takes
    one shuffle, combined on the map side, instead of one per join.
    """
    keys = list(keys)
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    metrics = [c for c in stacked.columns if c not in keys]
    return stacked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in metrics])
