"""Time-of-day bins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TimeBins:
    """Bins from ``start_hour`` to ``end_hour`` (inclusive), restarting at each full hour."""

    start_hour: int = 0
    end_hour: int = 23
    step_minutes: int = 30

    @property
    def per_hour(self) -> int:
        return -(-60 // self.step_minutes)

    @property
    def count(self) -> int:
        return max(0, self.end_hour - self.start_hour + 1) * self.per_hour

    def start_minute(self, index: Column) -> Column:
        """Minute of day at which bin ``index`` begins."""
        hour = F.floor(index / self.per_hour) + self.start_hour
        return (hour * 60 + (index % self.per_hour) * self.step_minutes).cast("int")

    def label(self, index: Column) -> Column:
        """Twelve-hour clock label, e.g. ``06:30 AM``."""
        midnight = F.lit("1970-01-01").cast("timestamp_ntz")
        at = midnight + F.make_dt_interval(mins=self.start_minute(index))
        return F.date_format(at, "hh:mm a")

    def assign(self, minute_of_day: Column) -> Column:
        """First bin that ends after the given minute; outside times clamp to the ends.

        The bin sought is the first whose start lies beyond ``minute - step``, so
        a floor by hour and one by step find it without looking at the bins. A
        null minute stays null (``least``/``greatest`` would skip it).
        """
        beyond = minute_of_day - self.step_minutes
        hour = F.floor(beyond / 60)
        slot = F.floor((beyond - hour * 60) / self.step_minutes) + 1
        index = (hour - self.start_hour) * self.per_hour + F.least(slot, F.lit(self.per_hour))
        clamped = F.greatest(F.lit(0), F.least(F.lit(self.count - 1), index))
        return F.when(minute_of_day.isNotNull(), clamped.cast("int"))


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)
