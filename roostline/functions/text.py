"""Text and calendar expressions used while cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = "Seed"
NO_SEED = "No Seed"


def site_key_from_sheet(name: Column) -> Column:
    """Sheet name to site key: lower case, no ``raw data`` suffix, ``_`` for spaces, no commas."""
    bare = F.replace(F.lower(name), F.lit(" raw data"), F.lit(""))
    return F.replace(F.replace(bare, F.lit(" "), F.lit("_")), F.lit(","), F.lit(""))


def condition_from_text(text: Column, strict: bool = False) -> Column:
    """Feeding condition that a change description announces.

    By default any mention of seed without "extinct" counts as seeded, so the
    text "No seed" does too; ``strict`` reads "no seed" as its own words say.
    """
    words = F.lower(F.coalesce(text, F.lit("")))
    seeded = words.contains("seed") & ~words.contains("extinct")
    if strict:
        seeded = seeded & ~words.contains("no seed")
    return F.when(seeded, SEED).otherwise(NO_SEED)


CLOCK = r"^\s*(\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?\s*([AaPp][Mm])?\s*$"


def day_seconds(time_text: Column) -> Column:
    """Seconds since midnight of ``HH:MM``, ``HH:MM:SS`` or a twelve-hour time; null if the text is none of them.

    A fraction of a second is dropped. Nothing but a whole text is read, so no time is ever shifted.
    """
    part = lambda i: F.nullif(F.regexp_extract(time_text, CLOCK, i), F.lit(""))
    hour, minute = part(1).cast("int"), part(2).cast("int")
    second = F.coalesce(part(3).cast("int"), F.lit(0))
    half = F.lower(part(4))
    of_24 = F.when(half.isNull() & (hour < 24), hour).when(hour.between(1, 12), hour % 12 + F.when(half == "pm", 12).otherwise(0))
    return F.when((minute < 60) & (second < 60), of_24 * 3600 + minute * 60 + second)


def visit_timestamp(date: Column, time_text: Column) -> Column:
    """Date plus time of day as a zone-free timestamp; a null or unreadable part gives null."""
    return date.cast("timestamp_ntz") + F.make_dt_interval(secs=day_seconds(time_text))


def parse_date(text: Column) -> Column:
    """Text to date, null where it is not a date."""
    return F.trim(text).try_cast("timestamp_ntz").cast("date")


def blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def strictly(value: Column, text: Column, what: str) -> Column:
    """``value``, and an error that shows the text where there is a text without a value."""
    fault = F.raise_error(F.concat(F.lit(f"unreadable {what}: "), text))
    return F.when(value.isNull() & ~blank(text), fault).otherwise(value)


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a zone-free timestamp; the sub-second part is dropped.

    Built from the calendar fields, so the session's time zone has no part in it.
    """
    days = F.unix_date(ts.cast("date")).cast("bigint")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def whole_seconds(ts: Column) -> Column:
    """A zone-free timestamp without its sub-second part."""
    of_day = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return ts.cast("date").cast("timestamp_ntz") + F.make_dt_interval(secs=of_day)


def iso_week(date: Column) -> Column:
    """ISO week number without its year."""
    return F.weekofyear(date)


def week_start(date: Column) -> Column:
    """The Monday of the week."""
    return F.date_sub(date, F.weekday(date))


def day_text(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def axis_label(date: Column) -> Column:
    return F.date_format(date, "MM/dd")


def midpoint(start: Column, end: Column) -> Column:
    """Instant half way between two dates: each day apart adds twelve hours."""
    return start.cast("timestamp_ntz") + F.make_dt_interval(hours=F.datediff(end, start) * 12)
