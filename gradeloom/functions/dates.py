"""Calendar arithmetic in a course's own time zone (session zone is UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shift_days(instant: Column, days: Column | int, zone: Column) -> Column:
    """Move by whole days and keep the wall-clock time across a clock change."""
    days = F.lit(days) if isinstance(days, int) else days
    return F.to_utc_timestamp(F.from_utc_timestamp(instant, zone) + F.make_interval(days=days), zone)


def to_utc(wall: Column, zone: Column) -> Column:
    return F.to_utc_timestamp(wall, zone)


def same_instant(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def local_day(instant: Column, zone: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(instant, zone))


def in_window(instant: Column, zone: Column, start: Column, end: Column) -> Column:
    """Is the local calendar day inside [start, end]; an open end is null."""
    day = local_day(instant, zone)
    return instant.isNotNull() & (start.isNull() | (day >= start)) & (end.isNull() | (day <= end))


def term_name(day: Column) -> Column:
    """Season by the academic calendar: Fall from August, Spring to April."""
    season = F.when(F.month(day) >= 8, "Fall").when(F.month(day) <= 4, "Spring").otherwise("Summer")
    return F.concat_ws(" ", season, F.year(day))


def current_term_code(day: Column) -> Column:
    """Term code by the registrar's calendar: Spring to May, Summer to July, then Fall."""
    season = F.when(F.month(day) <= 5, "10").when(F.month(day) <= 7, "20").otherwise("30")
    return F.concat(F.year(day).cast("string"), season)


def break_days(entries: Column) -> Column:
    """Array of entries, each a day or ``a..b``, to the array of days they name."""
    def span(e):
        ends = F.transform(F.split(F.trim(e), r"\s*\.\.\s*"), lambda p: F.try_to_date(F.substring(p, 1, 10)))
        first, last = ends[0], F.coalesce(F.get(ends, F.lit(1)), ends[0])
        days = F.sequence(F.least(first, last), F.greatest(first, last))
        return F.when(first.isNotNull() & last.isNotNull(), days).otherwise(F.array().cast("array<date>"))
    kept = F.filter(entries, lambda e: e.isNotNull() & (F.trim(e) != ""))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(kept, span))))


def parse_breaks_text(text: Column) -> Column:
    """Typed entries split on commas, semicolons or newlines; ``a to b`` and ``a - b`` are ranges."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"[,\n;]+"),
                        lambda p: F.regexp_replace(F.trim(p), r"^['\"]+|['\"]+$", ""))
    kept = F.filter(parts, lambda p: p != "")
    return F.transform(kept, lambda p: F.regexp_replace(p, r"\s*(?:\.\.|\s-\s|\bto\b)\s*", ".."))


def days_since(moment: Column, now: Column) -> Column:
    """Whole elapsed days, never negative; null for no moment."""
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(moment.cast("timestamp"))
    return F.greatest(F.lit(0), F.floor(micros / 86400000000.0)).cast("int")


def relative_age(moment: Column, now: Column) -> Column:
    """A short age for a list: hours under a day and a half, else days."""
    hours = (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(moment.cast("timestamp"))) / 3600
    whole = F.bround(hours, 0).cast("int")
    return (F.when(moment.isNull(), "").when(hours < 1, "just now")
            .when(hours < 36, F.concat(whole.cast("string"), F.when(whole == 1, " hour ago").otherwise(" hours ago")))
            .otherwise(F.concat(F.bround(hours / 24, 0).cast("int").cast("string"), F.lit(" days ago"))))
