"""Dates as columns. The time that counts as now is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words for today and yesterday, absolute formats in the order they are tried.
TODAY = ("today", "posted today", "just posted", "just now", "new")
YESTERDAY = ("yesterday", "posted yesterday")
FORMATS = ("d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "yyyy/M/d", "d/M/yyyy", "d-M-yyyy", "yyyy-M-d")
_RELATIVE = r"(\d+)\s*(minute|hour|day|week|month|year)s?\s*(?:ago|old)?"
UNIT_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}


def posted_at(text: Column, now: Column) -> Column:
    """A posting date as a board writes it; null where it can't be told.

    Minutes and hours are exact, days and more start at midnight; a count and a unit are taken
    anywhere in the text.
    """
    raw = F.trim(text)
    low = F.regexp_replace(F.lower(raw), r"\s+", " ")
    midnight = lambda t: F.date_trunc("day", t)
    n = F.regexp_extract(low, _RELATIVE, 1).try_cast("int")
    unit = F.regexp_extract(low, _RELATIVE, 2)
    back = lambda days: midnight(now - F.make_dt_interval(days=n * days))
    relative = F.when(unit == "minute", now - F.make_dt_interval(mins=n)).when(unit == "hour", now - F.make_dt_interval(hours=n))
    for name, days in UNIT_DAYS.items():
        relative = relative.when(unit == name, back(days))
    iso = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}"), raw.try_cast("timestamp"))
    absolute = F.coalesce(iso, *[F.try_to_timestamp(raw, F.lit(f)) for f in FORMATS])
    return (
        F.when(low.isin(*TODAY), midnight(now))
        .when(low.isin(*YESTERDAY), midnight(now - F.make_dt_interval(days=F.lit(1))))
        .when(unit != "", relative)
        .otherwise(absolute)
    )


def schedule_minutes(text: Column, explicit: Column | None = None) -> Column:
    """Minutes between runs from 'hourly', 'daily', 'weekly', 'every 6h', 'every_2_days', ...; 15 to 10080, a day if unknown."""
    low = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"[\s_]+", " ")
    n = F.regexp_extract(low, r"every (\d+) ?(m|min|minute|h|hour|d|day|w|week)s?$", 1).try_cast("int")
    unit = F.substring(F.regexp_extract(low, r"every (\d+) ?(m|min|minute|h|hour|d|day|w|week)s?$", 2), 1, 1)
    every = n * F.when(unit == "m", 1).when(unit == "h", 60).when(unit == "d", 1440).when(unit == "w", 10080)
    named = F.when(low == "hourly", 60).when(low == "daily", 1440).when(low == "weekly", 10080)
    found = F.coalesce(*([explicit] if explicit is not None else []), named, every, F.lit(1440))
    return F.greatest(F.lit(15), F.least(F.lit(10080), found)).cast("int")


def next_run(now: Column, minutes: Column) -> Column:
    return now + F.make_dt_interval(mins=minutes)


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1_000_000)


# How a range of dates is written, and words for the present.
_POINT = r"(?:[A-Za-z]{3,9}\s+)?\d{4}|\d{1,2}/\d{4}|\d{1,2}[-/]\d{4}"
PRESENT = ("present", "current", "currently working", "till date", "now")
RANGE = rf"(?i)({_POINT})\s*(?:-|–|—|\bto\b|\buntil\b|\bthrough\b)\s*(present|currently\s+working|current|till\s+date|now|{_POINT})"


def date_range(text: Column) -> dict[str, Column]:
    """Start, end and whether it runs on, of the first range in a text."""
    start, end = F.regexp_extract(text, RANGE, 1), F.regexp_extract(text, RANGE, 2)
    current = F.regexp_replace(F.lower(end), r"\s+", " ").isin(*PRESENT)
    return {"start_date": F.nullif(start, F.lit("")), "end_date": F.when(current, "Present").otherwise(F.nullif(end, F.lit(""))), "is_current": current}


def run_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")
