"""Dates, timestamps, repeaters and durations of outline documents as Column expressions.

A timestamp has no zone and often no time; its parts stay dates and integers.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of a unit; ``m`` is a month of 30 days, ``y`` a year of 365.25 days.
UNITS = {"min": 60, "h": 3600, "d": 86_400, "w": 604_800, "m": 2_592_000, "y": 31_557_600}
MAX_STEPS = 4096


def strict_date(c: Column) -> Column:
    """YYYY-MM-DD with a valid day, else null."""
    return F.when(F.regexp(c, F.lit(r"^\d{4}-\d{2}-\d{2}$")), c.try_cast("date"))


def timestamp_key(c: Column) -> Column:
    """A sortable text of the first YYYY-MM-DD [HH:MM] in ``c``, or null."""
    found = F.regexp_extract(c, r"(\d{4}-\d{2}-\d{2})(?:[^\d>\]\n]*(\d{1,2}:\d{2}))?", 0)
    date = F.regexp_extract(found, r"(\d{4}-\d{2}-\d{2})", 1)
    time = F.regexp_extract(found, r"(\d{1,2}:\d{2})$", 1)
    return F.when(found != "", F.concat(date, F.lit(" "), F.lpad(F.when(time != "", time).otherwise("00:00"), 5, "0")))


def duration_seconds(c: Column) -> Column:
    """Seconds of a duration text: '' is 0, H:MM[:SS], a bare number of minutes, or numbers with units, H:MM at the end allowed; else null."""
    text = F.trim(c)
    found = lambda i: F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)\s*(min|[hdwmy])(?![a-z])"), F.lit(i))

    def seconds_of(unit: Column) -> Column:
        out = F.lit(None).cast("double")
        for name, seconds in UNITS.items():
            out = F.when(unit == name, float(seconds)).otherwise(out)
        return out

    units = F.aggregate(F.zip_with(found(1), found(2), lambda n, unit: n.cast("double") * seconds_of(unit)), F.lit(0.0), lambda a, x: a + x)
    clock = F.regexp_extract(text, r"(\d+):([0-5]?\d)(?::([0-5]?\d))?$", 0)
    field = lambda i: F.coalesce(F.regexp_extract(clock, r"(\d+):(\d+)(?::(\d+))?", i).try_cast("double"), F.lit(0.0))
    at_end = F.when(clock != "", field(1) * 3600 + field(2) * 60 + field(3)).otherwise(F.lit(0.0))
    valid = F.regexp(text, F.lit(r"^(\d+(\.\d+)?\s*(min|h|d|w|m|y)\s*)+(\d+:[0-5]?\d(:[0-5]?\d)?)?$"))
    return (
        F.when(text == "", F.lit(0)).when(F.regexp(text, F.lit(r"^\d+:[0-5]?\d(:[0-5]?\d)?$")), at_end)
        .when(F.regexp(text, F.lit(r"^\d+(\.\d+)?$")), F.round(text.try_cast("double") * 60))
        .when(valid, F.round(units) + at_end).cast("long")
    )


def hours_minutes(seconds: Column, rounded: bool = True) -> Column:
    """H:MM of seconds, rounded to a minute or cut off."""
    minutes = F.floor((seconds + 30) / 60) if rounded else F.floor(seconds / 60)
    return F.format_string("%d:%02d", F.floor(minutes / 60), F.pmod(minutes, F.lit(60)))


def occurrences(start: Column, value: Column, unit: Column, until: Column) -> Column:
    """The dates of a repeater from ``start`` to ``until``, an array of at most MAX_STEPS.

    Months and years step from the previous occurrence, so a clamped day stays
    clamped; an hour repeater has its first date only.
    """
    days = F.when(unit == "d", value).when(unit == "w", value * 7)
    by_days = F.slice(F.sequence(start, F.greatest(until, start), F.make_interval(days=days.cast("int"))), 1, MAX_STEPS)
    months = F.when(unit == "m", value).when(unit == "y", value * 12)
    steps = F.least(F.lit(MAX_STEPS - 1), F.greatest(F.ceil(F.months_between(until, start) / months), F.lit(0)) + 1).cast("int")
    by_months = F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), F.array(start), lambda a, _: F.concat(a, F.array(F.add_months(F.element_at(a, -1), months.cast("int")))))
    out = F.when(days > 0, by_days).when(months > 0, by_months).otherwise(F.array(start))
    return F.filter(out, lambda d: (d == start) | (d <= until))


def datetree_date(path: Column) -> Column:
    """The date of an outline path that ends in YYYY / YYYY-MM ... / YYYY-MM-DD ..., else null."""
    day = F.regexp_extract(F.try_element_at(path, F.lit(-1)), r"^(\d{4}-\d{2}-\d{2})", 1)
    month = F.regexp_extract(F.try_element_at(path, F.lit(-2)), r"^(\d{4}-\d{2})", 1)
    year = F.regexp_extract(F.try_element_at(path, F.lit(-3)), r"^(\d{4})$", 1)
    ok = (day != "") & (month != "") & (year != "") & (F.substring(day, 1, 7) == month) & (F.substring(month, 1, 4) == year)
    return F.when(ok, day.try_cast("date"))


def time_of_day(title: Column) -> Column:
    """Minutes after midnight of the first time in a headline (9:30, 9am, 8:30pm), timestamps aside; null without one."""
    bare = F.regexp_replace(title, r"[<\[]\d{4}-\d{2}-\d{2}[^>\]]*[>\]]", " ")
    found = F.regexp_extract(bare, r"(?i)(?<![\w:])(\d{1,2}(?::[0-5]\d(?:am|pm)?|am|pm))(?![\w:])", 1)
    hour = F.regexp_extract(found, r"^(\d{1,2})", 1).try_cast("int")
    minute = F.coalesce(F.regexp_extract(found, r":(\d\d)", 1).try_cast("int"), F.lit(0))
    half = F.lower(F.regexp_extract(found, r"(?i)(am|pm)$", 1))
    hour = F.when(half == "pm", F.when(hour < 12, hour + 12).otherwise(hour)).when((half == "am") & (hour == 12), 0).otherwise(hour)
    return F.when((found != "") & (hour < 24), hour * 60 + minute)


def block_window(block: str) -> tuple[dt.datetime, dt.datetime]:
    """[start, end) of a clock table's block: YYYY, YYYY-Qn, YYYY-MM, YYYY-Wnn or YYYY-MM-DD."""
    day = lambda y, m=1, d=1: dt.datetime(y, m, d)
    if m := re.fullmatch(r"(\d{4})", block):
        return day(int(m[1])), day(int(m[1]) + 1)
    if m := re.fullmatch(r"(\d{4})-[Qq]([1-4])", block):
        y, q = int(m[1]), int(m[2])
        return day(y, 3 * q - 2), day(y + (q == 4), 3 * q % 12 + 1)
    if m := re.fullmatch(r"(\d{4})-[Ww](\d{1,2})", block):
        start = dt.datetime.fromisocalendar(int(m[1]), int(m[2]), 1)
        return start, start + dt.timedelta(days=7)
    if m := re.fullmatch(r"(\d{4})-(\d{2})", block):
        y, n = int(m[1]), int(m[2])
        return day(y, n), day(y + n // 12, n % 12 + 1)
    if m := re.fullmatch(r"(\d{4})-(\d{2})-(\d{2})", block):
        start = day(int(m[1]), int(m[2]), int(m[3]))
        return start, start + dt.timedelta(days=1)
    raise ValueError(f"no block of time: {block}")
