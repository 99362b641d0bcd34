"""Dates and times from text, and labels for them.  ``now`` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shapes of dates that sources send, day first where the year comes last.
SHAPES = [
    (r"^\d{4}-\d{1,2}-\d{1,2}([T ].*)?$", "-", "ymd"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "/", "ymd"),
    (r"^\d{1,2}/\d{1,2}/\d{4}([T ].*)?$", "/", "dmy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}([T ].*)?$", "-", "dmy"),
]


def any_date(text: Column) -> Column:
    """The date in a text of any of the shapes (with or without a time of day); null for junk, blank or null."""
    text = F.trim(text)
    cases = []
    for pattern, sign, order in SHAPES:
        part = F.split(F.split(text, "[T ]")[0], sign)
        y, m, d = (part[0], part[1], part[2]) if order == "ymd" else (part[2], part[1], part[0])
        built = F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
        cases.append(F.when(text.rlike(pattern), built))
    return F.coalesce(*cases).try_cast("date")


def iso_date(text: Column) -> Column:
    """The date in the first ten characters, if they are one."""
    return F.substring(text, 1, 10).try_cast("date")


def iso_timestamp(text: Column) -> Column:
    return F.regexp_replace(text, "Z$", "+00:00").try_cast("timestamp")


def local_as_utc(text: Column, offset: str = "-05:00") -> Column:
    """The wall clock of a text with the offset, read as UTC."""
    return F.replace(text, F.lit(offset), F.lit("+00:00")).try_cast("timestamp")


def article_date(date_gmt: Column, date: Column, today: Column) -> Column:
    """The GMT date first, then the local one; today's where that is missing or no date."""
    text = F.coalesce(F.when(date_gmt != "", date_gmt), F.when(date != "", date))
    return F.coalesce(iso_date(text), today)


def age_label(then: Column, now: Column) -> Column:
    """Whole minutes (at least one), hours or days since."""
    minutes = F.floor(F.timestamp_diff("SECOND", then, now) / 60)
    m, h, d = F.greatest(F.lit(1), minutes), F.floor(minutes / 60), F.floor(minutes / 1440)

    def word(n: Column, unit: str) -> Column:
        return F.concat(n.cast("long").cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"))

    return F.when(minutes < 60, word(m, "minute")).when(minutes < 1440, word(h, "hour")).otherwise(word(d, "day"))


def days(start: Column, end: Column) -> Column:
    """All days from start to end as an array."""
    return F.sequence(start, end, F.expr("interval 1 day"))
