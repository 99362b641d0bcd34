"""Dense calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import days


def dense(df: DataFrame, keys: DataFrame, key: str, day: str, first: str, last: str, defaults: dict) -> DataFrame:
    """One row for each of ``keys`` and each day from first to last; values where df has the day, else defaults."""
    calendar = keys.select(key).distinct().select(key, F.explode(days(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias(day))
    out = calendar.join(df, [key, day], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items() if v is not None})
