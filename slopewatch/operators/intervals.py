"""Whether something happens in the days after or before, by equality of days: no range join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def happens_within(left: DataFrame, events: DataFrame, key: str, day: str, event_day: str, after: int, before: int, name: str) -> DataFrame:
    """Adds 0 or 1: is there an event of the key with ``day + after <= event_day <= day + before``?

    Each distinct event day is listed under the days it counts for, a fixed number, and joined by equality.  Work grows
    with the rows, not with rows times events of a key.
    """
    spread = events.select(F.col(key).alias("_k"), F.col(event_day).alias("_d")).dropna().distinct()
    spread = spread.select("_k", F.explode(F.sequence(F.date_sub("_d", before), F.date_sub("_d", after))).alias("_day")).distinct().withColumn("_hit", F.lit(1))
    joined = left.join(spread, (left[key] == spread["_k"]) & (left[day] == spread["_day"]), "left")
    return joined.select(*[left[c] for c in left.columns], F.coalesce("_hit", F.lit(0)).alias(name))


def happens_after(left: DataFrame, events: DataFrame, key: str, day: str, event_day: str, days: int = 7, name: str = "label") -> DataFrame:
    """day < event_day <= day + days."""
    return happens_within(left, events, key, day, event_day, 1, days, name)


def happened_before(left: DataFrame, events: DataFrame, key: str, day: str, event_day: str, days: int = 7, name: str = "label") -> DataFrame:
    """day - days <= event_day <= day."""
    return happens_within(left, events, key, day, event_day, -days, 0, name)
