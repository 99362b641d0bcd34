"""Numbers: coercion, rounding, indexes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of rain, events and slope; of rain and events where the slope is unknown.
WEIGHTS, PARTIAL = (0.4, 0.4, 0.2), (0.5, 0.5)


def number(text: Column) -> Column:
    """A number from text, with a decimal point or comma; null for anything else."""
    return F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double")


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def finite_or_zero(x: Column) -> Column:
    return F.coalesce(finite(x), F.lit(0.0))


def money(x: Column) -> Column:
    """Exact decimal for sums that must not depend on order."""
    return x.cast("decimal(18,2)")


def rounded(x: Column, places: int) -> Column:
    """Rounded half up; negative zero becomes zero."""
    return F.round(x, places) + 0.0


def min_max(x: Column, low: Column, high: Column) -> Column:
    """0 to 1 between the bounds; 0.5 where they are equal; null stays null."""
    return F.when(x.isNull(), None).when(low == high, 0.5).otherwise((x - low) / F.nullif(high - low, F.lit(0.0)))


def risk_index(rain: Column, events: Column, slope: Column) -> Column:
    """Weighted index of normalised parts, of two parts where the slope is unknown."""
    a, b, c = WEIGHTS
    return F.when(slope.isNull(), PARTIAL[0] * rain + PARTIAL[1] * events).otherwise(a * rain + b * events + c * slope)


def risk_index_alt(events: Column, most: Column, slope: Column) -> Column:
    """0.6 of the share of the most events, 0.4 of the slope up to 30 degrees."""
    return 0.6 * events / F.greatest(most, F.lit(1)) + 0.4 * F.least(slope, F.lit(30.0)) / 30.0


def clamp(limit: int, cap: int) -> int:
    return max(0, min(limit, cap))
