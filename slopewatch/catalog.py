"""All queries of the engine."""

from __future__ import annotations

from .plans import extras, feeds, models, places, risk, rows, series, streams, texts
from .plans.registry import QUERIES, SQL

MODULES = (risk, series, rows, texts, places, models, streams, extras, feeds)

__all__ = ["MODULES", "QUERIES", "SQL"]
