"""Scores to categories.  The six mappings differ on purpose: each is what one consumer shows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import HAZARD_SLOPE, lookup
from .text import fold

# Cut points and labels.
INDEX = [(0.25, "Bajo"), (0.50, "Medio"), (0.75, "Alto")]
MODEL = [(0.35, "bajo"), (0.65, "medio"), (0.90, "alto")]
CHAT = [(0.8, "riesgo crítico"), (0.6, "riesgo alto"), (0.3, "riesgo medio")]
MAP = [(0.82, "Crítico"), (0.65, "Alto"), (0.4, "Medio")]
#: Rain that raises an alert: millimetres in a day, and in three rows.
DAILY, THREE = 50.0, 100.0
HILLSIDE = 15.0


def below(score: Column, cuts: list, last: str) -> Column:
    out = F.when(score.isNull(), None)
    for cut, label in cuts:
        out = out.when(score < cut, label)
    return out.otherwise(last)


def index_category(score: Column) -> Column:
    return below(score, INDEX, "Crítico")


def model_category(score: Column) -> Column:
    return below(score, MODEL, "critico")


def chat_category(score: Column) -> Column:
    out = F.when(score.isNull(), "riesgo sin información reciente")
    for cut, label in CHAT:
        out = out.when(score > cut, label)
    return out.otherwise("riesgo bajo")


def map_category(score: Column) -> Column:
    out = F.when(score.isNull(), None)
    for cut, label in MAP:
        out = out.when(score >= cut, label)
    return out.otherwise("Bajo")


def canonical(label: Column) -> Column:
    """Any spelling of a category to its canonical label."""
    return lookup({"bajo": "Bajo", "medio": "Medio", "alto": "Alto", "critico": "Crítico"}, F.trim(fold(label)), F.lit("Sin datos"))


def severity(level: Column) -> Column:
    return F.when(level == "Rojo", 0).when(level == "Naranja", 1).otherwise(99)


def hillside(slope: Column) -> Column:
    return slope >= HILLSIDE


def hazard_slope(grade: Column) -> Column:
    return lookup(HAZARD_SLOPE, F.upper(F.trim(grade)))


def seed_alert(events: Column, on_hillside: Column) -> Column:
    return F.when(on_hillside & (events >= 15), "Rojo").when(on_hillside & (events >= 5), "Naranja")
