"""JSON feature documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import number

# Keys that are no features.
NOT_FEATURES = ["source", "nombre", "official_codigo", "station_codes", "barrios", "tratamiento", "geomedellin_hub", "socrata_dataset", "siata_json_url"]


def parse(text: Column) -> Column:
    """A map of the top-level keys, or null if it is no object."""
    return F.from_json(text, "map<string,string>")


def numeric_features(text: Column) -> Column:
    """The keys with numbers, as a map of doubles; flags, lists, objects, junk and denied keys are left out."""
    values = F.map_filter(parse(text), lambda k, v: ~k.isin(NOT_FEATURES) & number(v).isNotNull())
    return F.transform_values(values, lambda k, v: number(v))


def overlay(features: Column, typed: dict[str, Column]) -> Column:
    """Typed columns that aren't null override the document's keys."""
    extra = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), c.cast("double").alias("value")) for k, c in typed.items()]), lambda x: x["value"].isNotNull())
    kept = F.map_filter(features, lambda k, v: ~F.array_contains(F.transform(extra, lambda x: x["key"]), k))
    return F.map_concat(kept, F.map_from_entries(extra))


def first_present(doc: Column, keys: list[str]) -> Column:
    """The value of the first key that is there, even if it is null."""
    out = None
    for k in keys:
        has = F.map_contains_key(doc, k)
        out = F.when(has, F.element_at(doc, k)) if out is None else out.when(has, F.element_at(doc, k))
    return out


def feature_collection(features: Column) -> Column:
    return F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), features.alias("features")))
