"""Geometry on rings: arrays of [longitude, latitude]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_KM = 6371.0


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def ring_centroid(ring: Column, axis: int) -> Column:
    """Mean of the vertices' coordinate; the closing vertex counts."""
    total = F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[axis])
    return F.when(F.size(ring) > 0, total / F.size(ring))


def inside(lon: Column, lat: Column, ring: Column) -> Column:
    """Ray casting: a point is inside if a ray to the east crosses the ring an odd number of times.  Points on a left or
    lower edge count as inside, on a right or upper one as outside."""

    def crosses(i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, i + 1)
        spans = (a[1] > lat) != (b[1] > lat)
        slope = (b[0] - a[0]) / F.nullif(b[1] - a[1], F.lit(0.0))
        return spans & (lon < slope * (lat - a[1]) + a[0])

    return F.size(F.filter(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: F.coalesce(crosses(i), F.lit(False)))) % 2 == 1


def rings_to_geojson(rings: Column) -> Column:
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates")))


def multipolygon(kind: Column, coordinates: Column) -> Column:
    """GeoJSON coordinates, as text, to polygons of rings of points; null for kinds that are no areas."""
    point = "array<array<array<double>>>"
    one, many = F.from_json(coordinates, point), F.from_json(coordinates, f"array<{point}>")
    return F.when(kind == "Polygon", F.array(one)).when(kind == "MultiPolygon", many)


def square(lon: Column, lat: Column, half: float) -> Column:
    """A closed square ring around a point."""
    corner = [(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)]
    return F.array(*[F.array(lon + x * half, lat + y * half) for x, y in corner])
