"""Geometry in query form: districts are squares on a grid of nations, points the first components of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions.documents import feature_collection
from ..functions.numbers import rounded
from ..operators.spatial import first_layer, locate
from ..schemas import DENSITY_LAYERS
from ..session import table
from .registry import query

HALF = 0.45
CENTRES = "SELECT n_nationkey, n_name, n_nationkey % 5 + 0.5 AS x, n_nationkey // 5 + 0.5 AS y FROM nation"
POINTS = "SELECT vec_id, (CAST(embedding[1] AS DOUBLE) + 1) * 2.5 AS lon, (CAST(embedding[2] AS DOUBLE) + 1) * 2.5 AS lat FROM embeddings"


def squares(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("n_nationkey") % 5 + 0.5, F.floor(F.col("n_nationkey") / 5) + 0.5
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("commune_id"), "n_name", G.square(x, y, HALF).alias("ring"))


def points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", ((F.col("embedding")[0].cast("double") + 1) * 2.5).alias("lon"), ((F.col("embedding")[1].cast("double") + 1) * 2.5).alias("lat"))


@query(
    "haversine",
    f"""
SELECT vec_id, round(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(6.2 - lat) / 2),
  2) + cos(radians(lat)) * cos(radians(6.2)) * pow(sin(radians(-75.5 - lon) / 2), 2)))), 4) AS km
FROM ({POINTS})
""",
)
def haversine(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).select("vec_id", rounded(G.haversine(F.col("lon"), F.col("lat"), F.lit(-75.5), F.lit(6.2)), 4).alias("km"))


@query(
    "ring_centroid",
    f"""
SELECT n_nationkey::BIGINT AS commune_id, round((x * 5 - {HALF}) / 5, 6) AS lon, round((y * 5 - {HALF}) / 5, 6) AS lat
FROM ({CENTRES})
""",
)
def ring_centroid(spark: SparkSession, d: str) -> DataFrame:
    return squares(spark, d).select("commune_id", rounded(G.ring_centroid(F.col("ring"), 0), 6).alias("lon"), rounded(G.ring_centroid(F.col("ring"), 1), 6).alias("lat"))


@query(
    "point_in_polygon",
    f"SELECT vec_id, (SELECT min(n_nationkey)::BIGINT FROM ({CENTRES}) WHERE lon >= x - {HALF} AND lon < x + {HALF} AND lat >= y - {HALF} AND lat < y + {HALF}) AS commune_id FROM ({POINTS})",
)
def point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    return locate(points(spark, d), squares(spark, d), "lon", "lat", "ring", "commune_id", 0.5, "vec_id").select("vec_id", "commune_id")


#: Vertices of a shape around a centre: an outline, a hole, and a part of its own.
OUTLINES = [
    [(-1, -0.5), (0, -1), (1.125, -0.375), (0.75, 1), (-0.25, 0.625), (-1.25, 0.875), (-1, -0.5)],
    [(-0.25, -0.375), (0.375, -0.25), (0.25, 0.375), (-0.375, 0.25), (-0.25, -0.375)],
    [(1.5, 1.5), (2.25, 1.625), (1.75, 2.25), (1.5, 1.5)],
]
VERTICES = ", ".join(f"({r}, {i}, {x}::DOUBLE, {y}::DOUBLE)" for r, ring in enumerate(OUTLINES) for i, (x, y) in enumerate(ring))
LABELS = [label for _, label in DENSITY_LAYERS]
SHAPES = "SELECT s_suppkey AS k, CAST(s_suppkey * 37 % 101 AS DOUBLE) AS cx, CAST(s_suppkey * 61 % 103 AS DOUBLE) AS cy, CASE WHEN s_suppkey % 50 = 0 THEN 40.0::DOUBLE ELSE 2 + s_suppkey % 5 * 1.5::DOUBLE END AS r FROM supplier"
PLACES = "SELECT c_custkey, (c_custkey * 7919 % 110000) / 1000::DOUBLE - 4 AS lon, (c_custkey * 104729 % 112000) / 1000::DOUBLE - 4 AS lat FROM customer"


def layered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers as places, suppliers as shapes of four layers: each with a hole and a second part, some very large."""
    k = F.col("s_suppkey")
    cx, cy = (k * 37 % 101).cast("double"), (k * 61 % 103).cast("double")
    r = F.when(k % 50 == 0, 40.0).otherwise(2 + k % 5 * 1.5)
    outline, hole, part = (F.array(*[F.array(cx + r * x, cy + r * y) for x, y in ring]) for ring in OUTLINES)
    shapes = table(spark, d, "supplier").select((k % 4).cast("int").alias("position"), k.alias("s_suppkey"), F.array(F.array(outline, hole), F.array(part)).alias("shape"))
    c = F.col("c_custkey")
    places = table(spark, d, "customer").select(c, ((c * 7919 % 110000) / F.lit(1000.0) - 4).alias("lon"), ((c * 104729 % 112000) / F.lit(1000.0) - 4).alias("lat"))
    return places, shapes


@query(
    "layer_priority",
    f"""
WITH o(ring, i, dx, dy) AS (VALUES {VERTICES}), s AS ({SHAPES}), p AS ({PLACES}),
v AS (SELECT k, ring, i, cx + r * dx AS x, cy + r * dy AS y FROM s, o),
e AS (SELECT a.k, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM v a JOIN v b ON a.k = b.k AND a.ring = b.ring AND b.i = a.i + 1 WHERE a.y <> b.y),
h AS (SELECT c_custkey, k FROM p JOIN e ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) / (y2 - y1) * (lat - y1) + x1 GROUP BY 1, 2 HAVING count(*) % 2 = 1),
f AS (SELECT c_custkey, min(k % 4 * 100000000 + k) AS first FROM h GROUP BY 1)
SELECT c_custkey, CASE first // 100000000 {" ".join(f"WHEN {i} THEN '{label}'" for i, label in enumerate(LABELS))} END AS capa, CAST(first % 100000000 AS BIGINT) AS s_suppkey FROM p LEFT JOIN f USING (c_custkey)
""",
)
def layer_priority(spark: SparkSession, d: str) -> DataFrame:
    """The first of four layers, in order of priority, that has each place, and its shape there."""
    places, shapes = layered(spark, d)
    found = first_layer(places, shapes, "lon", "lat", "shape", ["position", "s_suppkey"], 1.0)
    return found.select("c_custkey", F.get(F.array(*[F.lit(label) for label in LABELS]), F.col("position")).alias("capa"), "s_suppkey")


@query(
    "layer_counts",
    f"""
WITH o(ring, i, dx, dy) AS (VALUES {VERTICES}), s AS ({SHAPES}), p AS ({PLACES}),
v AS (SELECT k, ring, i, cx + r * dx AS x, cy + r * dy AS y FROM s, o),
e AS (SELECT a.k, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM v a JOIN v b ON a.k = b.k AND a.ring = b.ring AND b.i = a.i + 1 WHERE a.y <> b.y),
h AS (SELECT c_custkey, k FROM p JOIN e ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) / (y2 - y1) * (lat - y1) + x1 GROUP BY 1, 2 HAVING count(*) % 2 = 1)
SELECT k AS s_suppkey, count(c_custkey) AS places FROM s LEFT JOIN h USING (k) GROUP BY 1
""",
)
def layer_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many places lie in each shape, read from GeoJSON."""
    from ..functions.geo import multipolygon
    from ..operators.spatial import counted

    places, shapes = layered(spark, d)
    text = shapes.select("s_suppkey", F.lit("MultiPolygon").alias("kind"), F.to_json("shape").alias("coordinates"))
    read = text.select(F.struct("s_suppkey").alias("_f"), multipolygon(F.col("kind"), F.col("coordinates")).alias("shape"))
    found = counted(places, read, "lon", "lat", "shape", 1.0).select("_f.s_suppkey", F.col("n").alias("places"))
    return shapes.select("s_suppkey").join(found, "s_suppkey", "left").select("s_suppkey", F.coalesce("places", F.lit(0)).cast("long").alias("places"))


@query("null_geo_filter", f"SELECT n_nationkey::BIGINT AS commune_id FROM ({CENTRES}) WHERE n_nationkey % 4 IN (0, 1) AND n_nationkey % 3 <> 0")
def null_geo_filter(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("commune_id")
    kind = F.when(k % 4 == 0, "Polygon").when(k % 4 == 1, "MultiPolygon").when(k % 4 == 2, "Point")
    rows = squares(spark, d).select(F.when(k % 3 != 0, k).alias("commune_id"), kind.alias("kind"))
    return rows.filter(F.col("kind").isin("Polygon", "MultiPolygon") & F.col("commune_id").isNotNull()).select("commune_id")


@query(
    "rings_to_geojson",
    f"""
SELECT n_nationkey::BIGINT AS commune_id, 'Polygon' AS kind, round(x - {HALF}, 6)::DOUBLE AS lon, 5::INTEGER AS vertices
FROM ({CENTRES})
""",
)
def rings_to_geojson(spark: SparkSession, d: str) -> DataFrame:
    """Rings to GeoJSON text and back."""
    rows = squares(spark, d).select("commune_id", G.rings_to_geojson(F.array("ring")).alias("g"))
    read = F.from_json("g", "type string, coordinates array<array<array<double>>>")
    ring = F.col("r.coordinates")[0]
    return rows.withColumn("r", read).select("commune_id", F.col("r.type").alias("kind"), rounded(ring[0][0], 6).alias("lon"), F.size(ring).alias("vertices"))


@query(
    "geojson_export",
    """
SELECT 'FeatureCollection' AS kind, count(*)::INTEGER AS features, array_to_string(list(n_name
ORDER BY n_nationkey), ',') AS names
FROM nation
""",
)
def geojson_export(spark: SparkSession, d: str) -> DataFrame:
    """All districts as one collection: a fixed dimension, so one document."""
    feature = F.struct(F.col("commune_id"), F.lit("Feature").alias("type"), F.struct("n_name").alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array("ring").alias("coordinates")).alias("geometry"))
    text = squares(spark, d).agg(feature_collection(F.sort_array(F.collect_list(feature))).alias("g"))
    read = F.from_json("g", "type string, features array<struct<properties: struct<n_name: string>>>")
    return text.select(read.alias("r")).select(F.col("r.type").alias("kind"), F.size("r.features").alias("features"), F.array_join(F.transform("r.features", lambda f: f["properties"]["n_name"]), ",").alias("names"))
