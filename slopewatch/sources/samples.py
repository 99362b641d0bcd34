"""Synthetic feeds for demonstrations, made by the executors from row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.categories import hillside
from ..functions.geo import square
from ..schemas import DISTRICTS

# Invented names: nothing depends on them but that kinds of events are slides.
KINDS = ["Deslizamiento de prueba", "Deslizamiento menor", "Movimiento de ladera", "Movimiento de prueba"]
NEIGHBOURHOODS = [f"Barrio {letter}" for letter in "ABCDEFGHIJ"]
STATIONS = [f"Estación {n}" for n in range(1, 6)]


def sample_districts() -> list[tuple[str, float, float, float]]:
    """(id, latitude, longitude, slope): the districts on a grid, with slopes from 6 to 26 degrees dealt out among them."""
    return [(d[0], 6.15 + 0.04 * (i % 5), -75.66 + 0.04 * (i // 5), 6.0 + i * 8 % 21) for i, d in enumerate(DISTRICTS)]


def uniform(seed: int, *parts) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 30)) / float(1 << 30)


def pick(values: list[str], u: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.floor(u * len(values)).cast("int") + 1)


def emergencies(spark: SparkSession, rows: int = 800, seed: int = 42) -> DataFrame:
    i = F.col("id")
    day = F.date_add(F.lit("2018-01-01").cast("date"), F.floor(uniform(seed, i, F.lit("day")) * (365 * 6 + 1)).cast("int"))
    return spark.range(rows).select(
        i.cast("string").alias("source_row_id"), day.cast("string").alias("fecha"), pick(KINDS, uniform(seed, i, F.lit("kind"))).alias("tipo_emergencia"),
        pick([d[0] for d in DISTRICTS], uniform(seed, i, F.lit("district"))).alias("commune_id"), pick(NEIGHBOURHOODS, uniform(seed, i, F.lit("place"))).alias("barrio"),
        (6.05 + 0.3 * uniform(seed, i, F.lit("lat"))).alias("latitud"), (-75.67 + 0.2 * uniform(seed, i, F.lit("lon"))).alias("longitud"), F.lit(True).alias("has_coords"),
    )


def rainfall(spark: SparkSession, days: int = 2190, seed: int = 99) -> DataFrame:
    """Stations times days, wetter in April, May, October and November, with the sums of 3 and 7 rows."""
    from ..operators.rolling import rolling_sums

    rows = spark.range(days * len(STATIONS)).select((F.col("id") % days).cast("int").alias("d"), F.element_at(F.array(*[F.lit(s) for s in STATIONS]), F.floor(F.col("id") / days).cast("int") + 1).alias("estacion"))
    day = F.date_add(F.lit("2018-01-01").cast("date"), F.col("d"))
    bell = F.sqrt(-2 * F.log(1 - uniform(seed, "estacion", "d", F.lit(1)))) * F.cos(2 * 3.141592653589793 * uniform(seed, "estacion", "d", F.lit(2)))
    wet = F.when(F.month(day).isin(4, 5, 10, 11), 4.0).otherwise(1.5)
    rows = rows.select(day.cast("string").alias("fecha"), "estacion", F.round(F.greatest(F.lit(0.0), wet + 3.0 * bell), 2).alias("precipitacion_mm"), F.lit("05001").alias("cod_municipio"))
    out = rolling_sums(rows, "estacion", ["fecha"], "precipitacion_mm", {"precipitacion_acum_3d": 3, "precipitacion_acum_7d": 7}, bucket=F.substring("fecha", 1, 7))
    return out.withColumns({c: F.round(c, 2) for c in ("precipitacion_acum_3d", "precipitacion_acum_7d")})


def districts(spark: SparkSession, half: float = 0.015) -> DataFrame:
    rows = spark.createDataFrame(sample_districts(), "commune_id string, lat double, lon double, pendiente_promedio double")
    return rows.select("commune_id", "pendiente_promedio", hillside(F.col("pendiente_promedio")).alias("is_zona_ladera"), square(F.col("lon"), F.col("lat"), half).alias("ring"))
