"""The batch job: events, rain and polygons to a table of districts with a risk index, and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import categories as C
from ..functions.numbers import risk_index
from ..operators import writes
from ..operators.jobs import Folder, Job
from ..operators.latest import latest_one
from ..operators.stats import normalised, spearman
from ..session import kept

#: Events that a district needs for a correlation with rain, and days that must have both.
LEAST = 10


def trailing_mean(rain: DataFrame) -> DataFrame:
    """One row: mean rain over the eight days that end at the newest one; 0 without rain."""
    day = F.col("fecha").try_cast("date")
    rows = rain.select(day.alias("day"), "precipitacion_mm").filter("day is not null")
    newest = rows.agg(F.max("day").alias("newest"))
    recent = rows.join(F.broadcast(newest), F.col("day") >= F.date_sub("newest", 7))  # one row
    return recent.agg(F.coalesce(F.avg("precipitacion_mm"), F.lit(0.0)).alias("rain"))


def correlations(events: DataFrame, rain: DataFrame) -> DataFrame:
    """(commune_id, correlacion_diaria, _3d, _7d): events of a day against the mean rain of its stations; null with too
    few events or days."""
    days = rain.groupBy("fecha").agg(*[F.avg(c).alias(c) for c in ("precipitacion_mm", "precipitacion_acum_3d", "precipitacion_acum_7d")])
    counts = events.filter("fecha is not null and commune_id is not null").groupBy("commune_id", "fecha").agg(F.count("*").cast("double").alias("n"))
    many = events.filter("commune_id is not null").groupBy("commune_id").agg(F.count("*").alias("all")).filter(F.col("all") >= LEAST).select("commune_id")
    both = kept(counts.join(many, "commune_id").join(days, "fecha"), "correlations")
    out = many
    for column, name in (("precipitacion_mm", "correlacion_diaria"), ("precipitacion_acum_3d", "correlacion_3d"), ("precipitacion_acum_7d", "correlacion_7d")):
        one = spearman(both, "commune_id", "n", column, LEAST).select("commune_id", F.col("rho").alias(name))
        out = out.join(one, "commune_id", "left")
    return out


def risk_table(events: DataFrame, rain: DataFrame, polygons: DataFrame) -> DataFrame:
    """One row for each polygon: counts, slope, index and category, correlations.  Events without a polygon don't
    count; a district whose slope is unknown gets the partial index."""
    counts = events.groupBy("commune_id").agg(F.count("*").alias("n_eventos"))
    base = latest_one(polygons, "commune_id", ["geometry"]).join(counts, "commune_id", "left").withColumn("n_eventos", F.coalesce("n_eventos", F.lit(0)))
    rows = base.crossJoin(trailing_mean(rain)).withColumn("_n", F.col("n_eventos").cast("double"))
    rows = normalised(rows, {"rain": "_rain", "_n": "_events", "pendiente_promedio": "_slope"})
    score = F.round(risk_index(F.col("_rain"), F.col("_events"), F.col("_slope")), 4)
    out = rows.withColumns({"indice_riesgo": score, "categoria_riesgo": C.index_category(score), "indice_parcial": F.col("_slope").isNull()})
    return out.join(correlations(events, rain), "commune_id", "left").select(
        "commune_id", "pendiente_promedio", "is_zona_ladera", "indice_riesgo", "categoria_riesgo", "indice_parcial", "n_eventos", "correlacion_diaria", "correlacion_3d", "correlacion_7d", "geometry"
    )


def newest_rain(rain: DataFrame) -> DataFrame:
    """For each station the newest value of each column that isn't null."""
    order = F.struct("fecha", "precipitacion_mm")
    return rain.groupBy("estacion").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in ("precipitacion_mm", "precipitacion_acum_3d")])


def rain_alerts(rain: DataFrame, communes: DataFrame, now) -> DataFrame:
    """Alerts of the hillside districts: over 50 mm a day, over 100 mm in three rows; red ones first.

    A station belongs to the first hillside district, by number, whose id or name is part of the station's name or the
    other way round; else to the first hillside district.
    """
    steep = communes.filter("is_zona_ladera").select("commune_id", F.lower(F.coalesce("nombre_comuna", F.lit(""))).alias("name"), F.coalesce(F.col("commune_id").try_cast("int"), F.lit(1 << 30)).alias("number"))
    first = steep.agg(F.min_by("commune_id", F.struct("number", "commune_id")).alias("proxy"))
    station = F.lower("estacion")
    same = (F.col("name") != "") & (F.contains(station, F.col("name")) | F.contains(F.col("name"), station))
    newest = newest_rain(rain)
    matched = newest.join(F.broadcast(steep), same).groupBy("estacion").agg(F.min_by("commune_id", F.struct("number", "commune_id")).alias("commune_id"))  # districts are a fixed dimension
    rows = newest.join(matched, "estacion", "left").crossJoin(F.broadcast(first)).withColumn("commune_id", F.coalesce("commune_id", "proxy")).filter("commune_id is not null")
    made = F.array(
        F.struct(F.lit("Naranja").alias("nivel"), F.col("precipitacion_mm").alias("precipitacion_valor"), F.lit("diaria").alias("tipo_umbral"), F.lit(C.DAILY).alias("over")),
        F.struct(F.lit("Rojo").alias("nivel"), F.col("precipitacion_acum_3d").alias("precipitacion_valor"), F.lit("acum_3d").alias("tipo_umbral"), F.lit(C.THREE).alias("over")),
    )
    out = rows.select("commune_id", F.explode(F.filter(made, lambda a: a["precipitacion_valor"] > a["over"])).alias("a"))
    return out.select("commune_id", "a.nivel", "a.precipitacion_valor", "a.tipo_umbral", now.cast("string").alias("timestamp")).orderBy(C.severity(F.col("nivel")), "commune_id")


def run(spark: SparkSession, events: DataFrame, rain: DataFrame, polygons: DataFrame, names: DataFrame, folder: str, now, job: str) -> Folder:
    """The whole job: communes are upserted, the other tables appended, all seen at once or not at all.  A job whose name
    has been committed isn't done again."""
    tables = Folder(spark, folder)
    with Job(tables, job) as j:
        j.append("events", writes.conformed(writes.null_not_finite(events), "events"))
        j.append("precipitation", writes.conformed(writes.null_not_finite(rain), "precipitation"))
        table = risk_table(events, rain, polygons).join(names.select("commune_id", "nombre_comuna"), "commune_id", "left").withColumn("nombre_comuna", F.coalesce("nombre_comuna", F.concat(F.lit("Comuna "), F.col("commune_id"))))
        j.upsert("communes", writes.conformed(writes.null_not_finite(table), "communes"), ["commune_id"])
        j.append("alerts", rain_alerts(rain, j.read("communes"), now))
    return tables
