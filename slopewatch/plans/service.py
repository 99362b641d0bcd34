"""What clients ask of the domain tables: each question is a function of DataFrames and of the time it is asked at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import any_date, days
from ..functions.documents import feature_collection
from ..functions.numbers import clamp
from ..functions.text import fold
from ..operators.latest import latest_one, latest_with_ties, tail, top_groups
from ..operators.stats import trend

UNKNOWN = "Sin datos"


def latest_predictions(predictions: DataFrame, limit: int = 50) -> DataFrame:
    return predictions.orderBy(F.desc("created_at"), F.desc("id")).limit(clamp(limit, 200))


def district_map(districts: DataFrame, predictions: DataFrame, polygons: DataFrame, events: DataFrame) -> DataFrame:
    """Every district with its latest prediction, polygon and number of events, or defaults."""
    newest = latest_one(predictions, "commune_id", ["created_at", "id"]).select("commune_id", "risk_score", "risk_category", "created_at")
    counts = events.groupBy("commune_id").agg(F.count("*").alias("n_eventos"))
    rows = districts.join(newest, "commune_id", "left").join(polygons.select("commune_id", "geometry"), "commune_id", "left").join(counts, "commune_id", "left")
    return rows.withColumns({"risk_score": F.coalesce("risk_score", F.lit(0.0)), "risk_category": F.coalesce("risk_category", F.lit(UNKNOWN)), "n_eventos": F.coalesce("n_eventos", F.lit(0))})


def district_geojson(rows: DataFrame) -> DataFrame:
    """One row with all districts as a feature collection; districts are a fixed dimension."""
    props = F.struct("commune_id", "nombre_comuna", "risk_score", "risk_category", "n_eventos")
    feature = F.struct(F.lit("Feature").alias("type"), props.alias("properties"), F.from_json("geometry", "type string, coordinates string").alias("geometry"))
    return rows.filter("geometry is not null").agg(feature_collection(F.collect_list(feature)).alias("geojson"))


def district_detail(predictions: DataFrame, features: DataFrame, events: DataFrame, commune_id: str, today: Column, wanted: int = 20) -> dict[str, DataFrame]:
    """Newest prediction, rain of the last 7 and 30 days, and newest events of a district.

    The last value of a day wins over feeds; days without one are left out of the series.
    """
    own = F.col("commune_id") == commune_id
    newest = latest_one(predictions.filter(own), "commune_id", ["created_at", "id"]).select("risk_score", "risk_category", "created_at", "explanation")
    rain = F.get_json_object("features", "$.precip_sum_mm_day").try_cast("double")
    series = features.filter(own).select("id", "reference_date", F.to_date("reference_date").alias("day"), rain.alias("mm")).filter("mm is not null and day is not null")
    series = series.filter(F.col("day").between(F.date_sub(today, 29), today)).groupBy("day").agg(F.max_by("mm", F.struct("reference_date", "id")).alias("mm"))
    sums = series.agg(F.round(F.sum(F.when(F.col("day") >= F.date_sub(today, 6), F.col("mm"))), 2).alias("lluvia_7d"), F.round(F.sum("mm"), 2).alias("lluvia_30d"))
    recent = events.filter(own).orderBy(F.desc("ingested_at"), F.desc("id")).limit(wanted)
    return {"prediction": newest, "rain": sums, "series": series, "events": recent}


def history(features: DataFrame, events: DataFrame, predictions: DataFrame, commune_id: str, today: Column, span: int = 30) -> DataFrame:
    """One row for each of the last days: mean rain, events, score and category; defaults where a day has none."""
    own = F.col("commune_id") == commune_id
    rain = features.filter(own).groupBy(F.to_date("reference_date").alias("day")).agg(F.avg(F.coalesce("precip_acum_7d", F.lit(0.0))).alias("lluvia"))
    counts = events.filter(own).groupBy(any_date(F.col("fecha")).alias("day")).agg(F.count("*").alias("eventos"))
    scores = predictions.filter(own).groupBy(F.to_date("created_at").alias("day")).agg(F.max_by(F.struct("risk_score", "risk_category"), F.struct("created_at", -F.col("id"))).alias("p"))
    calendar = features.sparkSession.range(1).select(F.explode(days(F.date_sub(today, span - 1), today)).alias("day"))
    out = calendar.join(rain, "day", "left").join(counts, "day", "left").join(scores, "day", "left")
    return out.select("day", F.coalesce("lluvia", F.lit(0.0)).alias("lluvia"), F.coalesce("eventos", F.lit(0)).alias("eventos"), "p.risk_score", F.coalesce("p.risk_category", F.lit(UNKNOWN)).alias("risk_category")).orderBy("day")


def statistics(predictions: DataFrame, events: DataFrame, today: Column) -> DataFrame:
    """Critical and high districts, means of the last and the week before, their trend, events of the last 30 days."""
    label = fold(F.trim("risk_category"))
    latest = latest_with_ties(predictions, "commune_id", "created_at").agg(F.count_if(label == "critico").alias("criticas"), F.count_if(label == "alto").alias("altas"))
    day = F.to_date("created_at")
    week = day >= F.date_sub(today, 7)
    means = predictions.filter(day.between(F.date_sub(today, 14), today)).agg(F.avg(F.when(week, F.col("risk_score"))).alias("actual"), F.avg(F.when(~week, F.col("risk_score"))).alias("anterior"))
    recent = events.agg(F.count_if(any_date(F.col("fecha")) >= F.date_sub(today, 30)).alias("eventos_30d"))
    return latest.crossJoin(means).crossJoin(recent).withColumn("tendencia", trend("actual", "anterior"))


def alerts(predictions: DataFrame, names: DataFrame, folded: bool = False, limit: int = 10) -> DataFrame:
    """High and critical predictions, named; labels as they are written, or in any spelling."""
    keep = fold(F.trim("risk_category")).isin("alto", "critico") if folded else F.col("risk_category").isin("Alto", "Crítico")
    rows = predictions.filter(keep).join(names.select("commune_id", "nombre_comuna"), "commune_id", "left").withColumn("nombre", F.coalesce("nombre_comuna", "commune_id"))
    return rows.orderBy(F.when(fold(F.trim("risk_category")) == "critico", 0).otherwise(1), F.coalesce("risk_score", F.lit(0.0)).desc(), "id").limit(limit)


def historical_events(events: DataFrame, commune_id: str, now: Column, back: int = 365, limit: int = 50) -> DataFrame:
    since = now - F.make_dt_interval(F.lit(back))
    return events.filter((F.col("commune_id") == commune_id) & (F.col("ingested_at") >= since)).orderBy(F.desc("ingested_at"), F.desc("id")).limit(clamp(limit, 200))


def top_event_districts(events: DataFrame, n: int = 5) -> DataFrame:
    return top_groups(events, "commune_id", n)


def compare(asked: list[str], predictions: DataFrame, districts: DataFrame) -> DataFrame:
    """Asked districts in order, each once; unknown ones dropped, those without a prediction with nulls."""
    spark = predictions.sparkSession
    wanted = spark.createDataFrame([(asked,)], "ids array<string>").select(F.posexplode(F.array_distinct("ids")).alias("position", "commune_id"))
    newest = latest_one(predictions, "commune_id", ["created_at", "id"]).select("commune_id", "risk_score", "risk_category")
    return wanted.join(districts, "commune_id").join(newest, "commune_id", "left").orderBy("position")


def conversation(turns: DataFrame, session_id: str, n: int = 10, newest: bool = True) -> DataFrame:
    """The last or the first n turns of a session, in order."""
    own = turns.filter(F.col("session_id") == session_id)
    rows = tail(own, "session_id", "id", n) if newest else own.orderBy("created_at", "id").limit(clamp(n, 200))
    return rows.orderBy("created_at", "id")


def feed_status(logs: DataFrame, newest: int = 200) -> DataFrame:
    """The latest run of each source among the newest runs, with totals over all runs."""
    page = logs.orderBy(F.desc("created_at"), F.desc("id")).limit(newest)
    totals = logs.agg(F.count("*").alias("runs"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}") for c in ("records_downloaded", "records_valid", "records_discarded")])
    return latest_one(page, "source", ["created_at", "id"]).crossJoin(F.broadcast(totals)).orderBy("source")  # one row


def filtered_events(events: DataFrame, commune_id: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    from .rows import filtered

    return filtered(events, {"commune_id": commune_id}, {"fecha": since}, {"fecha": until})
