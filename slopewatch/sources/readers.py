"""Readers of files that feeds leave, with headers resolved from candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import any_date
from ..functions.documents import first_present
from ..functions.geo import rings_to_geojson
from ..functions.numbers import number
from ..functions.categories import hazard_slope, hillside

# Candidate headers in order.
EVENT_HEADERS = {
    "tipo_emergencia": ["tipo_emergencia", "TIPO_EMERGENCIA", "tipo", "TIPO"],
    "fecha": ["fecha", "FECHA", "fecha_hora", "FECHA_HORA"],
    "commune_id": ["COMUNA", "comuna", "CODIGO_COMUNA", "codigo_comuna", "commune_id"],
    "barrio": ["barrio", "BARRIO", "nombre_barrio", "NOMBRE_BARRIO"],
    "latitud": ["latitud", "LATITUD", "lat", "LAT", "latitude"],
    "longitud": ["longitud", "LONGITUD", "lon", "LON", "longitude"],
}
RAIN_HEADERS = {
    "fecha": ["fecha", "fecha_hora", "date"],
    "estacion": ["estacion", "station", "nombre_estacion", "cod_estacion"],
    "precipitacion_mm": ["precipitacion_mm", "precipitacion", "valor", "value"],
    "cod_municipio": ["cod_municipio", "municipio", "codigo_municipio"],
}
ID_KEYS = ["CODIGO", "commune_id", "COMUNAS", "CODIGO_COMUNA", "COD_COMUNA", "ID", "OBJECTID"]
HAZARD_KEYS = ["GRADO_AMEN", "grado_amen"]
SLOPE_KEYS = ["pendiente_promedio", "PENDIENTE", "PENDIENTE_PROMEDIO", "slope"]
SENTINEL = -900.0


def resolve(columns: list[str], candidates: dict[str, list[str]]) -> dict[str, str | None]:
    """For each field the first candidate that is a column."""
    return {field: next((c for c in names if c in columns), None) for field, names in candidates.items()}


def _picked(df: DataFrame, found: dict[str, str | None], field: str):
    return F.col(f"`{found[field]}`") if found[field] else F.lit(None).cast("string")


def csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)


def emergencies(df: DataFrame, pattern: str = "desliz|movimiento") -> DataFrame:
    """Emergency rows of any known header set: landslides only, dates as ISO text, coordinates as numbers."""
    found = resolve(df.columns, EVENT_HEADERS)
    if not found["tipo_emergencia"]:
        raise ValueError("no column with the type of emergency")
    lat, lon = number(_picked(df, found, "latitud")), number(_picked(df, found, "longitud"))
    rows = df.select(
        F.xxhash64(*df.columns).cast("string").alias("source_row_id"), any_date(_picked(df, found, "fecha")).cast("string").alias("fecha"), F.lower(_picked(df, found, "tipo_emergencia")).alias("tipo_emergencia"),
        _picked(df, found, "commune_id").alias("commune_id"), _picked(df, found, "barrio").alias("barrio"), lat.alias("latitud"), lon.alias("longitud"), (lat.isNotNull() & lon.isNotNull()).alias("has_coords"),
    )
    return rows.filter(F.col("tipo_emergencia").rlike(pattern))


def rainfall(df: DataFrame) -> DataFrame:
    """Rain rows of any known header set (lower-cased and trimmed): numbers of at least 0 only, sums over the last 3 and
    7 rows of the station."""
    from ..operators.rolling import rolling_sums

    df = df.toDF(*[c.strip().lower() for c in df.columns])
    found = resolve(df.columns, RAIN_HEADERS)
    if not found["precipitacion_mm"]:
        raise ValueError("no column with the amount of rain")
    rows = df.select(
        any_date(_picked(df, found, "fecha")).cast("string").alias("fecha"), F.coalesce(_picked(df, found, "estacion"), F.lit("desconocida")).alias("estacion"),
        number(_picked(df, found, "precipitacion_mm")).alias("precipitacion_mm"), F.coalesce(_picked(df, found, "cod_municipio"), F.lit("05001")).alias("cod_municipio"),
    ).filter("precipitacion_mm >= 0")
    sums = rolling_sums(rows, "estacion", ["fecha", "precipitacion_mm"], "precipitacion_mm", {"precipitacion_acum_3d": 3, "precipitacion_acum_7d": 7}, bucket=F.substring("fecha", 1, 7))
    return sums.select("fecha", "estacion", "precipitacion_mm", "precipitacion_acum_3d", "precipitacion_acum_7d", "cod_municipio")


def polygons(spark: SparkSession, path: str) -> DataFrame:
    """Features of a GeoJSON file: polygons with an id; a slope from the properties, else from the hazard grade."""
    schema = "type string, features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.properties", "f.geometry")
    slope = F.coalesce(number(first_present(F.col("properties"), SLOPE_KEYS)), hazard_slope(first_present(F.col("properties"), HAZARD_KEYS)))
    out = rows.select(first_present(F.col("properties"), ID_KEYS).alias("commune_id"), slope.alias("pendiente_promedio"), F.coalesce(hillside(slope), F.lit(False)).alias("is_zona_ladera"), F.col("geometry.type").alias("kind"), F.to_json("geometry").alias("geometry"))
    return out.filter(F.col("kind").isin("Polygon", "MultiPolygon") & F.col("commune_id").isNotNull())


def unzip_geojson(archive: str, folder: str) -> str:
    """Unpack the first GeoJSON or JSON member next to the landing files."""
    import os
    import zipfile

    with zipfile.ZipFile(archive) as z:
        member = next((n for n in z.namelist() if n.lower().endswith((".geojson", ".json"))), None)
        if member is None:
            raise ValueError("no GeoJSON in the archive")
        target = os.path.join(folder, os.path.basename(member))
        with open(target, "wb") as out:
            out.write(z.read(member))
    return target


def station_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """One reading for each station; sentinels dropped."""
    schema = "estaciones array<struct<codigo: string, valor: string, latitud: string, longitud: string, comuna: string, barrio: string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("estaciones").alias("arrival", "s")).select("arrival", "s.*")
    return rows.withColumns({c: number(F.col(c)) for c in ("valor", "latitud", "longitud")}).filter(F.col("valor") > SENTINEL)


def station_history(spark: SparkSession, path: str) -> DataFrame:
    """Headerless tab-separated readings, first three columns; lines that don't parse are skipped."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("p"), F.input_file_name().alias("file")).filter(F.size("p") >= 3)
    out = rows.select(F.col("p")[0].alias("station"), F.col("p")[1].try_cast("timestamp").alias("fecha"), F.col("p")[2].try_cast("double").alias("precip"), "file")
    return out.filter(F.col("fecha").isNotNull() & (F.col("precip") > SENTINEL))


def articles(spark: SparkSession, path: str) -> DataFrame:
    schema = "id long, date string, date_gmt string, title struct<rendered: string>, content struct<rendered: string>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select("id", "date", "date_gmt", F.col("title.rendered").alias("title"), F.col("content.rendered").alias("content"))


def ring_query(spark: SparkSession, path: str) -> DataFrame:
    """Polygon service answers: attributes and rings, as GeoJSON."""
    schema = "features array<struct<attributes: map<string,string>, geometry: struct<rings: array<array<array<double>>>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("features").alias("position", "f"))
    return rows.select("position", F.col("f.attributes").alias("attributes"), F.col("f.geometry.rings").alias("rings"), rings_to_geojson(F.col("f.geometry.rings")).alias("geometry"))


def alert_blocks(html) -> object:
    """Text nodes of a portal page that speak of an alert, an emergency or a slide, cut to 500 characters."""
    return F.transform(F.filter(F.regexp_extract_all(html, F.lit(r">([^<>]+)<"), 1), lambda t: t.rlike("(?i)alerta|emergencia|desliz")), lambda t: F.left(F.trim(t), F.lit(500)))


def listed_csv(resources: DataFrame) -> DataFrame:
    """One row (url) of a catalogue's resources (position, format, url): the first that is CSV by its format or its url."""
    is_csv = (F.lower(F.coalesce("format", F.lit(""))) == "csv") | F.lower("url").endswith(".csv")
    return resources.filter(is_csv & F.col("url").isNotNull()).agg(F.min_by("url", "position").alias("url")).filter("url is not null")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Resources of a data portal's answer: position, format, url."""
    schema = "result struct<resources: array<struct<format: string, url: string>>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("result.resources").alias("position", "r")).select("position", "r.format", "r.url")


def landed(body: bytes, path: str, least: int = 100) -> str | None:
    """Put a download into the landing folder as it came; nothing if it is no longer than ``least`` bytes."""
    import os

    if len(body) <= least:
        return None
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as out:
        out.write(body)
    return path


def remote_first(spark: SparkSession, download, landing: str, local: str, sample, log=None, sleep=None) -> DataFrame:
    """A CSV feed: the download, tried again if it fails, if it has more than 100 bytes and any rows; else the local file;
    else sample rows.  ``log`` is told why a source was passed over."""

    def remote() -> DataFrame:
        path = landed(retried(download, sleep=sleep), landing)
        if path is None:
            raise OSError("the download is too short")
        return csv(spark, path)

    return with_fallback(remote, lambda: csv(spark, local), sample, log=log)


def article_pages(spark: SparkSession, urls: list[str], limit: int = 100, pages: int = 30, **options: str) -> DataFrame:
    """Articles that a paged search finds for several terms (a url template each), each article once; a page behind the
    last one ends a search."""
    from .paged import feed

    found = None
    for url in urls:
        one = feed(spark, url, "id string, date string, date_gmt string, title string, content string", limit=limit, cap=limit * (pages - 1), **options)
        found = one if found is None else found.unionByName(one)
    rows = found.select(F.col("id").try_cast("long").alias("id"), "date", "date_gmt", *[F.get_json_object(c, "$.rendered").alias(c) for c in ("title", "content")])
    return rows.dropDuplicates(["id"])


def polygon_of_code(answers: DataFrame, code: str) -> DataFrame:
    """(code, geometry): the first polygon for each code of a service's answers (position, attributes, geometry)."""
    rows = answers.select(F.col("attributes")[code].alias("code"), "position", "geometry").filter("code is not null")
    return rows.groupBy("code").agg(F.min_by("geometry", "position").alias("geometry"))


def with_fallback(*readers, log=None) -> DataFrame:
    """The first reader that works and has rows, else the last one, whose failure is raised.  ``log`` gets the number of
    each reader that was passed over and why."""
    for i, reader in enumerate(readers[:-1]):
        try:
            df = reader()
            if not df.isEmpty():
                return df
            why = "no rows"
        except Exception as e:  # whatever ails a source, the next one is asked
            why = str(e)
        if log:
            log(i, why)
    return readers[-1]()


def retried(call, attempts: int = 3, pause: float = 1.0, sleep=None):
    """Call again after 1, 2, 4 ... times the pause; the last failure is raised."""
    import time

    for n in range(attempts):
        try:
            return call()
        except Exception:
            if n == attempts - 1:
                raise
            (sleep or time.sleep)(pause * 2**n)
