"""Feeds and sinks from end to end: each query lays out files as a feed would send them, reads them with the feed's reader,
writes what a job would write, and reads that back."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions.numbers import money
from ..ml import training as T
from ..operators import writes
from ..operators.jobs import Folder, Job
from ..sources import paged, readers, samples, services
from ..session import scratch, table
from .registry import query


def lines(df: DataFrame, path: str, files: int = 1) -> str:
    """A table of one text column as text files of a feed."""
    df.repartition(files).write.mode("overwrite").text(path)
    return path


@query(
    "feed_emergencies",
    """
SELECT CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS fecha, 'deslizamiento ' || lower(o_orderpriority) AS tipo_emergencia, CAST(o_custkey % 16 + 1 AS VARCHAR) AS commune_id,
  CAST(o_orderkey % 90 AS DOUBLE) AS latitud, o_orderkey % 4 <> 0 AS has_coords FROM orders WHERE o_orderkey % 3 <> 0
""",
)
def feed_emergencies(spark: SparkSession, d: str) -> DataFrame:
    """The first CSV of a catalogue, with headers in capitals, days written day first, junk dates and kinds of no interest."""
    folder = scratch(spark, "feed")
    k = F.col("o_orderkey")
    kind = F.when(k % 3 == 0, "Incendio").otherwise(F.concat(F.lit("Deslizamiento "), "o_orderpriority"))
    day = F.when(k % 5 == 0, "junk").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    rows = table(spark, d, "orders").select(kind.alias("TIPO"), day.alias("FECHA"), (F.col("o_custkey") % 16 + 1).alias("COMUNA"), (k % 90).alias("LAT"), F.when(k % 4 != 0, "-75,5").alias("longitud"))
    rows.write.option("header", True).csv(f"{folder}/data.csv")
    resources = spark.createDataFrame([(f"{folder}/data.pdf", "PDF"), (f"{folder}/data.csv", ""), (f"{folder}/other", "csv")], "url string, format string")
    listing = resources.agg(F.to_json(F.struct(F.struct(F.collect_list(F.struct("format", "url")).alias("resources")).alias("result"))).alias("value"))
    url = readers.listed_csv(readers.catalogue(spark, lines(listing, f"{folder}/catalogue"))).first().url
    return readers.emergencies(readers.csv(spark, url)).select("fecha", "tipo_emergencia", "commune_id", "latitud", "has_coords")


RAIN = "(SELECT event_type AS estacion, CAST(CAST(ts AS DATE) AS VARCHAR) AS fecha, CAST(max(value) AS DECIMAL(18,2)) AS mm FROM events GROUP BY 1, 2)"


@query(
    "feed_rainfall",
    f"""
SELECT fecha, estacion, CAST(mm AS DOUBLE) AS precipitacion_mm, round(CAST(sum(mm) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE), 2) AS precipitacion_acum_3d,
  round(CAST(sum(mm) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS DOUBLE), 2) AS precipitacion_acum_7d, '05001' AS cod_municipio FROM {RAIN} WINDOW w AS (PARTITION BY estacion ORDER BY fecha)
""",
)
def feed_rainfall(spark: SparkSession, d: str) -> DataFrame:
    """A file in another form than expected is passed over (too short), then the local one is read."""
    folder = scratch(spark, "feed")
    days = table(spark, d, "events").groupBy(F.col("event_type").alias(" Station"), F.to_date("ts").cast("string").alias("FECHA_hora")).agg(money(F.max("value")).alias("Valor "))
    bad = days.filter("FECHA_hora like '%-01'").withColumn("Valor ", F.lit(-1).cast("decimal(18,2)"))
    days.unionByName(bad).write.option("header", True).csv(f"{folder}/rain")
    rows = readers.remote_first(spark, lambda: b"not here", f"{folder}/landing/rain.csv", f"{folder}/rain", lambda: samples.rainfall(spark, 3))
    out = readers.rainfall(rows)
    return out.withColumns({c: F.round(c, 2) for c in ("precipitacion_acum_3d", "precipitacion_acum_7d")})


@query(
    "feed_polygons",
    """
SELECT CAST(n_nationkey AS VARCHAR) AS commune_id, CASE n_nationkey % 3 WHEN 0 THEN n_nationkey + 0.5 WHEN 1 THEN 25.0 END::DOUBLE AS pendiente_promedio,
  coalesce(CASE n_nationkey % 3 WHEN 0 THEN n_nationkey + 0.5 WHEN 1 THEN 25.0 END >= 15, false) AS is_zona_ladera FROM nation WHERE n_nationkey % 5 <> 4
""",
)
def feed_polygons(spark: SparkSession, d: str) -> DataFrame:
    """GeoJSON with slopes in numbers, with commas, by grade or not at all, and features that are no polygons."""
    k = F.col("n_nationkey")
    props = F.create_map(F.lit("CODIGO"), k.cast("string"), F.lit("slope"), F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit(",5"))), F.lit("GRADO_AMEN"), F.when(k % 3 == 1, "ALTA"))
    shape = F.struct(F.when(k % 5 == 4, "Point").otherwise("Polygon").alias("type"), F.array(F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))).alias("coordinates"))
    doc = table(spark, d, "nation").select(F.struct(props.alias("properties"), shape.alias("geometry")).alias("f")).agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list("f").alias("features"))).alias("value"))
    return readers.polygons(spark, lines(doc, f"{scratch(spark, 'feed')}/map")).select("commune_id", "pendiente_promedio", "is_zona_ladera")


@query(
    "feed_stations",
    """
SELECT CAST(s_suppkey AS VARCHAR) AS codigo, CAST(s_acctbal AS DOUBLE) AS valor, CAST(s_nationkey AS VARCHAR) AS comuna
FROM supplier
WHERE s_suppkey % 7 <> 0 AND s_acctbal > -900
""",
)
def feed_stations(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot of stations; a sentinel or junk is no reading."""
    k = F.col("s_suppkey")
    value = F.when(k % 14 == 0, "-999").when(k % 7 == 0, "s/d").otherwise(F.col("s_acctbal").cast("decimal(18,2)").cast("string"))
    one = F.struct(k.cast("string").alias("codigo"), value.alias("valor"), F.lit("6.2").alias("latitud"), F.lit("-75.5").alias("longitud"), F.col("s_nationkey").cast("string").alias("comuna"))
    docs = table(spark, d, "supplier").groupBy(F.floor(k / 500).alias("part")).agg(F.to_json(F.struct(F.collect_list(one).alias("estaciones"))).alias("value"))
    path = f"{scratch(spark, 'feed')}/stations"
    docs.write.partitionBy("part").text(path)  # a document for each few hundred stations
    return readers.station_snapshot(spark, path).select("codigo", "valor", "comuna")


@query("feed_history", "SELECT event_type AS station, CAST(date_trunc('second', ts) AS VARCHAR) AS fecha, value AS precip FROM events WHERE event_id % 11 <> 0")
def feed_history(spark: SparkSession, d: str) -> DataFrame:
    """Lines without a header; those that don't parse are skipped."""
    good = F.concat_ws("\t", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("value").cast("string"), F.lit("more"))
    bad = F.when(F.col("event_id") % 22 == 0, "no tabs here").otherwise(F.concat_ws("\t", "event_type", F.lit("when?"), F.lit("1")))
    text = table(spark, d, "events").select(F.when(F.col("event_id") % 11 == 0, bad).otherwise(good).alias("value"))
    rows = readers.station_history(spark, lines(text, f"{scratch(spark, 'feed')}/history", 3))
    return rows.select("station", F.col("fecha").cast("timestamp_ntz").cast("string").alias("fecha"), "precip")


def numbered(rows: DataFrame, key: str, span: int = 100_000) -> DataFrame:
    """Adds ``_n``, the row's number by a whole-numbered key from 0: numbered within spans of keys, after the rows of the
    spans before, so no task sees more than a span."""
    spans = rows.withColumn("_span", F.floor(F.col(key) / span))
    before = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    base = spans.groupBy("_span").agg(F.count("*").alias("_rows")).select("_span", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))  # a row for each span
    own = F.row_number().over(Window.partitionBy("_span").orderBy(key)) - 1
    return spans.withColumn("_own", own).join(base, "_span").withColumn("_n", F.col("_base") + F.col("_own")).drop("_span", "_own", "_base")


def pages(rows: DataFrame, key: str, limit: int) -> tuple[str, int]:
    """Lays out pages of ``limit`` rows in order of the key, a folder for each offset, in the shared folder: the url template
    of a feed, and the last page's offset."""
    path = f"{scratch(rows.sparkSession, 'feed')}/pages"
    paged_ = numbered(rows, key).withColumn("offset", F.floor(F.col("_n") / limit) * limit)
    paged_.repartition("offset").sortWithinPartitions("offset", "_n").drop("_n").write.partitionBy("offset").json(path)
    return f"{path}/offset={{offset}}", (rows.count() - 1) // limit * limit


def feed_rows(spark: SparkSession, d: str) -> DataFrame:
    """Customers as rows of a feed, in order of their key."""
    k = F.col("c_custkey")
    day = F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))
    return table(spark, d, "customer").select(k.alias("codigoestacion"), F.col("c_mktsegment").alias("municipio"), day.alias("fechaobservacion"))


@query("feed_paged", "SELECT CAST(c_custkey AS VARCHAR) AS codigoestacion, c_mktsegment AS municipio FROM customer")
def feed_paged(spark: SparkSession, d: str) -> DataFrame:
    """All pages of a feed up to the short one, several pages a task."""
    url, last = pages(feed_rows(spark, d), "codigoestacion", 500)
    return paged.feed(spark, url, limit=500, cap=last, stride=4).select("codigoestacion", "municipio")


@query(
    "feed_paged_since",
    """
SELECT CAST(c_custkey AS VARCHAR) AS codigoestacion, '2024-01-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') AS fechaobservacion
FROM customer
WHERE c_custkey % 28 + 1 >= 26
""",
)
def feed_paged_since(spark: SparkSession, d: str) -> DataFrame:
    """The incremental feed: only rows from two days before the newest known one on."""
    known = spark.createDataFrame([("2024-01-28",), ("2024-01-11",)], "day string")
    since = known.agg(F.date_sub(F.max(F.col("day").cast("date")), 2).cast("string")).first()[0]
    url, last = pages(feed_rows(spark, d), "codigoestacion", 500)
    return paged.feed(spark, url, limit=500, cap=last, stride=4, since=since, since_column="fechaobservacion").select("codigoestacion", "fechaobservacion")


@query(
    "feed_pushdown",
    """
SELECT CAST(c_custkey AS VARCHAR) AS codigoestacion, c_mktsegment AS municipio, '2024-01-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') AS fechaobservacion
FROM customer WHERE c_custkey % 28 + 1 >= 20 AND c_custkey % 28 + 1 < 25 AND c_mktsegment LIKE '%U%' AND c_custkey % 3 = 1
""",
)
def feed_pushdown(spark: SparkSession, d: str) -> DataFrame:
    """Comparisons and patterns go to the feed, what it can't be asked is Spark's: the last test is on a number."""
    url, last = pages(feed_rows(spark, d), "codigoestacion", 500)
    rows = paged.feed(spark, url, limit=500, cap=last, stride=4, upper="municipio")
    day = F.col("fechaobservacion")
    wanted = rows.filter((day >= "2024-01-20") & (day < "2024-01-25") & F.col("municipio").like("%U%") & (F.col("codigoestacion").cast("long") % 3 == 1))
    return wanted.select("codigoestacion", "municipio", "fechaobservacion")


@query("feed_stream", "SELECT CAST(c_custkey AS VARCHAR) AS codigoestacion, c_mktsegment AS municipio FROM customer")
def feed_stream(spark: SparkSession, d: str) -> DataFrame:
    """A feed read as a stream that stops after each batch and is started again, until nothing is left; each row arrives
    once."""
    limit = 250
    url, last = pages(feed_rows(spark, d), "codigoestacion", limit)
    batch = max(2, last // limit // 3)  # so some batches
    folder = scratch(spark, "stream")
    while True:
        rows = paged.stream(spark, url, limit=limit, batch=batch, progress=f"{folder}/progress")
        q = rows.select("codigoestacion", "municipio").writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/table").trigger(availableNow=True).start()
        q.awaitTermination()
        if not any(p.numInputRows for p in q.recentProgress):
            return spark.read.parquet(f"{folder}/table")


@query("feed_articles", "SELECT n_nationkey::BIGINT AS id, n_name AS title, '<p>' || n_name || '</p>' AS content FROM nation")
def feed_articles(spark: SparkSession, d: str) -> DataFrame:
    """A search for two terms whose pages overlap; each article once."""
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.lit("2024-01-01T00:00:00").alias("date"), F.struct(F.col("n_name").alias("rendered")).alias("title"), F.struct(F.concat(F.lit("<p>"), "n_name", F.lit("</p>")).alias("rendered")).alias("content"))
    first, second = (pages(rows.filter(some), "id", 10)[0] for some in ("id < 17", "id >= 12"))
    return readers.article_pages(spark, [first, second], limit=10, pages=5).select("id", "title", "content")


@query("feed_rings", "SELECT lpad(CAST(n_regionkey AS VARCHAR), 2, '0') AS code, min(n_nationkey)::DOUBLE AS corner FROM nation GROUP BY 1")
def feed_rings(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a polygon service: the first feature of each code, with its rings as GeoJSON."""
    k = F.col("n_nationkey").cast("double")
    ring = F.array(F.array(k, k), F.array(k + 1, k), F.array(k, k))
    one = F.struct(F.create_map(F.lit("codigo"), F.lpad(F.col("n_regionkey").cast("string"), 2, "0")).alias("attributes"), F.struct(F.array(ring).alias("rings")).alias("geometry"))
    answers = F.sort_array(F.collect_list(F.struct("n_nationkey", F.to_json(one).alias("f"))))["f"]
    doc = table(spark, d, "nation").agg(F.concat(F.lit('{"features":['), F.array_join(answers, ","), F.lit("]}")).alias("value"))
    found = readers.polygon_of_code(readers.ring_query(spark, lines(doc, f"{scratch(spark, 'feed')}/rings")), "codigo")
    return found.select("code", F.get_json_object("geometry", "$.coordinates[0][0][0]").cast("double").alias("corner"))


@query(
    "feed_codes",
    """
SELECT s_suppkey, lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS code, CASE WHEN s_nationkey % 7 <> 3 THEN n_name END AS nombre,
  CASE WHEN s_nationkey % 7 <> 3 THEN s_nationkey::DOUBLE END AS corner
FROM supplier JOIN nation ON s_nationkey = n_nationkey
""",
)
def feed_codes(spark: SparkSession, d: str) -> DataFrame:
    """Polygons by code, each asked for once and kept; the second run finds the first one's and asks for the rest."""
    folder = scratch(spark, "feed")
    k = F.col("n_nationkey").cast("double")
    ring = F.array(F.array(k, k), F.array(k + 1, k), F.array(k, k))
    feature = F.struct(F.struct(F.col("n_name").alias("nombre")).alias("attributes"), F.struct(F.array(ring).alias("rings")).alias("geometry"))
    own = F.when(F.col("n_nationkey") % 7 != 3, F.array(feature)).otherwise(F.array().cast("array<struct<attributes:struct<nombre:string>,geometry:struct<rings:array<array<array<double>>>>>>"))
    answers = table(spark, d, "nation").select(F.concat(F.lit("c"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("code"), own.alias("features"))
    answers.write.partitionBy("code").json(f"{folder}/answers")  # a folder stands for the answer to a request
    codes = table(spark, d, "supplier").select("s_suppkey", services.service_code(F.col("s_nationkey").cast("string")).alias("code"))
    kept = Folder(spark, f"{folder}/kept")
    url = f"{folder}/answers/code=c{{code}}"
    services.resolved(codes.filter("code < '10'"), url, kept, "first")
    found = services.resolved(codes, url, kept, "second")
    return found.select("s_suppkey", "code", "nombre", F.get_json_object("geometry", "$.coordinates[0][0][0]").cast("double").alias("corner"))


@query(
    "sample_feeds",
    """
SELECT 800::BIGINT AS emergencies, 10950::BIGINT AS rain, 5::BIGINT AS stations, 21::BIGINT AS districts, 12::BIGINT AS hillside, 0::BIGINT AS odd
""",
)
def sample_feeds(spark: SparkSession, d: str) -> DataFrame:
    """The generators' totals; odd rows are rain below zero or sums that shrink with their span."""
    events = samples.emergencies(spark).agg(F.count("*").alias("emergencies"))
    odd = (F.col("precipitacion_mm") < 0) | (F.col("precipitacion_acum_7d") < F.col("precipitacion_acum_3d") - 0.02)
    rain = samples.rainfall(spark).agg(F.count("*").alias("rain"), F.count_distinct("estacion").alias("stations"), F.count_if(odd).alias("odd"))
    places = samples.districts(spark).agg(F.count("*").alias("districts"), F.count_if("is_zona_ladera").alias("hillside"))
    return events.crossJoin(rain).crossJoin(places).select("emergencies", "rain", "stations", "districts", "hillside", "odd")  # a row each


@query("sink_append", "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN value END AS value, event_id % 2 AS part FROM events")
def sink_append(spark: SparkSession, d: str) -> DataFrame:
    """Truncate and reload, then append in commits of their own; what isn't a finite number is null."""
    path = f"{scratch(spark, 'sink')}/t"
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 8 == 0, float("nan")).when(F.col("event_id") % 4 == 0, float("-inf")).otherwise(F.col("value")).alias("value"), (F.col("event_id") % 2).alias("part"))
    rows = writes.null_not_finite(rows)
    writes.append(rows.filter("part = 1"), path)
    writes.replace(rows.filter("part = 0"), path)
    writes.in_parts(rows.filter("part = 1"), path, "event_id", 3)
    return spark.read.parquet(path)


@query("sink_rewrite", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS segment FROM customer")
def sink_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """An upsert into a folder; what a job that broke off had left is put in place first."""
    path = f"{scratch(spark, 'sink')}/t"
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    rows.write.parquet(f"{path}.old")  # as if a rewrite had ended between its two moves
    writes.rewrite(spark, rows.filter("c_custkey % 3 = 0").withColumn("segment", F.lit("new")), path, ["c_custkey"])
    return spark.read.parquet(path)


@query("sink_buckets", "SELECT c_custkey, CASE WHEN c_custkey % 97 = 0 THEN 'new' ELSE c_mktsegment END AS segment FROM customer")
def sink_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Upserts into a table of buckets: only those that new rows fall into are written anew."""
    tables = Folder(spark, scratch(spark, "sink"))
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    with Job(tables, "all") as job:
        job.upsert("segments", rows, ["c_custkey"], 16)
    with Job(tables, "some") as job:
        job.upsert("segments", rows.filter("c_custkey % 97 = 0").withColumn("segment", F.lit("new")), ["c_custkey"])
    return tables.read("segments")


@query(
    "sink_job",
    """
SELECT 'orders' AS kind, o_orderkey AS id, o_orderkey % 5 AS part FROM orders WHERE o_orderkey % 5 IN (0, 1)
UNION ALL SELECT 'customers', c_custkey, 0 FROM customer
""",
)
def sink_job(spark: SparkSession, d: str) -> DataFrame:
    """Three jobs over two tables: one, one that breaks off between its tables, and that one again, twice.  What broke off
    is never seen, and what was started again is there once."""
    tables = Folder(spark, scratch(spark, "sink"))
    orders = table(spark, d, "orders").select(F.lit("orders").alias("kind"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 5).alias("part"))
    customers = table(spark, d, "customer").select(F.lit("customers").alias("kind"), F.col("c_custkey").alias("id"), F.lit(0).cast("long").alias("part"))

    def run(part: int, fails: bool = False) -> None:
        with Job(tables, f"part {part}") as job:
            job.append("orders", orders.filter(F.col("part") == part))
            if fails:
                raise RuntimeError("the second table can't be written")
            job.replace("customers", customers)

    run(0)
    with contextlib.suppress(RuntimeError):
        run(1, fails=True)
    run(1)
    run(1)
    return tables.read("orders").unionByName(tables.read("customers"))


@query(
    "sink_logs",
    """
SELECT 'events' AS source, 'ok' AS status, count(*)::INTEGER AS records_downloaded, count(*) FILTER (WHERE value > 100)::INTEGER AS records_valid,
  count(*) FILTER (WHERE NOT value > 100)::INTEGER AS records_discarded, 'parcial' AS estado
FROM events
UNION ALL SELECT 'events', 'failed', 0, 0, 0, 'parcial'
""",
)
def sink_logs(spark: SparkSession, d: str) -> DataFrame:
    """The log of two runs, one of which fails, with counters that the writing job has taken, and the row about the quality of the data."""
    folder = scratch(spark, "sink")
    valid = F.col("value") > 100
    counts = writes.logged(table(spark, d, "events"), valid, "events", f"{folder}/runs", lambda rows: writes.append(rows, f"{folder}/events"))
    with contextlib.suppress(Exception):  # the folder is there already
        writes.logged(table(spark, d, "events"), valid, "events", f"{folder}/runs", lambda rows: rows.write.mode("error").parquet(f"{folder}/events"))
    writes.append(writes.quality_row(spark, "events", "2024-01-31", counts, "value", "parcial"), f"{folder}/quality")
    quality = spark.read.parquet(f"{folder}/quality").select(F.col("fuente").alias("source"), "estado")
    return spark.read.parquet(f"{folder}/runs").select("source", "status", "records_downloaded", "records_valid", "records_discarded").join(quality, "source")


@query(
    "sink_turns",
    """
SELECT DISTINCT CAST(conv_id AS VARCHAR) AS session_id, role, md5(text) AS said, CAST(TIMESTAMP '2024-01-01' + turn * INTERVAL 1 MINUTE AS VARCHAR) AS at
FROM conversations
""",
)
def sink_turns(spark: SparkSession, d: str) -> DataFrame:
    """Two layers that both write the turns of conversations leave each turn once."""
    at = F.timestamp_add("MINUTE", F.col("turn").cast("int"), F.lit("2024-01-01").cast("timestamp"))
    rows = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), "role", F.col("text").alias("content"), at.alias("created_at"))
    path = f"{scratch(spark, 'sink')}/turns"
    writes.turns(rows.filter("role = 'user'"), path)
    return writes.turns(rows, path).select("session_id", "role", F.md5("content").alias("said"), F.col("created_at").cast("timestamp_ntz").cast("string").alias("at"))


@query(
    "sink_geojson",
    """
SELECT count(*) AS features, CAST(sum(n_nationkey) AS BIGINT) AS ids, 'FeatureCollection' AS type
FROM nation
WHERE n_nationkey % 4 <> 0
""",
)
def sink_geojson(spark: SparkSession, d: str) -> DataFrame:
    """The map as a file, read back."""
    from .service import district_geojson

    k = F.col("n_nationkey").cast("string")
    shape = F.when(F.col("n_nationkey") % 4 != 0, F.lit('{"type":"Polygon","coordinates":[[[0,0],[1,1],[0,0]]]}'))
    rows = table(spark, d, "nation").select(k.alias("commune_id"), F.col("n_name").alias("nombre_comuna"), F.lit(0.5).alias("risk_score"), F.lit("Medio").alias("risk_category"), F.lit(1).alias("n_eventos"), shape.alias("geometry"))
    path = f"{scratch(spark, 'sink')}/map"
    writes.document(district_geojson(rows), path)
    schema = "type string, features array<struct<properties: struct<commune_id: string>>>"
    back = spark.read.schema(schema).json(path)
    return back.select("type", F.explode("features.properties.commune_id").alias("id")).groupBy("type").agg(F.count("*").alias("features"), F.sum(F.col("id").cast("long")).alias("ids")).select("features", "ids", "type")


@query(
    "sink_model",
    """
SELECT vec_id, 'f0,f1' AS features, 'logistic' AS chosen, true AS same, 21::BIGINT AS predictions, 0.5::DOUBLE AS neutral FROM embeddings
""",
)
def sink_model(spark: SparkSession, d: str) -> DataFrame:
    """A model's artifacts written and read: every row's score by the model that was read beside that by the one that was
    written, its predictions of the fixed districts appended, and a missing model's."""
    folder = scratch(spark, "sink")
    rows = table(spark, d, "embeddings").select("vec_id", (F.col("label") < 3).cast("int").alias("label"), *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(2)])
    best, areas, model = T.choose(rows, ["f0", "f1"], "vec_id", ["logistic"])
    T.save_artifacts(spark, folder, model, ["f0", "f1"], {"chosen": best, **areas}, T.report(T.scored(model, rows)))
    again, names, metrics = T.load_artifacts(spark, folder)
    writes.append(T.predictions(spark, again, rows.limit(0).select(F.lit("1").alias("commune_id"), "f0", "f1"), names, "v1", F.lit("2024-01-31").cast("timestamp")), f"{folder}/predictions")
    number = spark.read.parquet(f"{folder}/predictions").agg(F.count("*").alias("predictions"))  # one row
    neutral = T.scored(T.load_artifacts(spark, f"{folder}/none")[0], rows).agg(F.max("risk_score").alias("neutral"))
    written = T.scored(model, rows).select("vec_id", F.col("risk_score").alias("before"))
    read = T.scored(again, rows).join(written, "vec_id").crossJoin(F.broadcast(number)).crossJoin(F.broadcast(neutral))
    return read.select("vec_id", F.lit(",".join(names)).alias("features"), F.lit(metrics["chosen"]).alias("chosen"), (F.col("risk_score") == F.col("before")).alias("same"), "predictions", "neutral")


@query(
    "iso_texts",
    """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day, CASE WHEN o_orderkey % 4 IN (1,
  2) THEN CAST(o_orderdate AS VARCHAR) END AS at
FROM orders
""",
)
def iso_texts(spark: SparkSession, d: str) -> DataFrame:
    """Dates and times in texts, with and without a zone, or no date at all."""
    k = F.col("o_orderkey") % 4
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(k == 0, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("junk"))).when(k == 1, F.concat(stamp, F.lit("Z"))).when(k == 2, F.concat(stamp, F.lit("+00:00"))).otherwise("not a date")
    return table(spark, d, "orders").select("o_orderkey", D.iso_date(text).cast("string").alias("day"), D.iso_timestamp(text).cast("timestamp_ntz").cast("string").alias("at"))


@query(
    "columns_cover",
    """
SELECT CAST(o_orderkey AS VARCHAR) AS source_row_id, strftime(o_orderdate, '%Y-%m-%d') AS fecha, 'deslizamiento' AS tipo_emergencia, CAST(o_custkey % 25 AS VARCHAR) AS commune_id,
  NULL::VARCHAR AS barrio, NULL::DOUBLE AS latitud, NULL::DOUBLE AS longitud, NULL::BOOLEAN AS has_coords FROM orders
""",
)
def columns_cover(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a feed in the form of a table of the schema: the first of several feeds that has the columns is taken, those
    that it lacks are null."""
    events, rain, _ = domain(spark, d)
    found = next(rows for rows in (rain, events) if writes.covers(rows, ["fecha", "tipo_emergencia"]))
    return writes.conformed(found, "events")


def domain(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as events of districts, rain by day as stations' readings, and the districts' polygons."""
    orders = table(spark, d, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    events = orders.select(F.col("o_orderkey").cast("string").alias("source_row_id"), day.alias("fecha"), F.lit("deslizamiento").alias("tipo_emergencia"), (F.col("o_custkey") % 25).cast("string").alias("commune_id"))
    rain = orders.groupBy(day.alias("fecha"), F.concat(F.lit("s"), F.col("o_custkey") % 3).alias("estacion")).agg(F.max(F.floor(F.col("o_totalprice") / 4000)).cast("double").alias("precipitacion_mm"))
    rain = rain.withColumns({"precipitacion_acum_3d": F.col("precipitacion_mm") * 2, "precipitacion_acum_7d": F.col("precipitacion_mm") * 3})
    nation = table(spark, d, "nation")
    polygons = nation.select(F.col("n_nationkey").cast("string").alias("commune_id"), F.when(F.col("n_nationkey") % 6 != 5, F.col("n_nationkey").cast("double")).alias("pendiente_promedio"), (F.col("n_nationkey") >= 15).alias("is_zona_ladera"), F.lit("{}").alias("geometry"))
    return events, rain, polygons.filter("commune_id <> '24'")


JOB = """
e AS (SELECT CAST(o_custkey % 25 AS VARCHAR) AS id FROM orders),
r AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS fecha, 's' || (o_custkey % 3) AS estacion, max(floor(o_totalprice / 4000))::DOUBLE AS mm FROM orders GROUP BY 1, 2),
p AS (SELECT CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN n_nationkey % 6 <> 5 THEN n_nationkey::DOUBLE END AS slope, n_nationkey >= 15 AS steep, n_name FROM nation WHERE n_nationkey <> 24),
c AS (SELECT p.*, (SELECT count(*) FROM e WHERE e.id = p.id) AS n FROM p)
"""


@query(
    "batch_communes",
    f"""
WITH {JOB} SELECT id AS commune_id, n_name AS nombre_comuna, n AS n_eventos, slope AS pendiente_promedio, steep AS is_zona_ladera, slope IS NULL AS indice_parcial
FROM c
""",
)
def batch_communes(spark: SparkSession, d: str) -> DataFrame:
    """The batch job run twice: the districts' table holds each once."""
    from .etl import run

    events, rain, polygons = domain(spark, d)
    names = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("commune_id"), F.col("n_name").alias("nombre_comuna"))
    folder = scratch(spark, "job")
    for day in ("2024-01-01", "2024-01-02"):
        tables = run(spark, events, rain, polygons, names, folder, F.lit(day), day)
    return tables.read("communes").select("commune_id", "nombre_comuna", "n_eventos", "pendiente_promedio", "is_zona_ladera", "indice_parcial")


@query(
    "batch_alerts",
    f"""
WITH {JOB}, n AS (SELECT estacion, arg_max(mm, (fecha, mm)) AS mm FROM r GROUP BY 1)
SELECT '15' AS commune_id, 'Naranja' AS nivel, mm AS precipitacion_valor, 'diaria' AS tipo_umbral FROM n WHERE mm > 50 UNION ALL SELECT '15', 'Rojo', mm * 2, 'acum_3d' FROM n WHERE mm * 2 > 100
""",
)
def batch_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Alerts of the newest rain; stations that name no district count for the first one on a hillside."""
    from .etl import rain_alerts

    _, rain, polygons = domain(spark, d)
    communes = polygons.withColumn("nombre_comuna", F.concat(F.lit("place "), "commune_id"))
    return rain_alerts(rain, communes, F.lit("now")).select("commune_id", "nivel", "precipitacion_valor", "tipo_umbral")


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as predictions of districts."""
    score = F.col("o_totalprice") / 1000000
    kind = F.element_at(F.array(*[F.lit(x) for x in ("bajo", "Medio", "ALTO", "Crítico")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 21 + 1).cast("string").alias("commune_id"), score.alias("risk_score"), kind.alias("risk_category"), F.col("o_orderdate").cast("timestamp").alias("created_at"))


PREDICTIONS = "p AS (SELECT o_orderkey AS id, CAST(o_custkey % 21 + 1 AS VARCHAR) AS commune_id, o_totalprice / 1000000 AS risk_score, ['bajo', 'Medio', 'ALTO', 'Crítico'][o_orderkey % 4 + 1] AS risk_category, o_orderdate AS created_at FROM orders)"


@query("client_latest", f"WITH {PREDICTIONS} SELECT id, commune_id, risk_score FROM p ORDER BY created_at DESC, id DESC LIMIT 50")
def client_latest(spark: SparkSession, d: str) -> DataFrame:
    from .service import latest_predictions

    return latest_predictions(predictions(spark, d)).select("id", "commune_id", "risk_score")


@query(
    "client_alerts",
    f"""
WITH {PREDICTIONS} SELECT id, p.commune_id, coalesce(n_name, p.commune_id) AS nombre
FROM p
LEFT JOIN nation ON CAST(n_nationkey AS VARCHAR) = p.commune_id
WHERE strip_accents(lower(risk_category)) IN ('alto', 'critico')
ORDER BY CASE WHEN strip_accents(lower(risk_category)) = 'critico' THEN 0 ELSE 1 END, risk_score DESC, id LIMIT 10
""",
)
def client_alerts(spark: SparkSession, d: str) -> DataFrame:
    from .service import alerts

    names = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("commune_id"), F.col("n_name").alias("nombre_comuna"))
    return alerts(predictions(spark, d), names, folded=True).select("id", "commune_id", "nombre")


@query(
    "client_map",
    f"""
WITH {PREDICTIONS}, l AS (SELECT *
FROM p
QUALIFY row_number() OVER (PARTITION BY commune_id
ORDER BY created_at DESC, id DESC) = 1), n AS (SELECT commune_id, count(*) AS c
FROM p
GROUP BY 1) SELECT CAST(n_nationkey AS VARCHAR) AS commune_id, coalesce(risk_score, 0.0) AS risk_score, coalesce(risk_category, 'Sin datos') AS risk_category,
  coalesce(c, 0) AS n_eventos
FROM nation
LEFT JOIN l ON l.commune_id = CAST(n_nationkey AS VARCHAR)
LEFT JOIN n ON n.commune_id = CAST(n_nationkey AS VARCHAR)
""",
)
def client_map(spark: SparkSession, d: str) -> DataFrame:
    from .service import district_map

    p = predictions(spark, d)
    places = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("commune_id"))
    return district_map(places, p, places.withColumn("geometry", F.lit("{}")), p).select("commune_id", "risk_score", "risk_category", "n_eventos")


@query(
    "client_compare",
    f"""
WITH {PREDICTIONS}, l AS (SELECT *
FROM p
QUALIFY row_number() OVER (PARTITION BY commune_id
ORDER BY created_at DESC, id DESC) = 1), a(commune_id, position) AS (VALUES ('3', 0), ('24', 1), ('1', 3)) SELECT position, a.commune_id, risk_score
FROM a
LEFT JOIN l USING (commune_id)
""",
)
def client_compare(spark: SparkSession, d: str) -> DataFrame:
    from .service import compare

    places = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("commune_id"))
    return compare(["3", "24", "nowhere", "1", "3"], predictions(spark, d), places).select("position", "commune_id", "risk_score")


@query("client_top", f"WITH {PREDICTIONS} SELECT commune_id, count(*) AS n FROM p GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def client_top(spark: SparkSession, d: str) -> DataFrame:
    from .service import top_event_districts

    return top_event_districts(predictions(spark, d), 5)
