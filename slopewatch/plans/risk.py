"""Risk index, categories, alerts and key figures.

On the driver's tables a district is a nation, its events are urgent orders of its customers, rain is the order price
and the slope is the mean balance of its larger suppliers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import categories as C
from ..functions.numbers import finite_or_zero, money, risk_index, risk_index_alt
from ..functions.text import fold
from ..operators.stats import normalised, spearman, trend
from ..session import table
from .registry import query

AS_OF = "2001-07-01"

SLOPES = "SELECT s_nationkey AS k, CAST(sum(CAST(s_acctbal AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS slope FROM supplier WHERE s_acctbal > 5000 GROUP BY 1"
COUNTS = "SELECT c_nationkey AS k, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE regexp_matches(lower(o_orderpriority), 'urgent|high') GROUP BY 1"


def district_counts(spark: SparkSession, d: str) -> DataFrame:
    """Matching events by district: the filter and the columns reach the scan, counts are combined by customer first."""
    orders = table(spark, d, "orders").filter(F.lower("o_orderpriority").rlike("urgent|high")).groupBy("o_custkey").agg(F.count("*").alias("n"))
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).groupBy(F.col("c_nationkey").alias("k")).agg(F.sum("n").alias("n"))


def district_slopes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").filter("s_acctbal > 5000")
    return rows.groupBy(F.col("s_nationkey").alias("k")).agg((F.sum(money(F.col("s_acctbal"))).cast("double") / F.count("*")).alias("slope"))


def trailing_rain(spark: SparkSession, d: str) -> DataFrame:
    """One row: the mean over the eight days that end at the newest one; 0 if there is none."""
    orders = table(spark, d, "orders").select("o_orderdate", "o_totalprice")
    newest = orders.agg(F.max("o_orderdate").alias("newest"))
    recent = orders.join(F.broadcast(newest), F.col("o_orderdate") >= F.col("newest") - F.expr("interval 7 days"))  # one row
    return recent.agg(F.coalesce(F.sum(money(F.col("o_totalprice"))).cast("double") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("rain"))


@query(
    "risk_index",
    f"""
WITH ev AS ({COUNTS}), sl AS ({SLOPES}),
rain AS (SELECT coalesce(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / nullif(count(*), 0), 0.0) AS rain FROM orders
         WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 7 DAY),
d AS (SELECT n_nationkey, n_name, coalesce(n, 0) AS n, slope, rain FROM nation LEFT JOIN ev ON ev.k = n_nationkey LEFT JOIN sl ON sl.k = n_nationkey CROSS JOIN rain),
m AS (SELECT *, CASE WHEN max(n) OVER () = min(n) OVER () THEN 0.5 ELSE (n - min(n) OVER ()) / CAST(max(n) OVER () - min(n) OVER () AS DOUBLE) END AS nn,
        CASE WHEN slope IS NULL THEN NULL WHEN max(slope) OVER () = min(slope) OVER () THEN 0.5 ELSE (slope - min(slope) OVER ()) / (max(slope) OVER () - min(slope) OVER ()) END AS ns, 0.5 AS nr FROM d),
i AS (SELECT *, round(CASE WHEN ns IS NULL THEN 0.5 * nr + 0.5 * nn ELSE 0.4 * nr + 0.4 * nn + 0.2 * ns END, 6) AS score FROM m)
SELECT CAST(n_nationkey AS BIGINT) AS commune_id, n_name AS nombre_comuna, CAST(n AS BIGINT) AS n_eventos, round(slope, 4) AS pendiente_promedio, coalesce(slope >= 7500, false) AS is_zona_ladera, score AS indice_riesgo,
       ns IS NULL AS indice_parcial, CASE WHEN score < 0.25 THEN 'Bajo' WHEN score < 0.5 THEN 'Medio' WHEN score < 0.75 THEN 'Alto' ELSE 'Crítico' END AS categoria_riesgo FROM i
""",
)
def index(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "nation").select("n_nationkey", "n_name")
    rows = base.join(district_counts(spark, d), F.col("n_nationkey") == F.col("k"), "left").drop("k").join(district_slopes(spark, d), F.col("n_nationkey") == F.col("k"), "left").drop("k")
    rows = rows.withColumn("n", F.coalesce("n", F.lit(0))).crossJoin(trailing_rain(spark, d))
    rows = normalised(rows.withColumn("n_d", F.col("n").cast("double")), {"n_d": "nn", "slope": "ns", "rain": "nr"})
    score = F.round(risk_index(F.col("nr"), F.col("nn"), F.col("ns")), 6)
    out = rows.select(
        F.col("n_nationkey").cast("long").alias("commune_id"), F.col("n_name").alias("nombre_comuna"), F.col("n").alias("n_eventos"), F.round("slope", 4).alias("pendiente_promedio"), F.coalesce(F.col("slope") >= 7500, F.lit(False)).alias("is_zona_ladera"),
        score.alias("indice_riesgo"), F.col("ns").isNull().alias("indice_parcial"), C.index_category(score).alias("categoria_riesgo"),
    )
    return out.orderBy(F.desc("indice_riesgo"), "commune_id")


@query(
    "risk_index_alt",
    f"""
WITH ev AS ({COUNTS}), sl AS ({SLOPES}), d AS (SELECT n_nationkey, coalesce(n, 0) AS n, coalesce(slope, 0) / 300 AS s FROM nation LEFT JOIN ev ON ev.k = n_nationkey LEFT JOIN sl ON sl.k = n_nationkey)
SELECT CAST(n_nationkey AS BIGINT) AS commune_id, round(0.6 * n / greatest(max(n) OVER (), 1) + 0.4 * least(s, 30.0) / 30.0, 4) AS score,
       CASE WHEN s >= 15 AND n >= 450 THEN 'Rojo' WHEN s >= 15 AND n >= 150 THEN 'Naranja' END AS nivel FROM d
""",
)
def index_alt(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").select("n_nationkey").join(district_counts(spark, d), F.col("n_nationkey") == F.col("k"), "left").drop("k").join(district_slopes(spark, d), F.col("n_nationkey") == F.col("k"), "left").drop("k")
    rows = rows.select("n_nationkey", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("slope", F.lit(0.0)) / 300).alias("s"))
    most = rows.agg(F.max("n").alias("most"))
    out = rows.crossJoin(F.broadcast(most))  # one row
    return out.select(F.col("n_nationkey").cast("long").alias("commune_id"), F.round(risk_index_alt(F.col("n"), F.col("most"), F.col("s")), 4).alias("score"), C.seed_alert(F.col("n") / 30, C.hillside(F.col("s"))).alias("nivel"))


@query(
    "categories_all_six",
    """
WITH s AS (SELECT o_orderkey, round(o_totalprice / (SELECT max(o_totalprice) FROM orders), 6) AS x FROM orders)
SELECT o_orderkey, CASE WHEN x < 0.25 THEN 'Bajo' WHEN x < 0.5 THEN 'Medio' WHEN x < 0.75 THEN 'Alto' ELSE 'Crítico' END AS index_label,
  CASE WHEN x < 0.35 THEN 'bajo' WHEN x < 0.65 THEN 'medio' WHEN x < 0.9 THEN 'alto' ELSE 'critico' END AS model_label,
  CASE WHEN x > 0.8 THEN 'riesgo crítico' WHEN x > 0.6 THEN 'riesgo alto' WHEN x > 0.3 THEN 'riesgo medio' ELSE 'riesgo bajo' END AS chat_label,
  CASE WHEN x >= 0.82 THEN 'Crítico' WHEN x >= 0.65 THEN 'Alto' WHEN x >= 0.4 THEN 'Medio' ELSE 'Bajo' END AS map_label,
  CASE WHEN x < 0.35 THEN 'Bajo' WHEN x < 0.65 THEN 'Medio' WHEN x < 0.9 THEN 'Alto' ELSE 'Crítico' END AS canonical_label, x * 30 >= 15 AS ladera FROM s
""",
)
def categories(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    rows = orders.crossJoin(F.broadcast(orders.agg(F.max("o_totalprice").alias("most"))))  # one row
    x = F.round(F.col("o_totalprice") / F.col("most"), 6)
    return rows.select("o_orderkey", C.index_category(x).alias("index_label"), C.model_category(x).alias("model_label"), C.chat_category(x).alias("chat_label"), C.map_category(x).alias("map_label"), C.canonical(C.model_category(x)).alias("canonical_label"), C.hillside(x * 30).alias("ladera"))


@query(
    "rain_alerts",
    """
WITH s AS (SELECT event_type, event_id, CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS v,
             CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS v3 FROM events),
l AS (SELECT event_type, arg_max(v, event_id) AS v, arg_max(v3, event_id) AS v3 FROM s GROUP BY 1),
c AS (SELECT event_type, v * 10 AS v, v3 * 10 AS v3, coalesce((SELECT min(n_nationkey) FROM nation WHERE contains(event_type, right(n_name, 1))), 0) AS k FROM l)
SELECT CAST(k AS BIGINT) AS commune_id, 'Naranja' AS nivel, round(v, 4) AS valor, 'diaria' AS umbral, event_type FROM c WHERE v > 50
UNION ALL SELECT CAST(k AS BIGINT), 'Rojo', round(v3, 4), 'acum_3d', event_type FROM c WHERE v3 > 100
""",
)
def rain_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Newest rain of each station against both thresholds; a station belongs to the first district whose code is in its
    name, else to the first one."""
    from ..operators.latest import latest_one
    from ..operators.rolling import rolling_sums

    rows = table(spark, d, "events").select("event_type", "event_id", "ts", money(F.col("value")).alias("v"))
    sums = rolling_sums(rows, "event_type", ["ts", "event_id"], "v", {"v3": 3}, bucket=F.to_date("ts"))
    newest = latest_one(sums, "event_type", ["ts", "event_id"]).select("event_type", (F.col("v").cast("double") * 10).alias("v"), (F.col("v3").cast("double") * 10).alias("v3"))
    nations = table(spark, d, "nation").select("n_nationkey", F.right("n_name", F.lit(1)).alias("sign"))
    # stations are few and districts are a fixed dimension
    matched = newest.join(nations, F.contains(F.col("event_type"), F.col("sign")), "left").groupBy("event_type", "v", "v3").agg(F.coalesce(F.min("n_nationkey"), F.lit(0)).cast("long").alias("commune_id"))
    alerts = F.array(F.struct(F.lit("Naranja").alias("nivel"), F.col("v").alias("valor"), F.lit("diaria").alias("umbral"), F.lit(C.DAILY).alias("limit")), F.struct(F.lit("Rojo").alias("nivel"), F.col("v3").alias("valor"), F.lit("acum_3d").alias("umbral"), F.lit(C.THREE).alias("limit")))
    out = matched.select("commune_id", "event_type", F.explode(F.filter(alerts, lambda a: a["valor"] > a["limit"])).alias("a"))
    return out.select("commune_id", "a.nivel", F.round("a.valor", 4).alias("valor"), "a.umbral", "event_type").orderBy(C.severity(F.col("nivel")), "commune_id", "event_type")


@query(
    "kpi_stats",
    f"""
WITH p AS (SELECT *, CASE WHEN o_orderstatus = 'F' THEN ' Crítico ' WHEN o_orderstatus = 'O' THEN 'alto' ELSE 'bajo' END AS cat FROM orders WHERE o_orderdate <= TIMESTAMP '{AS_OF}'),
l AS (SELECT p.* FROM p JOIN (SELECT o_custkey, max(o_orderdate) AS d FROM p GROUP BY 1) m ON p.o_custkey = m.o_custkey AND p.o_orderdate = m.d),
a AS (SELECT count(*) AS latest, count(*) FILTER (WHERE strip_accents(lower(trim(cat))) = 'critico') AS criticas, count(*) FILTER (WHERE strip_accents(lower(trim(cat))) = 'alto') AS altas FROM l),
b AS (SELECT CAST(sum(CASE WHEN o_orderdate >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) / nullif(count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY), 0) AS c,
        CAST(sum(CASE WHEN o_orderdate < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) / nullif(count(*) FILTER (WHERE o_orderdate < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY), 0) AS q FROM p WHERE o_orderdate >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY)
SELECT latest, criticas, altas, round(c, 6) AS actual, round(q, 6) AS anterior, CASE WHEN c IS NULL OR q IS NULL THEN NULL WHEN c > q THEN 'subió' ELSE 'bajó' END AS tendencia,
  (SELECT count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS eventos_30d FROM a, b
""",
)
def kpi_stats(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    now = F.lit(AS_OF).cast("timestamp_ntz")
    category = F.when(F.col("o_orderstatus") == "F", " Crítico ").when(F.col("o_orderstatus") == "O", "alto").otherwise("bajo")
    past = orders.filter(F.col("o_orderdate") <= now).withColumn("cat", fold(F.trim(category)))
    # rows of each key's newest time, all of them where several share it: counted by time first, so one scan does
    times = past.groupBy("o_custkey", "o_orderdate").agg(F.count("*").alias("n"), F.count_if(F.col("cat") == "critico").alias("c"), F.count_if(F.col("cat") == "alto").alias("a"))
    newest = times.groupBy("o_custkey").agg(F.max_by(F.struct("n", "c", "a"), "o_orderdate").alias("of"))
    latest = newest.agg(*[F.coalesce(F.sum(f"of.{c}"), F.lit(0)).alias(name) for c, name in (("n", "latest"), ("c", "criticas"), ("a", "altas"))])
    known = F.col("o_orderdate") <= now
    week = known & (F.col("o_orderdate") >= now - F.expr("interval 7 days"))
    before = known & ~week & (F.col("o_orderdate") >= now - F.expr("interval 14 days"))

    def mean(test):
        return F.sum(F.when(test, money(F.col("o_totalprice")))).cast("double") / F.nullif(F.count_if(test), F.lit(0))

    recent = orders.filter(F.col("o_orderdate") >= now - F.expr("interval 30 days")).agg(mean(week).alias("c"), mean(before).alias("q"), F.count("*").alias("eventos_30d"))
    return latest.crossJoin(recent).select("latest", "criticas", "altas", F.round("c", 6).alias("actual"), F.round("q", 6).alias("anterior"), trend("c", "q").alias("tendencia"), "eventos_30d")


STATUS = "CASE o_orderstatus WHEN 'F' THEN 'Crítico' WHEN 'O' THEN 'ALTO' ELSE 'Alto' END"


def _alerts(spark: SparkSession, d: str, keep) -> DataFrame:
    label = F.when(F.col("o_orderstatus") == "F", "Crítico").when(F.col("o_orderstatus") == "O", "ALTO").otherwise("Alto")
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", label.alias("cat")).filter(keep(F.col("cat")))
    names = table(spark, d, "customer").select("c_custkey", "c_name")
    return rows.join(names, rows.o_custkey == names.c_custkey, "left").select("o_orderkey", "cat", F.coalesce("c_name", F.col("o_custkey").cast("string")).alias("nombre"))


def _alert_sql(test: str) -> str:
    return f"SELECT o_orderkey, cat, coalesce(c_name, CAST(o_custkey AS VARCHAR)) AS nombre FROM (SELECT *, {STATUS} AS cat FROM orders) LEFT JOIN customer ON o_custkey = c_custkey WHERE {test}"


@query("alerts_cs", _alert_sql("cat IN ('Alto', 'Crítico')"))
def alerts_cs(spark: SparkSession, d: str) -> DataFrame:
    return _alerts(spark, d, lambda c: c.isin("Alto", "Crítico"))


@query("alerts_ci", _alert_sql("lower(cat) IN ('alto', 'crítico', 'critico')"))
def alerts_ci(spark: SparkSession, d: str) -> DataFrame:
    return _alerts(spark, d, lambda c: F.lower(c).isin("alto", "crítico", "critico"))


@query("alerts_accent", _alert_sql("strip_accents(lower(cat)) IN ('critico')"))
def alerts_accent(spark: SparkSession, d: str) -> DataFrame:
    return _alerts(spark, d, lambda c: fold(c).isin("critico"))


@query(
    "spearman_by_key",
    """
WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS x, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS y FROM events GROUP BY 1, 2),
r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY x) + (count(*) OVER (PARTITION BY event_type, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY event_type ORDER BY y) + (count(*) OVER (PARTITION BY event_type, y) - 1) / 2.0 AS b FROM d),
s AS (SELECT event_type, count(*) AS n, sum(CAST(a AS DOUBLE)) AS sx, sum(CAST(b AS DOUBLE)) AS sy, sum(CAST(a AS DOUBLE) * b) AS sxy, sum(CAST(a AS DOUBLE) * a) AS sxx, sum(CAST(b AS DOUBLE) * b) AS syy FROM r GROUP BY 1)
SELECT event_type, n, CASE WHEN n >= 10 THEN round((n * sxy - sx * sy) / nullif(sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)), 0), 6) + 0.0 END AS rho FROM s
""",
)
def spearman_by_key(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts against daily means of each station: rank correlation."""
    days = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("x"), (F.sum(money(F.col("value"))).cast("double") / F.count("*")).alias("y"))
    return spearman(days, "event_type", "x", "y")


@query(
    "trailing_mean",
    """
SELECT round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 6) AS rain
FROM orders
WHERE o_orderdate >= (SELECT max(o_orderdate)
FROM orders) - INTERVAL 7 DAY
""",
)
def trailing_mean(spark: SparkSession, d: str) -> DataFrame:
    return trailing_rain(spark, d).select(F.round("rain", 6).alias("rain"))


@query("zero_fill", "SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN 0.0 ELSE value END AS v FROM events")
def zero_fill(spark: SparkSession, d: str) -> DataFrame:
    """NaN and infinities become zero."""
    x = F.when(F.col("event_id") % 7 == 0, float("nan")).when(F.col("event_id") % 11 == 0, float("inf")).otherwise(F.col("value"))
    return table(spark, d, "events").select("event_id", finite_or_zero(x).alias("v"))


