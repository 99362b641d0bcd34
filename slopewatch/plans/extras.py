"""What Spark gives beyond the operators above, as thin queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import money
from ..session import table
from .registry import query


def v():
    return F.sum(money(F.col("value"))).cast("double")


V = "CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE)"


@query("rollup_totals", f"SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, {V} AS total FROM events GROUP BY ROLLUP (event_type, CAST(ts AS DATE))")
def rollup_totals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("day", F.to_date("ts").cast("string")).rollup("event_type", "day").agg(v().alias("total"))


@query("cube_totals", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_totals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("grouping_sets", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id), ())")
def grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupingSets([["event_type"], ["user_id"], []], "event_type", "user_id").agg(F.count("*").alias("n"))


@query("having_distinct", "SELECT user_id, count(DISTINCT event_type) AS types FROM events GROUP BY 1 HAVING count(*) > 60")
def having_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("types"), F.count("*").alias("n")).filter("n > 60").drop("n")


@query(
    "intersect_except",
    """
(SELECT o_custkey AS k, 'both' AS side
FROM orders
WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey, 'both'
FROM orders
WHERE o_orderstatus = 'O')
UNION ALL (SELECT o_custkey, 'only'
FROM orders
WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey, 'only'
FROM orders
WHERE o_orderstatus = 'O')
""",
)
def intersect_except(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    a, b = (o.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")) for s in ("F", "O"))
    return a.intersect(b).withColumn("side", F.lit("both")).union(a.exceptAll(b).distinct().join(b, "k", "left_anti").withColumn("side", F.lit("only")))


@query(
    "full_join",
    """
SELECT n_nationkey, s.n AS suppliers, c.n AS customers
FROM (SELECT s_nationkey AS k, count(*) AS n
FROM supplier
WHERE s_acctbal > 5000
GROUP BY 1) s FULL JOIN (SELECT c_nationkey AS k, count(*) AS n
FROM customer
WHERE c_acctbal < 0
GROUP BY 1) c ON s.k = c.k RIGHT JOIN nation ON n_nationkey = coalesce(s.k, c.k)
""",
)
def full_join(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    c = table(spark, d, "customer").filter("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    return s.join(c, "k", "full").join(table(spark, d, "nation"), F.col("k") == F.col("n_nationkey"), "right").select("n_nationkey", "suppliers", "customers")


@query(
    "lag_lead",
    """
SELECT event_id, lag(value) OVER w AS before, lead(value) OVER w AS after, CAST(ntile(4) OVER w AS INTEGER) AS quarter, CAST(dense_rank() OVER (PARTITION BY user_id
ORDER BY CAST(ts AS DATE)) AS INTEGER) AS day_no
FROM events
WINDOW w AS (PARTITION BY user_id
ORDER BY ts, event_id)
""",
)
def lag_lead(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    days = Window.partitionBy("user_id").orderBy(F.to_date("ts"))
    return table(spark, d, "events").select("event_id", F.lag("value").over(w).alias("before"), F.lead("value").over(w).alias("after"), F.ntile(4).over(w).alias("quarter"), F.dense_rank().over(days).alias("day_no"))


@query(
    "sessions",
    """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new
FROM events
WINDOW w AS (PARTITION BY user_id
ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id
ORDER BY ts) AS s
FROM g) SELECT user_id, CAST(min(ts) AS VARCHAR) AS begun, count(*) AS n
FROM s
GROUP BY user_id, s
""",
)
def sessions(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").cast("string").alias("begun"), "n")


@query(
    "sliding_windows",
    f"""
SELECT event_type, CAST(w AS VARCHAR) AS begun, count(*) AS n, {V} AS total
FROM (SELECT *, unnest([date_trunc('day', ts) + INTERVAL 12 HOUR * (CASE WHEN hour(ts) >= 12 THEN 1 ELSE 0 END), date_trunc('day',
  ts) + INTERVAL 12 HOUR * (CASE WHEN hour(ts) >= 12 THEN 0 ELSE -1 END)]) AS w
FROM events)
GROUP BY 1, 2
""",
)
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "events").groupBy("event_type", F.window("ts", "24 hours", "12 hours")).agg(F.count("*").alias("n"), v().alias("total"))
    return out.select("event_type", F.col("window.start").cast("string").alias("begun"), "n", "total")


@query(
    "pivot_status",
    """
SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o,
  count(*) FILTER (WHERE o_orderstatus = 'P') AS p
FROM orders
GROUP BY 1
""",
)
def pivot_status(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return out.select("o_orderpriority", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in ("F", "O", "P")])


@query("approx_users")
def approx_users(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"), F.percentile_approx("value", 0.5).alias("median"))


@query("range_frame", f"SELECT event_id, {V} OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE) RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS week FROM events".replace("CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE) RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)", "CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE) RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS DOUBLE)"))
def range_frame(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("n"), money(F.col("value")).alias("m"))
    w = Window.partitionBy("user_id").orderBy("n").rangeBetween(-6, 0)
    return rows.select("event_id", F.sum("m").over(w).cast("double").alias("week"))
