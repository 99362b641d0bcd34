"""Series of rows and days: rolling sums, last known values, calendars, labels, daily aggregates.

On the driver's tables a station is an event type, rain is the value, an entity is a user, a landslide an error event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import documents as J
from ..functions.numbers import money
from ..operators import calendar, intervals, rolling, stats
from ..operators.latest import last_known, latest_one
from ..session import table
from .registry import query

FIRST, LAST = "2024-01-01", "2024-01-30"
SUM = "CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE)"


def total(c: str = "value"):
    return F.sum(money(F.col(c))).cast("double")


@query(
    "rolling_3_7",
    """
SELECT event_id, event_type, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS sum_3, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS DOUBLE) AS sum_7
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)
""",
)
def rolling_3_7(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "event_type", "ts", money(F.col("value")).alias("v"))
    out = rolling.rolling_sums(rows, "event_type", ["ts", "event_id"], "v", {"sum_3": 3, "sum_7": 7}, bucket=F.to_date("ts"))
    return out.select("event_id", "event_type", F.col("sum_3").cast("double").alias("sum_3"), F.col("sum_7").cast("double").alias("sum_7"))


@query(
    "station_latest",
    """
SELECT event_type, event_id, value
FROM events
QUALIFY row_number() OVER (PARTITION BY event_type
ORDER BY ts DESC, event_id DESC) = 1
""",
)
def station_latest(spark: SparkSession, d: str) -> DataFrame:
    return latest_one(table(spark, d, "events").select("event_type", "event_id", "value", "ts"), "event_type", ["ts", "event_id"]).select("event_type", "event_id", "value")


@query("station_last_nonnull", "SELECT event_type, arg_max(value, ts) FILTER (WHERE event_id % 3 <> 0) AS value FROM events GROUP BY 1")
def station_last_nonnull(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_type", "ts", "event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"))
    return last_known(rows, "event_type", ["ts", "event_id"], "value")


@query(
    "history_30d",
    f"""
WITH k AS (SELECT DISTINCT event_type FROM events), c AS (SELECT event_type, CAST(day AS DATE) AS day FROM k, generate_series(DATE '{FIRST}', DATE '{LAST}', INTERVAL 1 DAY) g(day)),
a AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, round({SUM} / count(*), 6) AS mean, arg_max(event_id, ts) AS newest FROM events GROUP BY 1, 2)
SELECT c.event_type, CAST(c.day AS VARCHAR) AS day, coalesce(n, 0) AS n, coalesce(mean, 0.0) AS mean, newest FROM c LEFT JOIN a USING (event_type, day)
""",
)
def history_30d(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_type", "event_id", "value", "ts")
    days = events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.round(total() / F.count("*"), 6).alias("mean"), F.max_by("event_id", "ts").alias("newest"))
    return calendar.dense(days, events, "event_type", "day", FIRST, LAST, {"n": 0, "mean": 0.0}).withColumn("day", F.col("day").cast("string"))


@query(
    "detail_7d",
    f"""
WITH e AS (SELECT event_type, CAST(ts AS DATE) AS day, arg_max(value, ts) AS v FROM events GROUP BY 1, 2)
SELECT event_type, round(CAST(sum(CASE WHEN day >= DATE '{LAST}' - 6 THEN CAST(v AS DECIMAL(18,2)) END) AS DOUBLE), 2) AS sum_7d, round(CAST(sum(CAST(v AS DECIMAL(18,2))) AS DOUBLE), 2) AS sum_30d,
  coalesce(CAST(max(CASE WHEN day >= DATE '{LAST}' - 6 THEN day END) AS VARCHAR), 'Sin datos') AS newest FROM e WHERE day BETWEEN DATE '{LAST}' - 29 AND DATE '{LAST}' GROUP BY 1
""",
)
def detail_7d(spark: SparkSession, d: str) -> DataFrame:
    """The last value of each day wins; sums over the last 7 and 30 days."""
    days = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.max_by("value", "ts").alias("v"))
    end = F.lit(LAST).cast("date")
    week = F.col("day") >= F.date_sub(end, 6)
    rows = days.filter(F.col("day").between(F.date_sub(end, 29), end))
    return rows.groupBy("event_type").agg(
        F.round(F.sum(F.when(week, money(F.col("v")))).cast("double"), 2).alias("sum_7d"), F.round(total("v"), 2).alias("sum_30d"), F.coalesce(F.max(F.when(week, F.col("day"))).cast("string"), F.lit("Sin datos")).alias("newest")
    )


FEATURES = """
f AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN CAST(json_extract(props, '$.k') AS DOUBLE) END AS fa, CASE WHEN event_id % 3 = 1 THEN CAST(json_extract(props, '$.k') AS DOUBLE) END AS fb FROM events)
"""


def feature_rows(spark: SparkSession, d: str) -> DataFrame:
    """Two feature keys that each row may or may not have."""
    k = F.element_at(J.numeric_features(F.col("props")), "k")
    return table(spark, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 3 == 0, k).alias("fa"), F.when(F.col("event_id") % 3 == 1, k).alias("fb"))


@query(
    "lkv_features",
    f"WITH {FEATURES} SELECT event_id, coalesce(last_value(fa IGNORE NULLS) OVER w, 0.0) AS fa_known, coalesce(last_value(fb IGNORE NULLS) OVER w, 0.0) AS fb_known FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
)
def lkv_features(spark: SparkSession, d: str) -> DataFrame:
    return rolling.latest_known(feature_rows(spark, d), "user_id", ["ts", "event_id"], ["fa", "fb"], bucket=F.to_date("ts")).select("event_id", "fa_known", "fb_known")


AS_OF_DAY = f"""
{FEATURES}, l AS (SELECT user_id, CAST(ts AS DATE) AS day, ts, event_id, coalesce(last_value(fa IGNORE NULLS) OVER w, 0.0) AS fa, coalesce(last_value(fb IGNORE NULLS) OVER w, 0.0) AS fb FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
x AS (SELECT user_id, day, fa, fb FROM l QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY ts DESC, event_id DESC) = 1)
"""


@query("features_asof_day", f"WITH {AS_OF_DAY} SELECT user_id, CAST(day AS VARCHAR) AS day, fa, fb FROM x")
def features_asof_day(spark: SparkSession, d: str) -> DataFrame:
    return rolling.as_of_day(feature_rows(spark, d), "user_id", "ts", ["ts", "event_id"], ["fa", "fb"]).withColumn("day", F.col("day").cast("string"))


def user_days(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"))
    return events, events.filter("event_type = 'error'").select("user_id", F.col("day").alias("hit"))


def _label_sql(test: str) -> str:
    return f"SELECT event_id, CAST(EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'error' AND e.user_id = events.user_id AND {test}) AS INTEGER) AS label FROM events"


@query("label_future_7d", _label_sql("CAST(e.ts AS DATE) > CAST(events.ts AS DATE) AND CAST(e.ts AS DATE) <= CAST(events.ts AS DATE) + 7"))
def label_future_7d(spark: SparkSession, d: str) -> DataFrame:
    rows, hits = user_days(spark, d)
    return intervals.happens_after(rows, hits, "user_id", "day", "hit").select("event_id", "label")


@query("label_past_7d", _label_sql("CAST(e.ts AS DATE) >= CAST(events.ts AS DATE) - 7 AND CAST(e.ts AS DATE) <= CAST(events.ts AS DATE)"))
def label_past_7d(spark: SparkSession, d: str) -> DataFrame:
    rows, hits = user_days(spark, d)
    return intervals.happened_before(rows, hits, "user_id", "day", "hit").select("event_id", "label")


@query(
    "supervised_matrix",
    f"""
WITH {AS_OF_DAY}, h AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS hit FROM events WHERE event_type = 'error')
SELECT user_id, CAST(day AS VARCHAR) AS day, fa, fb, CAST(EXISTS (SELECT 1 FROM h WHERE h.user_id = x.user_id AND hit > day AND hit <= day + 7) AS INTEGER) AS label FROM x
""",
)
def supervised_matrix(spark: SparkSession, d: str) -> DataFrame:
    """One row for each entity and day: features as of its end, and whether an event follows within a week."""
    rows = rolling.as_of_day(feature_rows(spark, d), "user_id", "ts", ["ts", "event_id"], ["fa", "fb"])
    _, hits = user_days(spark, d)
    return intervals.happens_after(rows, hits, "user_id", "day", "hit").withColumn("day", F.col("day").cast("string"))


@query("medians", "SELECT event_type, median(value) AS median FROM events GROUP BY 1")
def medians(spark: SparkSession, d: str) -> DataFrame:
    return stats.medians(table(spark, d, "events"), "event_type", "value")


@query("feature_zero_fill", f"WITH {FEATURES} SELECT event_id, coalesce(fa, 0.0) AS fa, coalesce(fb, 0.0) AS fb FROM f")
def feature_zero_fill(spark: SparkSession, d: str) -> DataFrame:
    return feature_rows(spark, d).select("event_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("fa", "fb")])


@query("daily_sum_count", f"SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round({SUM}, 3) AS total, count(*) AS records FROM events GROUP BY 1, 2")
def daily_sum_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.round(total(), 3).alias("total"), F.count("*").alias("records"))


@query(
    "two_phase_sum",
    f"WITH p AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, sum(CAST(value AS DECIMAL(18,2))) AS s FROM events GROUP BY 1, 2, 3) SELECT user_id, CAST(day AS VARCHAR) AS day, round(CAST(sum(s) AS DOUBLE), 3) AS total, count(*) AS partial_sums FROM p GROUP BY 1, 2",
)
def two_phase_sum(spark: SparkSession, d: str) -> DataFrame:
    """Sums by file (here: by type) first, then sums of sums; the count is that of the partial sums."""
    partial = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day"), "event_type").agg(F.sum(money(F.col("value"))).alias("s"))
    return partial.groupBy("user_id", F.col("day").cast("string").alias("day")).agg(F.round(F.sum("s").cast("double"), 3).alias("total"), F.count("*").alias("partial_sums"))


@query(
    "snapshot_lists",
    f"""
SELECT event_type, round({SUM} / count(*), 3) AS mean, count(*) AS n, array_to_string(list_slice(list_sort(list_distinct(list(CAST(user_id AS VARCHAR)))), 1, 30), ',') AS users,
  array_to_string(list_slice(list(CAST(event_id AS VARCHAR) ORDER BY event_id), 1, 50), ',') AS arrivals FROM events GROUP BY 1
""",
)
def snapshot_lists(spark: SparkSession, d: str) -> DataFrame:
    """Mean, count, and two lists of bounded length: distinct sorted, and by arrival.  Only rows that can be in a list
    are collected."""
    from pyspark.sql import Window

    rows = table(spark, d, "events").select("event_type", "event_id", "user_id", "value")
    base = rows.groupBy("event_type").agg(F.round(total() / F.count("*"), 3).alias("mean"), F.count("*").alias("n"))
    users = rows.select("event_type", F.col("user_id").cast("string").alias("u")).distinct()
    users = users.withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy("u"))).filter("r <= 30").groupBy("event_type").agg(F.array_join(F.sort_array(F.collect_list("u")), ",").alias("users"))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy("event_id"))).filter("r <= 50").groupBy("event_type").agg(F.sort_array(F.collect_list("event_id")).alias("a"))
    return base.join(users, "event_type").join(first.select("event_type", F.array_join(F.transform("a", lambda x: x.cast("string")), ",").alias("arrivals")), "event_type")


@query("count_by_year", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders WHERE year(o_orderdate) >= 1996 GROUP BY 1")
def count_by_year(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n")).filter("year >= 1996")


@query("high_water_mark", "SELECT event_type, CAST(max(ts) AS VARCHAR) AS mark FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) < 50 GROUP BY 1")
def high_water_mark(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter(F.get_json_object("props", "$.k").cast("int") < 50).groupBy("event_type").agg(F.max("ts").cast("string").alias("mark"))


@query(
    "incremental_slice",
    """
WITH m AS (SELECT event_type, max(ts) - INTERVAL 2 DAY AS lo
FROM events
GROUP BY 1) SELECT event_id
FROM events JOIN m USING (event_type)
WHERE ts >= lo
""",
)
def incremental_slice(spark: SparkSession, d: str) -> DataFrame:
    """Rows from two days before each feed's newest on."""
    events = table(spark, d, "events").select("event_id", "event_type", "ts")
    marks = events.groupBy("event_type").agg((F.max("ts") - F.expr("interval 2 days")).alias("lo"))
    return events.join(marks, "event_type").filter("ts >= lo").select("event_id")


@query("minute_snapshot", f"SELECT CAST(date_trunc('minute', ts) AS VARCHAR) AS minute, event_type, count(*) AS n, {SUM} AS total FROM events GROUP BY 1, 2")
def minute_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.date_trunc("MINUTE", "ts").cast("timestamp_ntz").cast("string").alias("minute"), "event_type").agg(F.count("*").alias("n"), total().alias("total"))


@query(
    "json_overlay",
    "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value ELSE CAST(json_extract(props, '$.k') AS DOUBLE) END AS k, CASE WHEN event_id % 4 = 0 THEN CAST(event_id AS DOUBLE) END AS extra, json_extract_string(props, '$.k') AS first_key FROM events",
)
def json_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Typed columns override a document's keys; the first key that is there wins."""
    typed = {"k": F.when(F.col("event_id") % 2 == 0, F.col("value")), "extra": F.when(F.col("event_id") % 4 == 0, F.col("event_id").cast("double"))}
    over = J.overlay(J.numeric_features(F.col("props")), typed)
    rows = table(spark, d, "events").select("event_id", over.alias("m"), J.first_present(J.parse(F.col("props")), ["missing", "k"]).alias("first_key"))
    return rows.select("event_id", F.col("m")["k"].alias("k"), F.col("m")["extra"].alias("extra"), "first_key")


@query("max_per_group", "SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(max(ts) AS VARCHAR) AS newest FROM events GROUP BY 1, 2")
def max_per_group(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.max("ts").cast("string").alias("newest"))


