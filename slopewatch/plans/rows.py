"""Selections of rows: newest, top, first, pages, filters, lookups, unions and writes in query form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.categories import severity
from ..functions.numbers import clamp, money, number
from ..functions.text import digits_only
from ..operators import latest, writes
from ..session import table
from .registry import query

NOW = "2024-01-28 00:00:00"
TIES = "o.o_custkey = m.o_custkey AND o.o_orderdate = m.d"
NEWEST = "(SELECT o_custkey, max(o_orderdate) AS d FROM orders GROUP BY 1) m"


def orders_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders")


@query("latest_max_join", f"SELECT o_orderkey, o.o_custkey, o_totalprice FROM orders o JOIN {NEWEST} ON {TIES}")
def latest_max_join(spark: SparkSession, d: str) -> DataFrame:
    rows = orders_of(spark, d).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return latest.latest_with_ties(rows, "o_custkey", "o_orderdate").drop("o_orderdate")


@query(
    "latest_row_number",
    """
SELECT o_orderkey, o_custkey, o_totalprice
FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey
ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
""",
)
def latest_row_number(spark: SparkSession, d: str) -> DataFrame:
    rows = orders_of(spark, d).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return latest.latest_one(rows, "o_custkey", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("topn_latest", f"SELECT o.o_custkey, o_orderkey, o_totalprice FROM orders o JOIN {NEWEST} ON {TIES} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topn_latest(spark: SparkSession, d: str) -> DataFrame:
    return latest_max_join(spark, d).select("o_custkey", "o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(clamp(20, 200))


@query("topn_counts", "SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
def topn_counts(spark: SparkSession, d: str) -> DataFrame:
    return latest.top_groups(table(spark, d, "events").filter("event_type = 'error'"), "user_id", 10)


@query("top_all_history", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 3")
def top_all_history(spark: SparkSession, d: str) -> DataFrame:
    return orders_of(spark, d).select("o_orderkey", "o_custkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(3)


@query("latest_page", "SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def latest_page(spark: SparkSession, d: str) -> DataFrame:
    return orders_of(spark, d).orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(clamp(50, 200)).select("o_orderkey", F.col("o_orderdate").cast("string").alias("at"))


@query("newest_events", "SELECT event_id, CASE WHEN event_id % 400 <> 0 THEN value END AS v FROM events ORDER BY v DESC NULLS FIRST, event_id LIMIT 20")
def newest_events(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 400 != 0, F.col("value")).alias("v"))
    return rows.orderBy(F.desc_nulls_first("v"), "event_id").limit(20)


@query(
    "severity_null_zero",
    "WITH a AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Rojo' WHEN 'O' THEN 'Naranja' ELSE 'Verde' END AS nivel, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS score FROM orders) "
    "SELECT o_orderkey, nivel, score FROM a ORDER BY CASE nivel WHEN 'Rojo' THEN 0 WHEN 'Naranja' THEN 1 ELSE 99 END, coalesce(score, 0) DESC, o_orderkey LIMIT 10",
)
def severity_null_zero(spark: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("o_orderstatus") == "F", "Rojo").when(F.col("o_orderstatus") == "O", "Naranja").otherwise("Verde")
    rows = orders_of(spark, d).select("o_orderkey", level.alias("nivel"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("score"))
    return rows.orderBy(severity(F.col("nivel")), F.coalesce("score", F.lit(0.0)).desc(), "o_orderkey").limit(10)


@query("oldest_first", "SELECT event_id FROM events WHERE user_id = 7 ORDER BY ts, event_id LIMIT 25")
def oldest_first(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter("user_id = 7").orderBy("ts", "event_id").limit(25).select("event_id")


@query(
    "last_slice",
    """
SELECT user_id, array_to_string(list_slice(l, greatest(len(l) - 29, 1), len(l)), ',') AS ids
FROM (SELECT user_id, list(event_id
ORDER BY event_id) AS l
FROM events
GROUP BY 1)
""",
)
def last_slice(spark: SparkSession, d: str) -> DataFrame:
    """The newest 30 of each user, oldest first; only these are collected."""
    rows = latest.tail(table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id", 30)
    ids = F.sort_array(F.collect_list("event_id"))
    return rows.groupBy("user_id").agg(F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids"))


@query(
    "conversation_tail",
    """
SELECT conv_id, turn, md5(text) AS text
FROM conversations
WHERE role IN ('user', 'assistant')
QUALIFY row_number() OVER (PARTITION BY conv_id
ORDER BY turn DESC) <= 4
""",
)
def conversation_tail(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").filter(F.col("role").isin("user", "assistant"))
    return latest.tail(rows, "conv_id", "turn", 4).select("conv_id", "turn", F.md5("text").alias("text")).orderBy("conv_id", "turn")


@query("conversation_head", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 2")
def conversation_head(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, d, "conversations").select("conv_id", "turn", "role", rank.alias("r")).filter("r <= 2").drop("r")


@query(
    "insert_if_absent",
    "WITH o AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, event_type FROM events WHERE event_id % 3 = 0) SELECT event_id FROM events n WHERE event_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM o WHERE o.user_id = n.user_id AND o.day = CAST(n.ts AS DATE) AND o.event_type = n.event_type)",
)
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "user_id", F.to_date("ts").alias("day"), "event_type")
    return writes.absent(rows.filter("event_id % 3 <> 0"), rows.filter("event_id % 3 = 0"), ["user_id", "day", "event_type"]).select("event_id")


@query(
    "dedupe_or_key",
    """
WITH o AS (SELECT *
FROM events
WHERE event_id % 10 = 0) SELECT event_id
FROM events n
WHERE NOT EXISTS (SELECT 1
FROM o
WHERE o.event_id = n.event_id) AND NOT EXISTS (SELECT 1
FROM o
WHERE CAST(o.ts AS DATE) = CAST(n.ts AS DATE) AND o.user_id = n.user_id)
""",
)
def dedupe_or_key(spark: SparkSession, d: str) -> DataFrame:
    """Absent by id and by (day, entity): either match keeps a row out."""
    rows = table(spark, d, "events").select("event_id", "user_id", F.to_date("ts").alias("day"))
    return writes.absent(rows, rows.filter("event_id % 10 = 0"), ["event_id"], ["day", "user_id"]).select("event_id")


@query(
    "upsert",
    """
SELECT o_orderkey, o_totalprice
FROM orders
WHERE NOT (o_orderkey % 3 = 0)
UNION ALL SELECT o_orderkey, o_totalprice + 1
FROM orders
WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey + 100000000, o_totalprice
FROM orders
WHERE o_orderkey % 7 = 0
""",
)
def upsert(spark: SparkSession, d: str) -> DataFrame:
    old = orders_of(spark, d).select("o_orderkey", "o_totalprice")
    new = old.filter("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1).unionByName(old.filter("o_orderkey % 7 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 100000000))
    return writes.upserted(old, new, ["o_orderkey"])


@query("dedupe_first", "SELECT event_type, user_id, min(event_id) AS event_id FROM events GROUP BY event_type, user_id, CAST(ts AS DATE)")
def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_type", "user_id", "event_id", "ts")
    return latest.first_occurrence(rows, ["event_type", "user_id", F.to_date("ts")], ["event_id"]).select("event_type", "user_id", "event_id")


@query(
    "union_feeds",
    """
SELECT 'a:' || event_id AS row_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, value
FROM events
UNION ALL SELECT 'b:' || o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR), NULL
FROM orders
""",
)
def union_feeds(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "events").select(F.concat(F.lit("a:"), F.col("event_id").cast("string")).alias("row_id"), F.to_date("ts").cast("string").alias("day"), "value")
    b = orders_of(spark, d).select(F.concat(F.lit("b:"), F.col("o_orderkey").cast("string")).alias("row_id"), F.to_date("o_orderdate").cast("string").alias("day"))
    return a.unionByName(b, allowMissingColumns=True)


@query(
    "run_status",
    "WITH n AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 200), l AS (SELECT event_type, event_id FROM n QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1) "
    "SELECT event_type, event_id, (SELECT count(*) FROM events) AS runs, (SELECT coalesce(sum(user_id), 0) FROM events WHERE user_id > 20)::BIGINT AS valid FROM l",
)
def run_status(spark: SparkSession, d: str) -> DataFrame:
    """The newest run of each source among the newest 200, with totals over all runs."""
    rows = table(spark, d, "events").select("event_type", "event_id", "ts", "user_id")
    newest = rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(200)
    totals = rows.agg(F.count("*").alias("runs"), F.coalesce(F.sum(F.when(F.col("user_id") > 20, F.col("user_id"))), F.lit(0)).alias("valid"))
    return latest.latest_one(newest, "event_type", ["ts", "event_id"]).select("event_type", "event_id").crossJoin(F.broadcast(totals))  # one row


@query(
    "sorted_sets",
    """
SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS types, count(DISTINCT event_type) AS n
FROM events
GROUP BY 1
""",
)
def sorted_sets(spark: SparkSession, d: str) -> DataFrame:
    types = F.sort_array(F.collect_set("event_type"))
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(types, ",").alias("types"), F.size(types).cast("long").alias("n"))


@query(
    "key_union",
    """
SELECT array_to_string(list_sort(list(DISTINCT k)), ',') AS keys
FROM (SELECT unnest(json_keys(props)) AS k
FROM events
UNION ALL SELECT 'extra')
""",
)
def key_union(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "events").select(F.explode(F.json_object_keys("props")).alias("k")).distinct().union(spark.createDataFrame([("extra",)], "k string")).distinct()
    return keys.agg(F.array_join(F.sort_array(F.collect_list("k")), ",").alias("keys"))


@query("set_difference", "SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    known = orders_of(spark, d).filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return table(spark, d, "customer").select("c_custkey").distinct().join(known, "c_custkey", "left_anti")


@query(
    "table_totals",
    """
SELECT 'customer' AS name, count(*) AS n
FROM customer
UNION ALL SELECT 'events', count(*)
FROM events
UNION ALL SELECT 'orders', count(*)
FROM orders
""",
)
def table_totals(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name in ("customer", "events", "orders"):
        one = table(spark, d, name).agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "quality_counters",
    """
SELECT event_type, count(*) AS downloaded, count(*) FILTER (WHERE value >= 1) AS valid, count(*) FILTER (WHERE value < 1) AS discarded
FROM events
GROUP BY 1
""",
)
def quality_counters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("downloaded"), F.count_if(F.col("value") >= 1).alias("valid"), F.count_if(F.col("value") < 1).alias("discarded"))


@query(
    "defaults_and_clamp",
    "SELECT c_custkey, coalesce(CAST(d AS VARCHAR), 'Sin datos') AS newest, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, CAST(max(o_orderdate) AS DATE) AS d, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) ON c_custkey = o_custkey ORDER BY c_custkey LIMIT 200",
)
def defaults_and_clamp(spark: SparkSession, d: str) -> DataFrame:
    known = orders_of(spark, d).filter("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.to_date(F.max("o_orderdate")).cast("string").alias("d"), F.count("*").alias("n"))
    page = table(spark, d, "customer").select("c_custkey").orderBy("c_custkey").limit(clamp(5000, 200))
    return page.join(known, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("d", F.lit("Sin datos")).alias("newest"), F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "dim_lookup_chain",
    """
SELECT s_suppkey, n_name, r_name
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE s_acctbal IS NOT NULL
""",
)
def dim_lookup_chain(spark: SparkSession, d: str) -> DataFrame:
    s, n, r = (table(spark, d, x) for x in ("supplier", "nation", "region"))
    return s.filter("s_acctbal is not null").join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("s_suppkey", "n_name", "r_name")


@query(
    "embed_left_join",
    """
SELECT o_orderkey, coalesce(n_name, CAST(c_nationkey AS VARCHAR)) AS nombre
FROM orders JOIN customer ON o_custkey = c_custkey
LEFT JOIN (SELECT *
FROM nation
WHERE n_nationkey < 20) ON c_nationkey = n_nationkey
""",
)
def embed_left_join(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").filter("n_nationkey < 20")
    rows = orders_of(spark, d).select("o_orderkey", "o_custkey").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", F.coalesce("n_name", F.col("c_nationkey").cast("string")).alias("nombre"))


@query(
    "ordered_lookup",
    "WITH w(pos, k) AS (VALUES (0, 7), (1, 3), (2, 999999999), (3, 12)), l AS (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS score FROM orders GROUP BY 1) SELECT CAST(pos AS BIGINT) AS pos, c_custkey, c_name, score FROM w JOIN customer ON c_custkey = k LEFT JOIN l ON o_custkey = k",
)
def ordered_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Asked keys in order, each once; unknown ones dropped, those without a score null."""
    wanted = spark.createDataFrame([([7, 3, 7, 999999999, 12],)], "ks array<bigint>").select(F.posexplode(F.array_distinct("ks")).alias("pos", "k"))
    names = table(spark, d, "customer").select("c_custkey", "c_name").join(wanted, F.col("c_custkey") == F.col("k"))
    scores = orders_of(spark, d).groupBy("o_custkey").agg(F.max_by("o_totalprice", "o_orderkey").alias("score"))
    return names.join(scores, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("pos").cast("long").alias("pos"), "c_custkey", "c_name", "score").orderBy("pos")


@query(
    "neighbourhood_join",
    "SELECT p_partkey, coalesce(n_name, 'Sin datos') AS nombre, coalesce(n_regionkey, 0) AS score FROM part LEFT JOIN nation ON TRY_CAST(regexp_extract(p_brand, '#(\\d+)', 1) AS INTEGER) = n_nationkey WHERE p_type IN ('SMALL', 'LARGE') AND (NOT (p_size > 40) OR p_retailprice > 1000)",
)
def neighbourhood_join(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").filter(F.col("p_type").isin("SMALL", "LARGE") & (~(F.col("p_size") > 40) | (F.col("p_retailprice") > 1000)))
    code = F.regexp_extract("p_brand", r"#(\d+)", 1).try_cast("int")
    n = table(spark, d, "nation")
    return rows.join(n, code == n.n_nationkey, "left").select("p_partkey", F.coalesce("n_name", F.lit("Sin datos")).alias("nombre"), F.coalesce("n_regionkey", F.lit(0)).alias("score"))


@query("visible_count", "SELECT p_type, count(*) AS visible FROM part WHERE p_type IN ('SMALL', 'PROMO') AND p_size >= 10 GROUP BY 1")
def visible_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter(F.col("p_type").isin("SMALL", "PROMO") & (F.col("p_size") >= 10)).groupBy("p_type").agg(F.count("*").alias("visible"))


@query(
    "geocode_update",
    """
SELECT event_id, coalesce(CASE WHEN event_id % 4 <> 0 THEN user_id END, CASE WHEN value > 5 THEN user_id + 1000 END) AS commune_id,
  event_id % 4 = 0 AND value > 5 AS resolved
FROM events
""",
)
def geocode_update(spark: SparkSession, d: str) -> DataFrame:
    """Fill in an id only where it is missing and can be resolved."""
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("user_id")).alias("commune_id"), F.when(F.col("value") > 5, F.col("user_id") + 1000).alias("found"))
    done = F.col("commune_id").isNull() & F.col("found").isNotNull()
    return writes.filled(rows.withColumn("resolved", done), "commune_id", F.col("found")).select("event_id", "commune_id", "resolved")


@query(
    "numeric_coerce",
    """
SELECT event_id, TRY_CAST(replace(CASE event_id % 4 WHEN 0 THEN 'x' WHEN 1 THEN replace(CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR), '.',
  ',') WHEN 2 THEN ' ' ELSE CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END, ',', '.') AS DOUBLE) AS v
FROM events
WHERE event_id % 4 IN (1, 3)
""",
)
def numeric_coerce(spark: SparkSession, d: str) -> DataFrame:
    plain = money(F.col("value")).cast("string")
    text = F.when(F.col("event_id") % 4 == 0, "x").when(F.col("event_id") % 4 == 1, F.replace(plain, F.lit("."), F.lit(","))).when(F.col("event_id") % 4 == 2, " ").otherwise(plain)
    return table(spark, d, "events").select("event_id", number(text).alias("v")).filter("v >= 0")


@query(
    "null_filters",
    """
WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN user_id END AS a, CASE WHEN event_id % 5 = 0 THEN value END AS b
FROM events) SELECT event_id, a IS NOT NULL AND b IS NOT NULL AS has_coords
FROM e
WHERE a IS NULL OR b IS NOT NULL
""",
)
def null_filters(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("a"), F.when(F.col("event_id") % 5 == 0, F.col("value")).alias("b"))
    return rows.filter(F.col("a").isNull() | F.col("b").isNotNull()).select("event_id", (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("has_coords"))


@query("value_range", "SELECT event_id FROM events WHERE value - 901 > -900 AND value >= 0")
def value_range(spark: SparkSession, d: str) -> DataFrame:
    """Sentinels at -900 or below and negative values are dropped."""
    return table(spark, d, "events").filter(F.col("value") - 901 > -900).filter("value >= 0").select("event_id")


def filtered(df: DataFrame, equal: dict | None = None, least: dict | None = None, most: dict | None = None) -> DataFrame:
    """Filters for the parameters that are given; an empty one doesn't filter."""
    for test, given in ((lambda c, v: c == v, equal), (lambda c, v: c >= v, least), (lambda c, v: c <= v, most)):
        for name, value in (given or {}).items():
            if value not in (None, ""):
                df = df.filter(test(F.col(name), F.lit(value)))
    return df


@query(
    "optional_filters",
    """
SELECT o_orderkey
FROM orders
WHERE o_orderstatus = 'F' AND strftime(o_orderdate, '%Y-%m-%d') >= '1997-01-01' AND strftime(o_orderdate, '%Y-%m-%d') <= '1999-12-31'
""",
)
def optional_filters(spark: SparkSession, d: str) -> DataFrame:
    rows = orders_of(spark, d).withColumn("fecha", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return filtered(rows, {"o_orderstatus": "F", "o_orderpriority": ""}, {"fecha": "1997-01-01"}, {"fecha": "1999-12-31"}).select("o_orderkey")


@query("ts_since", f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 3 DAY")
def ts_since(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter(F.col("ts") >= F.lit(NOW).cast("timestamp_ntz") - F.expr("interval 3 days")).select("event_id")


@query("day_window", f"SELECT event_id FROM events WHERE CAST(ts AS DATE) BETWEEN CAST(TIMESTAMP '{NOW}' AS DATE) - 6 AND CAST(TIMESTAMP '{NOW}' AS DATE)")
def day_window(spark: SparkSession, d: str) -> DataFrame:
    today = F.lit(NOW).cast("date")
    return table(spark, d, "events").filter(F.to_date("ts").between(F.date_sub(today, 6), today)).select("event_id")


@query("like_prefix", "SELECT p_partkey FROM part WHERE p_name LIKE 'red%'")
def like_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter(F.col("p_name").startswith("red")).select("p_partkey")


@query("remote_like", "SELECT p_partkey FROM part WHERE upper(p_name) LIKE '%BOLT%'")
def remote_like(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter(F.upper("p_name").like("%BOLT%")).select("p_partkey")


@query("json_equals", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '42'")
def json_equals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter(F.get_json_object("props", "$.k") == "42").select("event_id")


@query("id_normalise", "SELECT c_custkey, CAST(CAST(regexp_replace(c_name, '\\D', '', 'g') AS BIGINT) AS VARCHAR) AS id FROM customer")
def id_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", digits_only(F.col("c_name")).alias("id"))
