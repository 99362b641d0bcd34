"""Streams over the driver's tables, replayed to their end and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.jobs import Folder
from ..session import scratch, table
from ..streaming import ingest
from .registry import query


def source(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    files = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    return files.withColumn("at", F.col("ts").cast("timestamp"))


def replay(spark: SparkSession, rows: DataFrame, keys: list[str]) -> DataFrame:
    folder = scratch(spark, "stream")
    ingest.start(rows, f"replay_{uuid.uuid4().hex[:8]}", f"{folder}/checkpoint", ingest.insert_if_absent(f"{folder}/table", keys)).awaitTermination()
    return spark.read.parquet(f"{folder}/table")


@query(
    "stream_daily",
    """
SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS records
FROM events
WHERE CAST(ts AS DATE) < (SELECT CAST(max(ts) - INTERVAL 2 DAY AS DATE)
FROM events)
GROUP BY 1, 2
""",
)
def stream_daily(spark: SparkSession, d: str) -> DataFrame:
    """Days whose look-back has passed."""
    return replay(spark, ingest.daily(source(spark, d), "event_type", "at", "value"), ["event_type", "day"]).withColumn("day", F.col("day").cast("string"))


@query("stream_dedupe", "SELECT user_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events GROUP BY 1, 2, 3")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = source(spark, d).withColumn("day", F.to_date("at")).select("user_id", "event_type", "day", "at")
    return replay(spark, ingest.deduplicated(rows, ["user_id", "event_type", "day"], "at"), ["user_id", "event_type", "day"]).select("user_id", "event_type", F.col("day").cast("string").alias("day"))


@query(
    "stream_insert_absent",
    """
SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS records, 2 AS runs
FROM events
WHERE CAST(ts AS DATE) < (SELECT CAST(max(ts) - INTERVAL 2 DAY AS DATE)
FROM events)
GROUP BY 1, 2
""",
)
def stream_insert_absent(spark: SparkSession, d: str) -> DataFrame:
    """The same feed replayed twice into one table: the second run inserts nothing.  Both runs report how they went."""
    folder = scratch(spark, "stream")
    runs = []
    for n in range(2):
        rows = ingest.daily(source(spark, d), "event_type", "at", "value")
        q = ingest.start(rows, f"replay_{uuid.uuid4().hex[:8]}", f"{folder}/checkpoint{n}", ingest.insert_if_absent(f"{folder}/table", ["event_type", "day"], day="day"))
        q.awaitTermination()
        runs.append(ingest.run_log(q)["status"])
    return spark.read.parquet(f"{folder}/table").select("event_type", F.col("day").cast("string").alias("day"), "total", "records", F.lit(runs.count("ok")).alias("runs"))


@query("stream_update_days", "SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS records FROM events GROUP BY 1, 2")
def stream_update_days(spark: SparkSession, d: str) -> DataFrame:
    """All days, also those whose look-back hasn't passed: what a batch adds to a day takes the place of what was there."""
    folder = scratch(spark, "stream")
    tables = Folder(spark, f"{folder}/tables")
    rows = ingest.daily(source(spark, d), "event_type", "at", "value")
    writer = ingest.replace_days(tables, "days", ["event_type", "day"], "day", "daily")
    ingest.start(rows, f"replay_{uuid.uuid4().hex[:8]}", f"{folder}/checkpoint", writer, mode="update").awaitTermination()
    return tables.read("days").select("event_type", F.col("day").cast("string").alias("day"), "total", "records")


@query(
    "stream_isolated",
    """
SELECT event_type AS source, 'ok' AS status, 1::BIGINT AS runs, (SELECT count(*) FROM events) AS records FROM events GROUP BY 1
UNION ALL SELECT min(event_type), 'failed', 1, 0 FROM events
""",
)
def stream_isolated(spark: SparkSession, d: str) -> DataFrame:
    """A feed for each kind of event, one of which breaks off and is started again: the others don't notice.  Each run is in
    the log, with the rows that it has read."""
    folder = scratch(spark, "stream")
    kinds = sorted(r[0] for r in table(spark, d, "events").select("event_type").distinct().collect())  # a handful
    broken = []

    def writer(kind: str):
        insert = ingest.insert_if_absent(f"{folder}/{kind}", ["event_id"])

        def write(batch: DataFrame, number: int) -> None:
            if kind == kinds[0] and not broken:
                broken.append(number)
                raise RuntimeError("the feed is down")
            insert(batch, number)

        return write

    feeds = [ingest.Feed(kind, sorted(ingest.INTERVALS)[i % 4], source(spark, d).filter(F.col("event_type") == kind), writer(kind)) for i, kind in enumerate(kinds)]
    ingest.run_feeds(spark, feeds, f"{folder}/checkpoints", f"{folder}/log")
    log = spark.read.parquet(f"{folder}/log").withColumn("source", F.regexp_replace("source", "-[0-9a-f]{8}$", ""))
    return log.groupBy("source", "status").agg(F.count("*").alias("runs"), F.sum("records_downloaded").alias("records"))
