"""Incremental ingestion: one query for each feed, late rows within a look-back, rows inserted only if absent."""

from __future__ import annotations

import datetime
import re
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.jobs import Folder, Job
from ..operators.writes import absent, append

#: How late a row may be: the look-back of the incremental feeds.
LOOK_BACK = "2 days"
#: How often each kind of feed is polled.
INTERVALS = {"stations": "30 minutes", "sensors": "1 hour", "articles": "6 hours", "districts": "24 hours"}


def read_folder(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def daily(rows: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Sum and count of each key and day; a day is given out when the look-back has passed."""
    return rows.withWatermark(ts, LOOK_BACK).groupBy(key, F.window(ts, "1 day").alias("w")).agg(F.sum(F.col(value).cast("decimal(18,2)")).cast("double").alias("total"), F.count("*").alias("records")).select(key, F.to_date("w.start").alias("day"), "total", "records")


def snapshots(rows: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Mean of each key and minute."""
    return rows.withWatermark(ts, LOOK_BACK).groupBy(key, F.window(ts, "1 minute").alias("w")).agg(F.avg(value).alias("mean"), F.count("*").alias("n")).select(key, F.col("w.start").alias("minute"), "mean", "n")


def deduplicated(rows: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """The first row of each key within the look-back."""
    return rows.withWatermark(ts, LOOK_BACK).dropDuplicatesWithinWatermark(keys)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def insert_if_absent(path: str, keys: list[str], day: str | None = None) -> Callable[[DataFrame, int], None]:
    """A batch writer: rows of a key that the table has are discarded, so a batch that runs again inserts nothing.

    With ``day``, a column of the key, the table has a folder for each day, and a batch is held against its own days only:
    what it costs doesn't grow with the table.  What is collected is a batch's days, a few within the look-back.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if not day:
            append(absent(batch, spark.read.parquet(path), keys) if exists(spark, path) else batch, path)
            return
        batch = batch.persist()  # it is looked at twice
        days = [r[0] for r in batch.select(day).distinct().collect()]
        new = batch
        if exists(spark, path):
            old = spark.read.schema(batch.schema).parquet(path)
            new = absent(batch, old.filter(F.col(day).isin([x for x in days if x is not None]) | (F.lit(None in days) & F.col(day).isNull())), keys)
        new.write.mode("append").partitionBy(day).parquet(path)
        batch.unpersist()

    return write


def replace_days(folder: Folder, table: str, keys: list[str], day: str, run: str) -> Callable[[DataFrame, int], None]:
    """A batch writer for a query in update mode: a key's new row takes the place of the one that an earlier batch left, also
    when its day was thought to be over.  Only the days of the batch are rewritten, in one commit; a batch that runs again
    does nothing."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        with Job(folder, f"{run}-{number}") as job:
            if not batch.isEmpty():
                job.upsert(table, batch, keys, by=day)
        batch.unpersist()

    return write


def start(rows: DataFrame, name: str, checkpoint: str, writer: Callable[[DataFrame, int], None], every: str | None = None, mode: str = "append") -> StreamingQuery:
    """A query of its own for each feed, so that one that fails doesn't stop the others.  Without an interval it takes
    what is there and ends."""
    out = rows.writeStream.queryName(name).option("checkpointLocation", checkpoint).outputMode(mode).foreachBatch(writer)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def run_log(query: StreamingQuery) -> dict:
    """Counters of the newest batch, for the log of runs."""
    last = query.lastProgress
    return {"source": query.name, "status": "failed" if query.exception() else "ok", "records_downloaded": last.numInputRows if last else 0, "batch": last.batchId if last else -1}


@dataclass
class Feed:
    """What a feed delivers, where its rows go, and its kind, which says how often it is polled."""

    name: str
    kind: str
    rows: DataFrame
    writer: Callable[[DataFrame, int], None]
    mode: str = "append"

    @property
    def interval(self) -> str:
        return INTERVALS[self.kind]


def reason(trace: str) -> str:
    """The innermost error of a trace of the engine's and of Python's calls."""
    named = [line.strip() for line in trace.splitlines() if re.match(r"\s*[\w.]*(Error|Exception): ", line)]
    return (named[-1] if named else trace)[:500]


class RunLog(StreamingQueryListener):
    """Rows of the log of runs, from what the engine tells about its queries: one for each run, with its rows and batches
    and how it ended."""

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._open: dict[str, dict] = {}
        self._done: list[dict] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        with self._lock:
            self._open[str(event.runId)] = {"source": event.name, "run_started_at": datetime.datetime.fromisoformat(event.timestamp.replace("Z", "+00:00")), "records_downloaded": 0, "batches": 0}

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        with self._lock:
            run = self._open.get(str(p.runId))
            if run and p.numInputRows:
                run["records_downloaded"] += p.numInputRows
                run["batches"] += 1

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        with self._lock:
            run = self._open.pop(str(event.runId), None)
            if run:
                run |= {"status": "failed" if event.exception else "ok", "detail": reason(event.exception) if event.exception else None, "run_finished_at": datetime.datetime.now(datetime.timezone.utc)}
                self._done.append(run)

    def ended(self, names: set[str]) -> int:
        with self._lock:
            return sum(r["source"] in names for r in self._done)

    def flush(self, spark: SparkSession, path: str) -> int:
        """Append the rows of the runs that have ended."""
        with self._lock:
            rows, self._done = self._done, []
        if rows:
            schema = "source string, status string, run_started_at timestamp, run_finished_at timestamp, records_downloaded long, batches long, detail string"
            append(spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema), path, 1)
        return len(rows)


def run_feeds(spark: SparkSession, feeds: list[Feed], folder: str, log: str, attempts: int = 3, polled: bool = False, wait: float = 60) -> dict[str, bool]:
    """Run feeds beside each other until each has taken what is there (``polled``: for good, at their intervals), and start
    one that fails again, from its checkpoint, up to ``attempts`` times.  Every run leaves a row in the log.

    Returns whether each feed ended well.
    """
    told = RunLog()
    spark.streams.addListener(told)
    prefix = uuid.uuid4().hex[:8]
    names = {f.name: f"{f.name}-{prefix}" for f in feeds}
    runs = dict.fromkeys(names, 0)
    ended: dict[str, bool] = {}
    try:
        running: dict[str, StreamingQuery] = {}
        while len(ended) < len(feeds):
            for f in feeds:
                if f.name not in ended and f.name not in running:
                    running[f.name] = start(f.rows, names[f.name], f"{folder}/{f.name}", f.writer, f.interval if polled else None, f.mode)
                    runs[f.name] += 1
            for name, query in list(running.items()):
                try:
                    over = query.awaitTermination(1)
                except StreamingQueryException:
                    over = True
                if over:
                    del running[name]
                    if query.exception() is None or runs[name] >= attempts:
                        ended[name] = query.exception() is None
        limit = time.monotonic() + wait  # the engine tells listeners a little later
        while told.ended(set(names.values())) < sum(runs.values()) and time.monotonic() < limit:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(told)
        told.flush(spark, log)
    return ended
