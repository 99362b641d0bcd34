"""Session settings the engine expects."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.config(map={**SETTINGS, **settings})
    return (builder.master(master) if master else builder).getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see: under spark.checkpoint.dir, a temporary one only where that is
    unset and all runs on one machine.  It is deleted when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not base and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = (base or f"file://{tempfile.mkdtemp(prefix='slopewatch-')}").rstrip("/")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}-{uuid.uuid4().hex}" if base else folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    atexit.register(_delete, fs, path)
    return fs.makeQualified(path).toString()


def _delete(fs, path) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        fs.delete(path, True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows as a written table: lineage ends there, and its size is known to what joins it."""
    path = f"{scratch(df.sparkSession, name)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
