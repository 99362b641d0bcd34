"""Insert-if-absent, upsert and counted writes on plain Parquet."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.numbers import finite
from ..schemas import SCHEMAS
from ..session import scratch


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]):
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[k])
    return on


def absent(new: DataFrame, old: DataFrame, *keys: list[str]) -> DataFrame:
    """Rows of ``new`` that no row of ``old`` equals in any one of the key lists (nulls equal nulls); several rows of a
    batch with the same key all stay."""
    out = new
    for k in keys:
        out = out.join(old.select(*k).distinct(), null_safe(out, old, k), "left_anti")
    return out


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old`` whose key isn't in ``new``, and all of ``new``."""
    return old.join(new.select(*keys).distinct(), null_safe(old, new, keys), "left_anti").unionByName(new)


def null_not_finite(df: DataFrame) -> DataFrame:
    """NaN and infinities of all floating columns become null."""
    return df.withColumns({c: finite(F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def append(df: DataFrame, path: str, files: int | None = None) -> None:
    """One job, one commit: readers see all rows or none."""
    (df.coalesce(files) if files else df).write.mode("append").parquet(path)


def replace(df: DataFrame, path: str) -> None:
    """Truncate and reload."""
    df.write.mode("overwrite").parquet(path)


def recover(spark: SparkSession, path: str) -> None:
    """Finish what a rewrite that broke off has left: the new state if it is complete, else the old one."""
    jvm = spark.sparkContext._jvm
    target, new, old = (jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + end) for end in ("", ".new", ".old"))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target) and fs.exists(old):
        fs.rename(new if fs.exists(jvm.org.apache.hadoop.fs.Path(new, "_SUCCESS")) else old, target)
    for left in (new, old):
        if fs.exists(target) and fs.exists(left):
            fs.delete(left, True)


def rewrite(spark: SparkSession, df: DataFrame, path: str, keys: list[str]) -> None:
    """Upsert into a Parquet folder: the new state is written beside it, the old one moved away, the new one moved in.

    At any time one of them is whole, and the next rewrite (or ``recover``) puts it in place.
    """
    jvm = spark.sparkContext._jvm
    target, new, old = (jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + end) for end in ("", ".new", ".old"))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    recover(spark, path)
    before = spark.read.parquet(path) if fs.exists(target) else df.limit(0)
    upserted(before, df, keys).write.mode("overwrite").parquet(new.toString())
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(new, target)
    fs.delete(old, True)


def conformed(df: DataFrame, name: str) -> DataFrame:
    """The columns of a table of the schema, in its order and types; those that are missing are null.

    A required column that is missing is an error.
    """
    fields = StructType.fromDDL(SCHEMAS[name]).fields
    lost = [f.name for f in fields if not f.nullable and f.name not in df.columns]
    if lost:
        raise ValueError(f"{name} needs {', '.join(lost)}")
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def filled(df: DataFrame, column: str, value) -> DataFrame:
    """In-place update of what is null."""
    return df.withColumn(column, F.coalesce(F.col(column), value))


def counted(df: DataFrame, valid) -> tuple[DataFrame, Observation]:
    """The valid rows, and counters of all rows that are read for them: downloaded, valid, discarded.

    The counters are taken by the job that writes (or counts) the rows, so the input is read once; they are there when it
    has ended.
    """
    seen = Observation()
    ok = F.coalesce(valid, F.lit(False))
    return df.observe(seen, F.count(F.lit(1)).alias("downloaded"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("discarded")).filter(ok), seen


def logged(df: DataFrame, valid, source: str, log: str, write: Callable[[DataFrame], None]) -> dict:
    """Write the valid rows and a row of the log of runs, whether the write works or not: counters and "ok", or no counters,
    "failed" and why.  The failure is raised again."""
    started, status, detail, counts = datetime.datetime.now(), "failed", None, {}
    rows, seen = counted(df, valid)
    try:
        write(rows)
        status, counts = "ok", seen.get
    except Exception as e:
        detail = str(e)[:500]
        raise
    finally:
        append(run_row(df.sparkSession, source, status, counts, started, datetime.datetime.now(), detail), log)
    return counts


def quality_row(spark: SparkSession, source: str, day: str, counts: dict, reason: str | None, state: str) -> DataFrame:
    row = [(source, day, counts["downloaded"], counts["valid"], counts["discarded"], reason, state)]
    return spark.createDataFrame(row, "fuente string, fecha_ingesta string, registros_descargados long, registros_validos long, registros_descartados long, motivo_descarte string, estado string")


def run_row(spark: SparkSession, source: str, status: str, counts: dict, started, finished, detail: str | None = None) -> DataFrame:
    """A row of the log of runs; written whether a run worked or not."""
    row = [(source, status, started, finished, counts.get("downloaded", 0), counts.get("valid", 0), counts.get("discarded", 0), detail)]
    return spark.createDataFrame(row, "source string, status string, run_started_at timestamp, run_finished_at timestamp, records_downloaded int, records_valid int, records_discarded int, detail string")


def chunked(df: DataFrame, path: str, rows: int) -> None:
    """Append in files of at most so many rows."""
    df.write.mode("append").option("maxRecordsPerFile", rows).parquet(path)


def in_parts(df: DataFrame, path: str, key: str, parts: int) -> int:
    """Append in so many commits of their own, by a hash of the key: what is written stays if a later one fails.  The rows
    are dealt out once, to a written table with a folder for each commit, which the commits read."""
    dealt = f"{scratch(df.sparkSession, 'parts')}/dealt"
    df.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts))).write.partitionBy("_part").parquet(dealt)
    written = df.sparkSession.read.schema(StructType([*df.schema.fields, StructField("_part", LongType())])).parquet(dealt)
    for i in range(parts):
        written.filter(F.col("_part") == i).select(*df.columns).write.mode("append").parquet(path)
    return parts


def turns(df: DataFrame, path: str) -> DataFrame:
    """Append turns of conversations (session_id, role, content, created_at) that aren't there yet, so that two layers
    that both write leave one row; a turn's id is a hash of it."""
    rows = conformed(df.withColumn("id", F.xxhash64("session_id", "role", "content", "created_at")), "agent_conversations").dropDuplicates(["id"])
    spark = df.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        rows = absent(rows, spark.read.parquet(path), ["id"])
    append(rows, path)
    return spark.read.parquet(path)


def document(df: DataFrame, path: str) -> None:
    """A table of one text column and few rows as one text file."""
    df.coalesce(1).write.mode("overwrite").text(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def covers(df: DataFrame, columns: list[str]) -> bool:
    """Whether a table has all of the columns."""
    return set(columns) <= set(df.columns)
