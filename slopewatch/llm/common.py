"""Tables in the shared folder, and Arrow helpers that every operator here uses."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []

#: Python workers give the memory of large arrays back when they are freed, instead of keeping it for the stages that follow.
MEMORY = {"MALLOC_MMAP_THRESHOLD_": str(1 << 22), "MALLOC_TRIM_THRESHOLD_": str(1 << 24), "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where it is unset and all runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="slopewatch-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


class Workspace:
    """Written tables of one run of an operator: lineage ends there, so a lost executor costs one task, not the job.

    ``keep`` writes the last table and deletes the others; what is left is deleted when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        for name, value in MEMORY.items():
            spark.sparkContext.environment.setdefault(name, value)
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
        self._fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.root = self._fs.makeQualified(folder).toString()
        self._n = 0
        atexit.register(self._end)

    def _end(self) -> None:
        with contextlib.suppress(Exception):  # the session may be gone
            self._fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root), True)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:02d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, keep: str = "") -> None:
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        if self._fs.exists(root):
            for status in self._fs.listStatus(root):
                if status.getPath().getName() != keep:
                    self._fs.delete(status.getPath(), True)

    def keep(self, df: DataFrame, name: str = "result") -> DataFrame:
        out = self.table(df, name)
        self.drop(keep=f"{self._n:02d}-{name}")
        return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.binary() if pa.types.is_string(column.type) or pa.types.is_binary(column.type) else pa.large_binary()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.binary() if kind == pa.binary() else pa.large_binary())
    width = np.int32 if kind == pa.binary() else np.int64
    buffers = column.buffers()
    at = np.frombuffer(buffers[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[: at[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, at


def runs(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes each; a longer row is alone."""
    first = 0
    for i in range(1, len(offsets)):
        if i == len(offsets) - 1 or offsets[i + 1] - offsets[first] > most:
            yield first, i
            first = i


def batch(schema: pa.Schema, **columns: Iterable) -> pa.RecordBatch:
    arrays = [x if isinstance(x, pa.Array) else pa.array(x, schema.field(k).type) for k, x in columns.items()]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def lists(values: pa.Array | np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def keyed(docs: DataFrame, id_column: str, text_column: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(_key long, _id, _text, and _0, _1, ... for the columns to carry): ``_key`` tells rows apart.

    It is the id itself where that is one row's alone.  Rows without an id or with a repeated one get a hash of id and
    text, so they count as documents of their own.
    """
    from pyspark.sql import functions as F

    slim = docs.select(F.col(id_column).cast("long").alias("_id"), F.col(text_column).cast("string").alias("_text"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(carry)])
    odd = slim.groupBy("_id").count().filter((F.col("count") > 1) | F.col("_id").isNull()).select("_id", F.lit(True).alias("_odd"))
    key = F.xxhash64(F.lit("a row by its id and text"), "_id", "_text")  # the hash of nulls alone is a small number
    if odd.isEmpty():
        return slim.select(F.col("_id").alias("_key"), *slim.columns)
    told = slim.join(odd.filter("_id is not null"), "_id", "left")
    return told.select(F.when(F.col("_id").isNull() | F.col("_odd"), key).otherwise(F.col("_id")).alias("_key"), *slim.columns)


def by_key(batches: Iterable[pa.RecordBatch], key: str, weight: str, most: int) -> Iterator[pa.Table]:
    """Cut a stream sorted by ``key`` into tables that hold whole keys and about ``most`` of ``weight``."""
    held, size = [], 0
    for part in batches:
        if not part.num_rows:
            continue
        if size >= most and held:
            keys = part.column(key).to_numpy(zero_copy_only=False)
            last = held[-1].column(key)[-1].as_py()
            other = np.flatnonzero(keys != last)
            cut = int(other[0]) if len(other) else part.num_rows
            if cut:
                held.append(part.slice(0, cut))
            if cut == part.num_rows:
                continue
            yield pa.Table.from_batches(held)
            held, size, part = [], 0, part.slice(cut)
        while part.num_rows:
            w = np.cumsum(part.column(weight).to_numpy(zero_copy_only=False))
            if size + w[-1] < most:
                held.append(part)
                size += int(w[-1])
                break
            keys = part.column(key).to_numpy(zero_copy_only=False)
            at = int(np.searchsorted(w, most - size))  # the row that fills the table; its key ends it
            new = np.flatnonzero(keys[at + 1 :] != keys[at : at + 1])
            if not len(new):
                held.append(part)
                size += int(w[-1])
                break
            cut = at + 1 + int(new[0])
            held.append(part.slice(0, cut))
            yield pa.Table.from_batches(held)
            held, size, part = [], 0, part.slice(cut)
    if held:
        yield pa.Table.from_batches(held)
