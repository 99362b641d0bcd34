"""Jobs over several tables that are seen whole or not at all.

A job writes its rows to new folders and then one small file, the commit, that says which folders each table consists of.
Readers go by the newest commit, so until it is there they see the old state of all tables, and nothing of a job that breaks
off.  A job has a name; one whose name is committed already isn't done again, so a job can always be started once more.

Tables that are upserted are dealt out to buckets by a hash of the key, or by a day or number that is part of the key.  Only
the buckets that a job has rows for are read and written anew; the files of the others stay as they are.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .writes import absent


class Folder:
    """A folder of tables and their commits."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("_commits").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def commits(self) -> list[str]:
        commits = self._at("_commits")
        if not self._fs.exists(commits):
            return []
        return sorted(n for s in self._fs.listStatus(commits) if (n := s.getPath().getName()).endswith(".json"))

    def state(self) -> dict:
        """The newest commit: the names of the jobs done, and for each table its buckets and their folders."""
        found = self.commits()
        if not found:
            return {"number": 0, "jobs": [], "tables": {}}
        return json.loads(self.spark.read.text(f"{self.path}/_commits/{found[-1]}", wholetext=True).first().value)

    def publish(self, state: dict) -> None:
        """Write the file beside its place, then move it there: it is there as a whole or not at all."""
        name = f"{state['number']:08d}"
        new, place = self._at(f"_commits/.{name}-{uuid.uuid4().hex}"), self._at(f"_commits/{name}.json")
        out = self._fs.create(new, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self._fs.exists(place) or not self._fs.rename(new, place):
            self._fs.delete(new, False)
            raise RuntimeError(f"another job has committed {place}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def read(self, table: str) -> DataFrame | None:
        """A table as the newest commit has it; None if it isn't there."""
        return self.rows(self.state()["tables"].get(table))

    def buckets(self, path: str) -> list[str]:
        """The buckets that a written folder has."""
        return sorted(n.removeprefix("_bucket=") for s in self._fs.listStatus(self._at(path)) if (n := s.getPath().getName()).startswith("_bucket="))

    def rows(self, known: dict | None) -> DataFrame | None:
        """The rows of a table of a state; None if there are none."""
        paths = [f"{self.path}/{p}" for own in (known or {"parts": {}})["parts"].values() for p in own]
        return self.spark.read.schema(_schema(known)).parquet(*paths) if paths else None


class Job:
    """``with Job(folder, name) as job:`` appends to, replaces and upserts tables; all of it is committed at the end, or, if
    anything fails, deleted.  ``job.done`` says that a job of this name is committed already; its writes do nothing."""

    def __init__(self, folder: Folder, name: str):
        self.folder, self.name = folder, name

    def __enter__(self) -> Job:
        self.state = self.folder.state()
        self.done = self.name in self.state["jobs"]
        self.written: list[str] = []
        return self

    def __exit__(self, kind, error, trace) -> None:
        try:
            if kind is None and not self.done:
                self.folder.publish({**self.state, "number": self.state["number"] + 1, "jobs": [*self.state["jobs"], self.name]})
                self.written = []
        finally:
            for path in self.written:  # of a job that has failed, or that another one has overtaken
                self.folder.delete(path)

    def _write(self, table: str, rows: DataFrame) -> str:
        path = f"{table}/{self.name}-{uuid.uuid4().hex[:8]}"
        self.written.append(path)
        rows.write.parquet(f"{self.folder.path}/{path}")
        return path

    def read(self, table: str) -> DataFrame | None:
        """A table as it is with what this job has written so far."""
        return self.folder.rows(self.state["tables"].get(table))

    def _table(self, table: str, rows: DataFrame, buckets: int | str) -> dict:
        return self.state["tables"].setdefault(table, {"schema": rows.schema.json(), "buckets": buckets, "parts": {}})

    def append(self, table: str, rows: DataFrame) -> None:
        if not self.done:
            known = self._table(table, rows, 0)
            known["parts"].setdefault("all", []).append(self._write(table, rows.select(*_schema(known).names)))

    def replace(self, table: str, rows: DataFrame) -> None:
        if not self.done:
            self.state["tables"].pop(table, None)
            self.append(table, rows)

    def upsert(self, table: str, rows: DataFrame, keys: list[str], by: str | int = 16) -> None:
        """Rows of the table whose key isn't in ``rows``, and all of ``rows``; nulls in keys are equal.

        ``by`` holds for a new table: how many buckets it has, or a column of the key, a day or a whole number, whose values
        are its buckets.  The new rows are written first, which shows the buckets that they fall into; then what stays of
        these buckets is written beside them.
        """
        if self.done:
            return
        known = self._table(table, rows, by)
        by = known["buckets"]
        if not by:
            raise ValueError(f"{table} has no buckets: it was made by appending")
        bucket = F.coalesce(F.col(by).cast("string"), F.lit("none")) if isinstance(by, str) else F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(by)).cast("string")
        path = f"{table}/{self.name}-{uuid.uuid4().hex[:8]}"
        self.written.append(path)

        def write(some: DataFrame) -> None:
            some.withColumn("_bucket", bucket).repartition("_bucket").write.mode("append").partitionBy("_bucket").parquet(f"{self.folder.path}/{path}")

        write(rows.select(*_schema(known).names))
        touched = {b: [f"{path}/_bucket={b}"] for b in self.folder.buckets(path)}
        old, new = (self.folder.rows({**known, "parts": parts}) for parts in ({b: own for b, own in known["parts"].items() if b in touched}, touched))
        if old is not None:
            write(absent(old, new.select(*keys), keys))
        known["parts"] |= touched


def _schema(known: dict) -> StructType:
    return StructType.fromJson(json.loads(known["schema"]))
