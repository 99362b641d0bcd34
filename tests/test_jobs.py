"""Jobs over several tables, counters in the writing job, feeds beside each other."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from slopewatch.operators import writes
from slopewatch.operators.jobs import Folder, Job
from slopewatch.streaming import ingest


def files(path):
    return {os.path.join(top, n): os.path.getmtime(os.path.join(top, n)) for top, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_a_job_is_seen_whole_or_not_at_all(spark, tmp_path):
    folder = Folder(spark, str(tmp_path / "t"))
    assert folder.read("a") is None
    with Job(folder, "one") as job:
        job.append("a", spark.range(3))
        assert folder.read("a") is None and job.read("a").count() == 3
        job.upsert("b", spark.range(5).withColumn("v", F.lit("old")), ["id"], 4)
    before = files(tmp_path)
    with pytest.raises(RuntimeError), Job(folder, "two") as job:
        job.append("a", spark.range(3, 6))
        job.upsert("b", spark.range(2).withColumn("v", F.lit("new")), ["id"])
        raise RuntimeError("broken off")
    assert files(tmp_path) == before and folder.read("a").count() == 3 and folder.read("b").filter("v = 'new'").count() == 0
    for _ in range(2):
        with Job(folder, "two") as job:
            job.append("a", spark.range(3, 6))
            job.upsert("b", spark.range(2).withColumn("v", F.lit("new")), ["id"])
    assert sorted(r.id for r in folder.read("a").collect()) == list(range(6))
    assert sorted((r.id, r.v) for r in folder.read("b").collect()) == [(0, "new"), (1, "new"), (2, "old"), (3, "old"), (4, "old")]
    assert len(folder.commits()) == 2
    with pytest.raises(ValueError), Job(folder, "three") as job:
        job.upsert("a", spark.range(1), ["id"])


def test_two_jobs_at_once_do_not_lose_each_other(spark, tmp_path):
    folder = Folder(spark, str(tmp_path))
    with pytest.raises(RuntimeError), Job(folder, "slow") as slow:
        slow.append("a", spark.range(1))
        with Job(folder, "quick") as quick:
            quick.append("a", spark.range(5))
    # the slow one finds the commit that it started from overtaken
    assert folder.read("a").count() == 5


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    folder = Folder(spark, str(tmp_path))
    rows = spark.range(1000).select(F.when(F.col("id") > 0, F.col("id")).alias("id"), F.lit("old").alias("v"))
    with Job(folder, "one") as job:
        job.upsert("t", rows, ["id"], 8)
    before = files(tmp_path)
    parts = dict(folder.state()["tables"]["t"]["parts"])
    new = spark.createDataFrame([(5, "new"), (None, "new"), (2000, "new")], "id long, v string")
    with Job(folder, "two") as job:
        job.upsert("t", new, ["id"])
    now = folder.state()["tables"]["t"]["parts"]
    same = [b for b in parts if parts[b] == now[b]]
    assert 8 - 3 <= len(same) < 8 and files(tmp_path).items() >= before.items()
    got = {r.id: r.v for r in folder.read("t").collect()}
    assert len(got) == 1001 and got[5] == got[None] == got[2000] == "new" and got[6] == "old"


def test_an_empty_upsert_changes_nothing(spark, tmp_path):
    folder = Folder(spark, str(tmp_path))
    with Job(folder, "one") as job:
        job.upsert("t", spark.range(3), ["id"])
    with Job(folder, "two") as job:
        job.upsert("t", spark.range(0), ["id"])
    assert folder.read("t").count() == 3


def test_counters_of_the_writing_job(spark, tmp_path):
    rows = spark.createDataFrame([(1.0,), (-1.0,), (None,)], "v double")
    plan = writes.counted(rows, F.col("v") >= 0)[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "CollectMetrics" in plan
    log = str(tmp_path / "log")
    counts = writes.logged(rows, F.col("v") >= 0, "rain", log, lambda df: writes.append(df, str(tmp_path / "t")))
    assert counts == {"downloaded": 3, "valid": 1, "discarded": 2} and spark.read.parquet(str(tmp_path / "t")).count() == 1
    with pytest.raises(ZeroDivisionError):
        writes.logged(rows, F.col("v") >= 0, "rain", log, lambda df: 1 / 0)
    got = {r.status: r for r in spark.read.parquet(log).collect()}
    assert (got["ok"].records_valid, got["ok"].detail, got["failed"].records_valid) == (1, None, 0) and "division" in got["failed"].detail


def test_commits_of_parts_read_the_input_once(spark, tmp_path):
    path = str(tmp_path / "t")
    seen = spark.sparkContext.accumulator(0)

    def touch(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    assert writes.in_parts(spark.range(100).mapInArrow(touch, "id long"), path, "id", 4) == 4
    assert seen.value == 100 and sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(100))
    assert writes.in_parts(spark.range(0), str(tmp_path / "none"), "id", 2) == 2


def test_batches_are_held_against_their_own_days(spark, tmp_path):
    path = str(tmp_path / "t")
    write = ingest.insert_if_absent(path, ["k", "day"], day="day")

    def batch(*rows):
        return spark.createDataFrame(list(rows), "k string, v int, day string").withColumn("day", F.col("day").cast("date"))

    write(batch(("a", 1, "2024-01-01"), ("a", 2, "2024-01-02"), ("n", 0, None)), 0)
    old = files(tmp_path)
    write(batch(("a", 9, "2024-01-02"), ("b", 3, "2024-01-02"), ("n", 9, None)), 1)
    write(batch(("a", 9, "2024-01-02"), ("b", 3, "2024-01-02")), 1)  # again
    got = sorted(((r.k, r.v, str(r.day)) for r in spark.read.parquet(path).collect()), key=str)
    assert got == [("a", 1, "2024-01-01"), ("a", 2, "2024-01-02"), ("b", 3, "2024-01-02"), ("n", 0, "None")]
    assert files(tmp_path).items() >= old.items()
    one = spark.read.parquet(path).filter(F.col("day").isin([r.day for r in batch(("x", 1, "2024-01-02")).collect()]))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan  # other days' folders aren't opened


def test_update_mode_replaces_a_frozen_day(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "k string, t timestamp, v double"

    def arrive(*rows):
        spark.createDataFrame([(k, t, v) for k, t, v in rows], "k string, t string, v double").withColumn("t", F.col("t").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)

    folder = Folder(spark, str(tmp_path / "tables"))

    def run():
        rows = ingest.daily(ingest.read_folder(spark, source, schema), "k", "t", "v")
        ingest.start(rows, "days", str(tmp_path / "c"), ingest.replace_days(folder, "days", ["k", "day"], "day", "r"), mode="update").awaitTermination()

    arrive(("a", "2024-01-01 10:00:00", 1.0), ("b", "2024-01-01 11:00:00", 5.0), ("a", "2024-01-02 10:00:00", 2.0))
    run()
    arrive(("a", "2024-01-01 23:00:00", 3.0))
    run()
    assert sorted((r.k, str(r.day), r.total, r.records) for r in folder.read("days").collect()) == [("a", "2024-01-01", 4.0, 2), ("a", "2024-01-02", 2.0, 1), ("b", "2024-01-01", 5.0, 1)]


def test_a_feed_that_keeps_failing_leaves_the_others_alone(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))

    def down(batch, number):
        raise RuntimeError("down for good")

    def feed(name, writer):
        return ingest.Feed(name, "sensors", spark.readStream.schema("id long").parquet(str(tmp_path / "in")), writer)

    began = time.monotonic()
    ended = ingest.run_feeds(spark, [feed("bad", down), feed("good", ingest.insert_if_absent(str(tmp_path / "out"), ["id"]))], str(tmp_path / "c"), str(tmp_path / "log"), attempts=2)
    assert ended == {"bad": False, "good": True} and time.monotonic() - began < 120
    log = spark.read.parquet(str(tmp_path / "log")).selectExpr("split(source, '-')[0] s", "status", "records_downloaded n", "detail").collect()
    assert sorted((r.s, r.status) for r in log) == [("bad", "failed"), ("bad", "failed"), ("good", "ok")]
    assert next(r.n for r in log if r.s == "good") == 10 and all("down for good" in r.detail for r in log if r.s == "bad")
    assert feed("x", down).interval == "1 hour"
