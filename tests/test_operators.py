"""Operators on small tables with ties, nulls and empty inputs."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from slopewatch.operators import calendar, intervals, latest, rolling, spatial, stats, writes

D = datetime.date


def test_latest(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, 6.0), (1, 2, 7.0), (2, 1, None)], "k int, t int, v double")
    assert latest.latest_with_ties(df, "k", "t").count() == 3
    assert sorted(r.v or 0 for r in latest.latest_one(df, "k", ["t", "v"]).collect()) == [0, 7.0]
    assert latest.latest_one(df.limit(0), "k", ["t"]).count() == 0
    assert [r.k for r in latest.top_groups(df, "k", 1).collect()] == [1]
    assert latest.last_known(df, "k", ["t"], "v").count() == 1


@pytest.mark.parametrize("buckets", [None, "b"])
def test_rolling(spark, buckets):
    rows = [("a", i, float(i), i // 3) for i in range(10)] + [("b", 0, 1.0, 0), ("b", 5, 2.0, 9), ("b", 6, 4.0, 30)]
    df = spark.createDataFrame(rows, "k string, t int, v double, b int")
    got = rolling.rolling_sums(df, "k", ["t"], "v", {"s3": 3, "s7": 7}, bucket=F.col("b") if buckets else None)
    found = {(r.k, r.t): (r.s3, r.s7) for r in got.collect()}
    for k in ("a", "b"):
        own = [(t, v) for q, t, v, _ in rows if q == k]
        for i, (t, _) in enumerate(own):
            assert found[k, t] == (sum(v for _, v in own[max(0, i - 2) : i + 1]), sum(v for _, v in own[max(0, i - 6) : i + 1]))
    assert len(found) == 13 and got.columns[:4] == ["k", "t", "v", "b"]


def test_intervals(spark):
    left = spark.createDataFrame([("a", D(2024, 1, n)) for n in (1, 2, 3, 9, 10, 17, 18)], "k string, day date")
    events = spark.createDataFrame([("a", D(2024, 1, 10)), ("a", D(2024, 1, 10)), ("b", D(2024, 1, 2)), (None, None)], "k string, hit date")
    after = {r.day.day: r.label for r in intervals.happens_after(left, events, "k", "day", "hit").collect()}
    assert after == {1: 0, 2: 0, 3: 1, 9: 1, 10: 0, 17: 0, 18: 0}
    before = {r.day.day: r.label for r in intervals.happened_before(left, events, "k", "day", "hit").collect()}
    assert before == {1: 0, 2: 0, 3: 0, 9: 0, 10: 1, 17: 1, 18: 0}


def test_calendar(spark):
    df = spark.createDataFrame([("a", D(2024, 1, 2), 3)], "k string, day date, n int")
    rows = calendar.dense(df, df, "k", "day", "2024-01-01", "2024-01-03", {"n": 0}).orderBy("day").collect()
    assert [r.n for r in rows] == [0, 3, 0]


def test_statistics(spark):
    rows = [("a", float(i), float(i * i)) for i in range(12)] + [("b", 1.0, float(i)) for i in range(12)] + [("c", 1.0, 2.0)]
    got = {r.k: r.rho for r in stats.spearman(spark.createDataFrame(rows, "k string, x double, y double"), "k", "x", "y").collect()}
    assert got == {"a": 1.0, "b": None, "c": None}
    one = stats.normalised(spark.createDataFrame([(1.0, None), (3.0, 2.0)], "x double, y double"), {"x": "nx", "y": "ny"}).orderBy("x").collect()
    assert [(r.nx, r.ny) for r in one] == [(0.0, None), (1.0, 0.5)]
    s = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.4), (0, 0.4)], "y int, s double")
    assert stats.auc(s, "y", "s").first().auc == 0.875
    c = {r.threshold: (r.tp, r.fp, r.fn, r.tn) for r in stats.confusion(s, "y", "s", [0.3, 0.5]).collect()}
    assert c == {0.3: (2, 1, 0, 1), 0.5: (1, 0, 1, 2)}
    assert stats.confusion(s.filter("y = 0"), "y", "s", [0.95]).first().precision == 0.0


def test_writes(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    new = spark.createDataFrame([(2, None), (3, "c"), (3, "d"), (None, "n")], "k int, v string")
    assert sorted((r.k or 0, r.v) for r in writes.absent(new, old, ["k"]).collect()) == [(0, "n"), (3, "c"), (3, "d")]
    assert writes.absent(new, old, ["k"], ["v"]).count() == 3
    assert writes.upserted(old, new, ["k"]).count() == 5
    path = str(tmp_path / "t")
    writes.append(old, path, files=1)
    writes.rewrite(spark, spark.createDataFrame([(2, "z")], "k int, v string"), path, ["k"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "z")]
    writes.replace(old, path)
    assert spark.read.parquet(path).count() == 2
    rows, seen = writes.counted(spark.createDataFrame([(1.0,), (-1.0,), (None,)], "v double"), F.col("v") >= 0)
    assert rows.count() == 1
    counts = seen.get
    assert counts == {"downloaded": 3, "valid": 1, "discarded": 2}
    assert writes.quality_row(spark, "rain", "2024-01-01", counts, None, "ok").first().registros_validos == 1
    assert writes.null_not_finite(spark.createDataFrame([(float("nan"), 1)], "x double, n int")).first().x is None


def test_spatial(spark):
    ring = [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0], [0.0, 0.0]]
    polygons = spark.createDataFrame([("b", ring), ("a", ring)], "name string, ring array<array<double>>")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 1.0), (3, None, 1.0)], "id int, lon double, lat double")
    got = {r.id: r.name for r in spatial.locate(points, polygons, "lon", "lat", "ring", "name", 0.5, "id").collect()}
    assert got == {1: "a", 2: None, 3: None}
