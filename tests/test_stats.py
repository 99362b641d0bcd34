"""Ranks, neighbours and rows made between them against plain Python."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from slopewatch.ml import training as T
from slopewatch.ml.neighbours import nearest_rows, oversampled
from slopewatch.operators import stats


def test_ranks(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.gauss(0, 1), float(rng.randrange(5)), 1e300, -1e300, float("inf"), float("-inf"), float("nan"), None])) for _ in range(600)] + [("one", 2.0), ("same", 3.0), ("same", 3.0), ("none", None)]
    for buckets in (4096, 3):
        got = {(r.k, str(r.v)): r["rank"] for r in stats.ranks(spark.createDataFrame(rows, "k string, v double"), "k", "v", buckets).collect()}
        want = {}
        for key in {k for k, _ in rows}:
            order = sorted((v for k, v in rows if k == key and v is not None), key=lambda v: (math.isnan(v), 0 if math.isnan(v) else v))
            for v in order:
                at = [i + 1 for i, x in enumerate(order) if str(x) == str(v)]
                want[key, str(v)] = sum(at) / len(at)
        assert got == want


def test_no_task_ranks_a_whole_key(spark):
    plan = stats.ranks(spark.range(10).selectExpr("1 k", "double(id) v"), "k", "v")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2 and sum("_part" in w.split("windowspecdefinition(")[1].split("ASC")[0] for w in windows) == 2


def test_spearman(spark):
    rows = [("a", float(i), float(i * i)) for i in range(20)] + [("b", float(i), float(-i // 2)) for i in range(20)] + [("c", 1.0, float(i)) for i in range(20)] + [("d", 1.0, 2.0)] + [("a", None, 1.0)] + [(None, float(i), float(i)) for i in range(12)]
    got = {r.k: (r.n, r.rho) for r in stats.spearman(spark.createDataFrame(rows, "k string, x double, y double"), "k", "x", "y").collect()}
    assert got["a"] == (20, 1.0) and got["c"] == (20, None) and got["d"] == (1, None) and got[None] == (12, 1.0)
    assert got["b"][0] == 20 and -1 < got["b"][1] < -0.99


def test_nearest_rows(spark):
    rng = random.Random(2)
    rows = [(i, float(rng.randrange(6)), rng.gauss(0, 1e6 if i == 3 else 1)) for i in range(120)] + [(500, None, 1.0), (None, 1.0, 1.0), (501, float("nan"), 0.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    for block in (4096, 25):
        got = sorted((r.id, r["rank"], r.other) for r in nearest_rows(df, ["a", "b"], "id", 4, block).collect())
        known = [r for r in rows if r[0] is not None and r[0] < 500]
        want = [(i, n + 1, j) for i, a, b in known for n, (_, j) in enumerate(sorted((math.sqrt((x - a) ** 2 + (y - b) ** 2), j) for j, x, y in known if j != i)[:4])]
        assert got == sorted(want)
    assert nearest_rows(df.limit(0), ["a"], "id").count() == 0 and nearest_rows(df.filter("id = 1"), ["a"], "id").count() == 0


def test_rows_between_neighbours(spark):
    rng = random.Random(3)
    rows = [(i, int(i < 17), rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, label int, a double, b double")
    made = oversampled(df, ["a", "b"], "id", k=3)
    assert {r.label: r["count"] for r in made.groupBy("label").count().collect()} == {0: 83, 1: 83}
    near = {}
    for r in nearest_rows(df.filter("label = 1"), ["a", "b"], "id", 3).collect():
        near.setdefault(r.id, []).append(r.other)
    at = {i: (a, b) for i, _, a, b in rows}
    new = [r for r in made.collect() if "+" in r.id]
    assert len(new) == 66 and len({r.id for r in new}) == 66
    for r in new:  # on the way to one of the three nearest
        base = int(r.id.split("+")[0])
        a, b = at[base]
        ways = [((r.a - a) / (x - a), (r.b - b) / (y - b)) for x, y in (at[o] for o in near[base])]
        assert any(abs(u - v) < 1e-6 and -1e-9 <= u < 1 for u, v in ways)
    assert sorted(map(tuple, oversampled(df, ["a", "b"], "id", k=3).collect())) == sorted(map(tuple, made.collect()))
    assert oversampled(df, ["a"], "id", more=5).count() == 105 and oversampled(df.filter("label = 0"), ["a"], "id").count() == 83
    one = oversampled(df.filter("label = 0 or id = 3"), ["a"], "id")
    assert one.filter("label = 1").select("a").distinct().count() == 1 and one.count() == 166


def test_resampling_stays_within_the_folds(spark):
    rows = spark.range(300).select(F.col("id"), (F.col("id") % 10 == 0).cast("int").alias("label"), ((F.col("id") % 10 == 0).cast("double") + F.rand(3)).alias("f0"), F.rand(4).alias("f1"))
    seen = []

    def resample(train):
        seen.append(train.count())
        return oversampled(train, ["f0", "f1"], "id")

    unlabelled = rows.unionByName(spark.range(900, 950).select("id", F.lit(None).cast("int").alias("label"), F.lit(0.0).alias("f0"), F.lit(0.0).alias("f1")))
    best, found, model = T.choose(unlabelled, ["f0", "f1"], "id", ["logistic"], k=3, resample=resample)
    assert found["logistic"] > 0.9 and len(seen) == 4 and max(seen[:3]) < 300 and seen[3] == 300
    assert T.scored(model, rows).filter("risk_score > 0.5 and label = 1").count() > 25
