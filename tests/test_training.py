"""Cross-validation: folds beside each other, with the areas of folds one by one."""

from __future__ import annotations

import random
import threading

from pyspark.ml.classification import LogisticRegression

from slopewatch.ml import training


def test_folds_are_fitted_beside_each_other(spark, monkeypatch):
    rng = random.Random(2)
    rows = training.weighted(spark.createDataFrame([(i, int(rng.random() < 0.4 + 0.2 * (i % 2)), float(i % 2), rng.random()) for i in range(120)], "id long, label int, f0 double, f1 double"))
    rows = training.folds(rows, "id", 3).cache()
    one = LogisticRegression(maxIter=5, featuresCol="scaled", labelCol="label", weightCol="weight")
    monkeypatch.setattr(training, "BESIDE", 1)
    want = training.cross_validated(rows, ["f0", "f1"], one, 3)
    met, fit = threading.Barrier(3, timeout=60), training.fitted

    def fitted(pipe, train):
        met.wait()  # broken if a fold waits for the one before
        return fit(pipe, train)

    monkeypatch.setattr(training, "BESIDE", 3)
    monkeypatch.setattr(training, "fitted", fitted)
    assert training.cross_validated(rows, ["f0", "f1"], one, 3) == want
    assert 0.4 < want < 0.9
