"""Measures of classifications, and a trained one, in query form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ml import training as T
from ..ml.neighbours import nearest_rows, oversampled
from ..operators import stats
from ..session import table
from .registry import query

SCORES = "(SELECT toxic AS y, (doc_id * 37 % 101) / 101.0 * 0.7 + toxic * 0.2 AS s FROM labels)"


def scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select(F.col("toxic").alias("label"), (F.col("doc_id") * 37 % 101 / 101.0 * 0.7 + F.col("toxic") * 0.2).alias("risk_score"))


@query("class_counts", "SELECT toxic AS label, count(*) AS n FROM labels GROUP BY 1")
def class_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").groupBy(F.col("toxic").alias("label")).agg(F.count("*").alias("n"))


@query(
    "class_weights",
    """
SELECT toxic AS label, count(*) AS n, round((SELECT count(*)
FROM labels) / ((SELECT count(DISTINCT toxic)
FROM labels) * CAST(count(*) AS DOUBLE)), 6) AS weight
FROM labels
GROUP BY 1
""",
)
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return stats.class_weights(table(spark, d, "labels").select(F.col("toxic").alias("label")), "label")


CONFUSION = f"""
c AS (SELECT t AS threshold, count(*) FILTER (WHERE s >= t AND y = 1) AS tp, count(*) FILTER (WHERE s >= t AND y = 0) AS fp, count(*) FILTER (WHERE s < t AND y = 1) AS fn, count(*) FILTER (WHERE s < t AND y = 0) AS tn FROM {SCORES}, (VALUES (0.3::DOUBLE), (0.5::DOUBLE)) v(t) GROUP BY 1),
m AS (SELECT *, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0.0) AS p, coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0.0) AS r FROM c),
f AS (SELECT threshold, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0.0), 6) AS f1, round((tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE), 6) AS accuracy FROM m)
"""
AUC = f"a AS (SELECT round(sum(CASE WHEN p.s > q.s THEN 1.0 WHEN p.s = q.s THEN 0.5 ELSE 0.0 END) / count(*), 6)::DOUBLE AS auc FROM (SELECT s FROM {SCORES} WHERE y = 1) p, (SELECT s FROM {SCORES} WHERE y = 0) q)"


@query("confusion_metrics", f"WITH {CONFUSION} SELECT * FROM f")
def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    return stats.confusion(scores(spark, d), "label", "risk_score", [0.3, 0.5])


@query(
    "auc_rank",
    f"""
WITH {AUC} SELECT auc, (SELECT count(*)
FROM labels
WHERE toxic = 1) AS positives, (SELECT count(*)
FROM labels
WHERE toxic = 0) AS negatives
FROM a
""",
)
def auc_rank(spark: SparkSession, d: str) -> DataFrame:
    return stats.auc(scores(spark, d), "label", "risk_score")


@query(
    "model_report",
    f"""
WITH {CONFUSION}, {AUC} SELECT f.*, auc, (SELECT count(*)
FROM labels
WHERE toxic = 1) AS positives, (SELECT count(*)
FROM labels
WHERE toxic = 0) AS negatives
FROM f, a
""",
)
def model_report(spark: SparkSession, d: str) -> DataFrame:
    return T.report(scores(spark, d))


RARE = 4  # components that count


@query(
    "rare_neighbours",
    """
WITH r AS (SELECT vec_id, CAST(embedding[1:4] AS DOUBLE[]) AS v FROM embeddings WHERE label = 3),
p AS (SELECT a.vec_id, b.vec_id AS other, sqrt((b.v[1] - a.v[1]) ** 2 + (b.v[2] - a.v[2]) ** 2 + (b.v[3] - a.v[3]) ** 2 + (b.v[4] - a.v[4]) ** 2) AS d FROM r a JOIN r b ON a.vec_id <> b.vec_id)
SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY d, other) AS INTEGER) AS rank, other, round(d, 9) AS distance FROM p QUALIFY rank <= 5
""",
)
def rare_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest rows of each row of one class."""
    rows = table(spark, d, "embeddings").filter("label = 3").select("vec_id", *[F.col("embedding")[i].alias(f"f{i}") for i in range(RARE)])
    return nearest_rows(rows, [f"f{i}" for i in range(RARE)], "vec_id").withColumn("distance", F.round("distance", 9))


@query("oversampled_classes", "SELECT y AS label, (SELECT count(*) FROM embeddings WHERE label <> 3) AS n, 0::BIGINT AS outside FROM (VALUES (0), (1)) v(y)")
def oversampled_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes made equal by new rows; none of these lies outside the range of the rare rows."""
    features = [f"f{i}" for i in range(RARE)]
    rows = table(spark, d, "embeddings").select("vec_id", (F.col("label") == 3).cast("int").alias("label"), *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(features)])
    bounds = rows.filter("label = 1").agg(*[g(f).alias(f"{n}_{f}") for f in features for n, g in (("lo", F.min), ("hi", F.max))])  # one row
    out = F.lit(False)
    for f in features:
        out = out | ~F.col(f).between(F.col(f"lo_{f}") - 1e-12, F.col(f"hi_{f}") + 1e-12)
    made = oversampled(rows, features, "vec_id").crossJoin(F.broadcast(bounds))
    return made.groupBy("label").agg(F.count("*").alias("n"), F.count_if(out & (F.col("label") == 1)).alias("outside"))


@query("fold_sizes", "SELECT toxic AS label, CAST(count(*) AS BIGINT) AS n, true AS even FROM labels GROUP BY 1")
def fold_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Folds by class: each class is dealt out to all folds, evenly but for chance."""
    rows = T.folds(table(spark, d, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id")
    sizes = rows.groupBy("label", "fold").agg(F.count("*").alias("size"))
    return sizes.groupBy("label").agg(F.sum("size").alias("n"), (F.max("size") - F.min("size") <= 64).alias("even")  # a row more or less from each of the 64 buckets of keys
    )


@query("train_predict")
def train_predict(spark: SparkSession, d: str) -> DataFrame:
    """The better of a forest and a logistic model on vectors by five folds, and the scores of all rows."""
    vectors = table(spark, d, "embeddings")
    features = [f"f{i}" for i in range(len(vectors.select("embedding").first().embedding))]
    rows = vectors.select("vec_id", (F.col("label") < 3).cast("int").alias("label"), *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(features)])
    _, _, model = T.choose(rows, features, "vec_id", ["forest", "logistic"])
    return T.scored(model, rows).select("vec_id", "label", F.round("risk_score", 4).alias("risk_score"), "risk_category")


@query("train_boosted")
def train_boosted(spark: SparkSession, d: str) -> DataFrame:
    """Boosted trees on a rare class, with rows made between neighbours in each fold's training rows, and the scores of all
    rows.  Few rounds: each is a job of its own."""
    features = [f"f{i}" for i in range(RARE)]
    rows = table(spark, d, "embeddings").select("vec_id", (F.col("label") == 3).cast("int").alias("label"), *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(features)])
    _, _, model = T.choose(rows, features, "vec_id", ["boosted"], k=2, resample=lambda train: oversampled(train, features, "vec_id"), rounds=5)
    return T.scored(model, rows).select("vec_id", "label", F.round("risk_score", 4).alias("risk_score"), "risk_category")
