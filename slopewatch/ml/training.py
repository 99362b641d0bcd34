"""Risk classification with Spark ML: matrix, folds, candidates, choice, scoring.

Scaling is part of the pipeline, and classes are weighted, or resampled within a fold's training rows, so nothing of a
fold's test rows is seen in its training.
"""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.categories import model_category
from ..operators.stats import auc, class_weights, confusion
from ..schemas import DISTRICTS


def candidates(small: bool = False, rounds: int | None = None) -> dict:
    """Classifiers in order of preference at equal area under the curve; ``rounds`` is the number of boosted trees."""
    common = {"featuresCol": "scaled", "labelCol": "label", "weightCol": "weight"}
    return {
        "forest": RandomForestClassifier(numTrees=80 if small else 200, maxDepth=6, seed=42, **common),
        "boosted": GBTClassifier(maxIter=rounds or (60 if small else 120), maxDepth=3, stepSize=0.05, seed=42, **common),
        "logistic": LogisticRegression(maxIter=200, **common),
    }


def weighted(rows: DataFrame) -> DataFrame:
    """Adds balanced class weights."""
    return rows.join(F.broadcast(class_weights(rows, "label").select("label", "weight")), "label")  # one row for each class


def folds(rows: DataFrame, key: str, k: int = 5) -> DataFrame:
    """Adds a fold number, dealt out by a hash within each class."""
    w = Window.partitionBy("label", F.pmod(F.xxhash64(key), F.lit(64))).orderBy(F.xxhash64(key), key)
    return rows.withColumn("fold", F.pmod(F.row_number().over(w) + F.pmod(F.xxhash64(key), F.lit(64)), F.lit(k)).cast("int"))


def pipeline(features: list[str], classifier, impute: bool = False) -> Pipeline:
    """Features to the vector, centred and scaled (by the sample deviation, a constant factor from the population's)."""
    stages = [Imputer(strategy="median", inputCols=features, outputCols=features)] if impute else []
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=features, outputCol="vector", handleInvalid="keep"), StandardScaler(inputCol="vector", outputCol="scaled", withMean=True, withStd=True), classifier])


def fitted(pipe: Pipeline, rows: DataFrame) -> PipelineModel:
    """The fitted model without the summaries of its training, which hold on to the session and would be sent to every task
    with it."""
    model = pipe.fit(rows)
    for stage in model.stages:
        if getattr(stage, "hasSummary", False):
            stage._java_obj.setSummary(rows.sparkSession._jvm.scala.Option.empty())
    return model


#: Below so many rows, or rows of a class, rows are left out one by one.
FEW_ROWS, FEW_OF_A_CLASS = 50, 5


def split(rows: DataFrame, key: str, k: int = 5) -> tuple[DataFrame, int, bool]:
    """Rows with folds, their number, and whether areas must be taken over all folds together.

    A small table's rows are a fold each.  With a rare class in a larger table, the rows of that class are dealt out one
    to a fold and the others evenly: a fold for each row would be a fit for each.
    """
    sizes = [r["count"] for r in rows.groupBy("label").count().collect()]  # one for each class
    if sum(sizes) < FEW_ROWS:
        return rows.withColumn("fold", F.row_number().over(Window.orderBy(F.xxhash64(key), key)) - 1), sum(sizes), True
    if min(sizes) < FEW_OF_A_CLASS:
        return folds(rows, key, k), k, True
    return folds(rows, key, k), k, False


Resampling = Callable[[DataFrame], DataFrame]


def resampled(train: DataFrame, resample: Resampling | None) -> DataFrame:
    """Rows to train on: as they are, or resampled and of equal weight."""
    return train if resample is None else resample(train).withColumn("weight", F.lit(1.0))


#: Folds that are fitted beside each other: each is hundreds of short jobs, which leave most cores idle one by one.
BESIDE = 5


def beside(spark: SparkSession, tasks: list[Callable[[], float]]) -> list[float]:
    """Results of independent tasks, in their order."""
    with ThreadPool(min(BESIDE, len(tasks))) as pool:
        return pool.map(lambda task: task(), [inheritable_thread_target(spark)(t) for t in tasks])


def cross_validated(rows: DataFrame, features: list[str], classifier, k: int = 5, pooled: bool = False, resample: Resampling | None = None) -> float:
    """Mean area under the ROC curve over the folds; ``pooled``: the area over all rows, each scored by the model that
    hasn't seen it.  ``resample`` makes new rows from a fold's training rows only, so none is tested on."""
    if pooled:
        scores = None
        for i in range(k):
            train = rows.filter(F.col("fold") != i)
            if train.select("label").distinct().count() < 2:
                continue
            one = fitted(pipeline(features, classifier), resampled(train, resample)).transform(rows.filter(F.col("fold") == i)).select("label", vector_to_array("probability")[1].alias("raw"))
            scores = one if scores is None else scores.unionByName(one)
        found = None if scores is None else auc(scores, "label", "raw").first().auc
        return float("nan") if found is None else found

    def area(i: int) -> float:
        model = fitted(pipeline(features, classifier), resampled(rows.filter(F.col("fold") != i), resample))
        tested = model.transform(rows.filter(F.col("fold") == i)).select("label", vector_to_array("rawPrediction")[1].alias("raw"))
        found = auc(tested, "label", "raw").first().auc
        return float("nan") if found is None else found

    out = beside(rows.sparkSession, [lambda i=i: area(i) for i in range(k)])
    return sum(out) / len(out)


def choose(rows: DataFrame, features: list[str], key: str, names: list[str] | None = None, k: int = 5, resample: Resampling | None = None, rounds: int | None = None) -> tuple[str, dict[str, float], PipelineModel | None]:
    """The candidate with the best mean area (the first of equals) fitted on all rows; none for a single class.

    Rows without a label take no part.  Classes are weighted, or resampled by ``resample`` instead."""
    rows = rows.filter("label is not null")
    if rows.select("label").distinct().count() < 2:
        return "null", {}, None
    ready, k, pooled = split(weighted(rows), key, k)
    ready = ready.cache()
    small = ready.count() < 500
    found = {n: cross_validated(ready, features, c, k, pooled, resample) for n, c in candidates(small, rounds).items() if names is None or n in names}
    best = max(found, key=lambda n: found[n] if found[n] == found[n] else -1.0)  # the first of equals; a failed one last
    model = fitted(pipeline(features, candidates(small, rounds)[best]), resampled(ready, resample))
    ready.unpersist()
    return best, found, model


def save_artifacts(spark: SparkSession, folder: str, model: PipelineModel, features: list[str], metrics: dict, measures: DataFrame) -> None:
    """The model with its scaling, the names of its features, its metrics and its report, in one folder."""
    model.write().overwrite().save(f"{folder}/model")
    about = spark.createDataFrame([(features, {k: str(v) for k, v in metrics.items()})], "features array<string>, metrics map<string,string>")
    about.coalesce(1).write.mode("overwrite").json(f"{folder}/about")
    measures.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/report")


def load_artifacts(spark: SparkSession, folder: str) -> tuple[PipelineModel | None, list[str], dict[str, str]]:
    """What save_artifacts has left; no model, names or metrics where nothing is there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/about")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None, [], {}
    about = spark.read.schema("features array<string>, metrics map<string,string>").json(f"{folder}/about").first()
    return PipelineModel.load(f"{folder}/model"), about.features, about.metrics


def labelled(rows: DataFrame, future: str, past: str) -> tuple[DataFrame, str]:
    """Rows with their label and the name of the strategy: what follows, or what came before if nothing ever follows."""
    name, column = ("future_7d", future) if not rows.filter(F.col(future) == 1).isEmpty() else ("past_7d_fallback", past)
    return rows.withColumn("label", F.col(column)), name


def scored(model: PipelineModel | None, rows: DataFrame) -> DataFrame:
    """Probability of the class 1, confidence and category; a neutral 0.5 without a model."""
    if model is None:
        p = F.lit(0.5)
        return rows.withColumns({"risk_score": p, "confidence": p, "risk_category": model_category(p)})
    out = model.transform(rows).withColumn("_p", vector_to_array("probability"))
    return out.withColumns({"risk_score": F.col("_p")[1], "confidence": F.array_max("_p"), "risk_category": model_category(F.col("_p")[1])}).drop("_p", "vector", "scaled", "rawPrediction", "probability", "prediction")


def predictions(spark: SparkSession, model: PipelineModel | None, latest: DataFrame, features: list[str], version: str, now) -> DataFrame:
    """One prediction for each of the fixed districts; districts without features are scored with zeros."""
    ids = spark.createDataFrame([(d[0],) for d in DISTRICTS], "commune_id string")
    rows = ids.join(latest, "commune_id", "left").fillna(0.0, subset=features)
    return scored(model, rows).select("commune_id", "risk_score", "risk_category", F.lit(version).alias("model_version"), F.to_json(F.struct("confidence")).alias("raw_output"), now.alias("created_at"))


def report(scores: DataFrame, label: str = "label", score: str = "risk_score") -> DataFrame:
    """Area under the curve with the measures at 0.3 and 0.5."""
    return confusion(scores, label, score, [0.3, 0.5]).crossJoin(F.broadcast(auc(scores, label, score)))  # one row
