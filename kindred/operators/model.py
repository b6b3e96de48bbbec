"""Matchers on MLlib: balanced logistic regression and gradient-boosted trees, out-of-fold scores, and bundles with checks."""

from __future__ import annotations

import hashlib
import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators.features import ALL, vectors
from kindred.sources.store import stored


def balanced(labelled: DataFrame) -> DataFrame:
    """labelled with `weight`: n / (2 * n of the row's label)."""
    n = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}  # two rows
    total = sum(n.values())
    w = F.lit(1.0)
    for label, k in n.items():
        w = F.when(F.col("label") == label, F.lit(total / (2.0 * k))).otherwise(w)
    return labelled.withColumn("weight", w).withColumn("label", F.col("label").cast("double"))


def logistic(regularisation: float = 1e-4) -> Pipeline:
    return Pipeline(stages=[StandardScaler(inputCol="features", outputCol="scaled", withMean=True), LogisticRegression(featuresCol="scaled", weightCol="weight", regParam=regularisation, standardization=False, maxIter=300)])


def boosted(seed: int = 2030, rounds: int = 160, depth: int = 5) -> Pipeline:
    return Pipeline(stages=[GBTClassifier(featuresCol="features", weightCol="weight", stepSize=0.08, maxIter=rounds, maxDepth=depth, minInstancesPerNode=30, maxBins=256, seed=seed)])


#: Values (rows times features) that a task of a fit goes over in each of its rounds.
CELLS = 4_000_000


def fit(pairs: DataFrame, pipeline: Pipeline, names: tuple[str, ...] = ALL) -> PipelineModel:
    """pairs: features by name and label. A fit reads its rows some hundred times: they are stored as vectors first, and come in as few tasks as CELLS allows, for a round over small tasks is all overhead. The training summaries are dropped: they hold the session, which can't travel to tasks once it has observed a query."""
    rows = stored(vectors(pairs, names).select("label", "features"))
    fitted = pipeline.fit(balanced(rows).coalesce(max(1, -(-rows.count() * len(names) // CELLS))))
    for stage in fitted.stages:
        if getattr(stage, "hasSummary", False):
            stage._java_obj.setSummary(stage._java_obj.getClass().getClassLoader().loadClass("scala.None$").getField("MODULE$").get(None))
    return fitted


def scored(pairs: DataFrame, model: PipelineModel, names: tuple[str, ...] = ALL) -> DataFrame:
    """pairs with `score`, the probability of a match."""
    out = model.transform(vectors(pairs, names)).withColumn("score", vector_to_array("probability")[1])
    return out.drop(*[c for c in ("features", "scaled", "rawPrediction", "probability", "prediction") if c in out.columns])


def out_of_fold(pairs: DataFrame, pipeline: Pipeline, names: tuple[str, ...] = ALL) -> DataFrame:
    """pairs (with `fold` 0 or 1, the same for all of a record) with the score of the model that the other fold fitted."""
    a, b = (scored(pairs.filter(F.col("fold") == k), fit(pairs.filter(F.col("fold") != k), pipeline, names), names) for k in (0, 1))
    return a.unionByName(b)


def importance(model: PipelineModel, names: tuple[str, ...] = ALL) -> dict[str, float]:
    """Coefficients' sizes or the trees' importances, largest first."""
    last = model.stages[-1]
    values = [abs(x) for x in last.coefficients] if hasattr(last, "coefficients") else list(last.featureImportances.toArray())
    return dict(sorted(zip(names, map(float, values), strict=True), key=lambda x: (-x[1], x[0])))


def save(model: PipelineModel, path: str, policy: dict, names: tuple[str, ...] = ALL) -> str:
    """The model, then its manifest; returns the manifest's digest."""
    model.write().overwrite().save(f"{path}/model")
    body = json.dumps({"features": list(names), "policy": policy}, sort_keys=True)
    spark = SparkSession.active()
    spark.createDataFrame([(body,)], "manifest string").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return hashlib.sha256(body.encode()).hexdigest()


def load(spark, path: str, names: tuple[str, ...] = ALL, expect: str | None = None) -> tuple[PipelineModel, dict]:
    """The model and its policy; another feature order or digest is an error."""
    body = spark.read.parquet(f"{path}/manifest").first()[0]
    manifest = json.loads(body)
    if manifest["features"] != list(names) or (expect and hashlib.sha256(body.encode()).hexdigest() != expect):
        raise ValueError("the stored model does not fit")
    return PipelineModel.load(f"{path}/model"), manifest["policy"]
