"""A frozen bundle: models, policy, features and configuration, each file's digest in a manifest that is checked on loading."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators import features
from kindred.plans import presets
from kindred.sources import shards
from kindred.sources.tsv import DataError


def model_digest(spark: SparkSession, path: str) -> str:
    """Of all files of a stored model by their names and bytes, however deep they lie; names that a writer makes up are left out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter(~F.col("path").rlike(r"(^|/)[._][^/]*$"))
    parts = rows.select(F.regexp_replace(F.col("path"), r"part-(\d+)-[^/]*", "part-$1").alias("p"), F.sha2("content", 256).alias("h")).collect()  # a model has some dozens of files
    prefix = path.split("://")[-1].split(":")[-1]
    return hashlib.sha256(json.dumps(sorted((r["p"].split(prefix)[-1], r["h"]) for r in parts)).encode()).hexdigest()


def freeze(spark: SparkSession, models: dict[str, PipelineModel], row: dict, tried: list[dict], path: str, identity: str, config: presets.IndexConfig) -> dict:
    """Writes the models and then the manifest; never over another bundle."""
    if shards.exists(spark, f"{path}/freeze.json"):
        raise DataError(f"{path} holds a bundle already")
    for name, m in models.items():
        m.write().overwrite().save(f"{path}/models/{name}")
    body = {
        "models": {name: model_digest(spark, f"{path}/models/{name}") for name in models}, "policy": row, "tried": tried, "identity": identity, "config": asdict(config),
        "features": list(features.ALL), "code": shards.code_digest(), "packages": shards.packages(), "evaluated": False,
    }
    text = json.dumps(body, sort_keys=True)
    shards.write_text(spark, f"{path}/freeze.json", json.dumps({"digest": hashlib.sha256(text.encode()).hexdigest(), "bundle": body}, sort_keys=True))
    return body


def load(spark: SparkSession, path: str, identity: str | None = None) -> tuple[dict[str, PipelineModel], dict]:
    """The models and the bundle; a changed file, policy, feature order, code, package or identity is an error."""
    stored = json.loads(shards.read_text(spark, f"{path}/freeze.json"))
    body = stored["bundle"]
    shards.require({"digest": hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()}, {"digest": stored["digest"]}, path)
    expected = {"features": list(features.ALL), "code": shards.code_digest(), "packages": shards.packages(), "evaluated": False}
    shards.require(body, expected | ({"identity": identity} if identity else {}), path)
    shards.require({name: model_digest(spark, f"{path}/models/{name}") for name in body["models"]}, body["models"], f"{path}/models")
    return {name: PipelineModel.load(f"{path}/models/{name}") for name in body["models"]}, body


def matches(spark: SparkSession, path: str, pairs: DataFrame, identity: str | None = None) -> DataFrame:
    """(s1, target, score) that a bundle's models and policy accept of featured pairs."""
    from kindred.plans import policy

    models, body = load(spark, path, identity)
    return policy.decided(policy.variants(pairs, models), body["policy"])
