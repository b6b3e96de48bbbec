"""Whole queries as one lazy plan each: retrieve, compare, score, decide, publish."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import text as X
from kindred.functions.hashing import entity_key, pair_key
from kindred.operators import blocking, decide, features, index, metrics, model, ranking, retrieve, sampling
from kindred.plans import presets
from kindred.sources.store import stored
from kindred.sources.tsv import submission


def sides(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reference records and the records to be found, by `source`."""
    return records.filter("source = 'S1'"), records.filter("source <> 'S1'")


def candidates(records: DataFrame, config: presets.IndexConfig | None = None, places: int | None = None, secondary: bool = False) -> DataFrame:
    """All retrieved pairs by the source-side index. secondary: with tn2 and ta2, the targets' secondary texts."""
    queries, targets = sides(records)
    return retrieve.retrieved(stored(X.represented(queries)), index.materialised(index.build(targets, secondary)), config, places)


def rule_matches(records: DataFrame, threshold: float = 96.0, config: presets.LexicalConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """The lexical blocker with the rule: (all pairs with their score, those of at least the threshold)."""
    queries, targets = sides(records)
    scored = features.with_rule(blocking.lexical(X.represented(queries), X.represented(targets), config)).withColumn("score", F.col("exp001_rule_score"))
    return scored, scored.filter(F.col("score") >= threshold)


def featured(records: DataFrame, config: presets.IndexConfig | None = None) -> DataFrame:
    """Pass-eligible pairs, uncapped, with the 83 features."""
    queries, targets = sides(records)
    caps = dict.fromkeys(ranking.PASSES, 40) | {"char_name": 0}
    return features.with_all(ranking.eligible(candidates(records, config, secondary=True), caps), queries, targets)


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    t = metrics.links(truth).withColumn("label", F.lit(1))
    return pairs.join(t, ["s1", "target"], "left").fillna(0, ["label"])


def training(pairs: DataFrame, seed: int = 2031) -> DataFrame:
    """The sampled pairs that a matcher is fitted on."""
    p = pairs.withColumn("hardness", sampling.hardness(F.col("exp001_rule_score"), F.col("best_retrieval_score"))).withColumn("pair_key", pair_key(F.col("s1"), F.col("target"), seed))
    chosen = stored(sampling.training_pairs(stored(p.select("s1", "target", "label", "hardness", "pair_key"))))  # ids are ranked, not features
    return pairs.join(chosen.drop("label"), ["s1", "target"])


def split(records: DataFrame, truth: DataFrame, fraction: float = 0.25, seed: int = 2029) -> DataFrame:
    e = truth.select("s1", F.size("targets").alias("n_true")).join(records.select(F.col("entity_id").alias("s1"), "country"), "s1")
    return sampling.split(e.withColumn("key", entity_key(F.col("s1"), seed)), fraction)


def matched(records: DataFrame, fitted, policy: decide.Policy, config: presets.IndexConfig | None = None) -> dict[str, DataFrame]:
    """The final query: matches and candidates of every reference record, as output tables."""
    pairs = stored(featured(records, config))
    scored = decide.finite(model.scored(pairs, fitted))
    entities = sides(records)[0].select(F.col("entity_id").alias("s1"))
    return {"matching_results": submission(entities, decide.accepted(scored, policy)), "candidate_pairs": submission(entities, pairs.select("s1", "target"), "candidate_entity_ids")}


def experiment(records: DataFrame, truth: DataFrame, pipeline=None, names: tuple[str, ...] = features.ALL, config: presets.IndexConfig | None = None) -> dict:
    """Fit on one part of the records, tune thresholds on another, evaluate on the third: model, policy and metrics."""
    pairs = stored(labelled(featured(records, config), truth))
    held = split(records, truth, 0.3, 2028).filter("validation").select("s1")
    e = truth.select("s1", F.size("targets").alias("n_true")).join(records.select(F.col("entity_id").alias("s1"), "country"), "s1").withColumn("key", entity_key(F.col("s1"), 2029))
    parts = stored(sampling.partitions(e, held, 0.3).select("s1", "partition"))
    of = lambda df, p: df.join(parts.filter(F.col("partition") == p).select("s1"), "s1", "left_semi")
    fitted = model.fit(training(of(pairs, "fit")), pipeline or model.logistic(), names)
    best = decide.source_thresholds(model.scored(of(pairs, "tune"), fitted, names), of(truth, "tune")).first()
    policy = decide.Policy(best["s2"], best["s3"])
    final = decide.assessed(model.scored(of(pairs, "evaluation"), fitted, names), of(truth, "evaluation"), policy).first().asDict()
    return {"model": fitted, "policy": policy, "metrics": final}


def promotion(macro_fbeta: float) -> str:
    for least, name in ((0.95, "MAJOR"), (0.94, "PROMOTE"), (0.92, "REVIEW")):
        if macro_fbeta >= least:
            return name
    return "REJECT"
