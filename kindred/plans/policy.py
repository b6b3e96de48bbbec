"""Second-stage models over a matcher's scores, and the choice of the policy that turns scores into matches.

A base matcher scores pairs. Out-of-fold scores of the fitting records (two halves by entity key, each scored by the model
of the other) give what the second stage learns from: a guardian says whether a record has any match, and two pair models
score again by a record's own ranking, without (`relative`) and with (`cross`) the likeness of candidates across sources.
All tables hold one row a pair or a record; nothing but fitted parameters and a dozen rows of policies reaches the driver.
"""

from __future__ import annotations

from dataclasses import asdict, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.hashing import entity_key
from kindred.operators import decide, features, metrics, model, sampling
from kindred.sources.store import stored

#: The inputs of the guardian, and of the two pair models in their order; `cross` has five more.
ENTITY = (
    "top second third candidate_count above_50 above_80 above_95 best_s2 best_s3 s2_margin s3_margin top_retrieval top_pass_count top_exact_name "
    "top_core_name top_address top_numeric_conflict top_is_s3 cross_name_agreement top_second second_third both_sources_strong"
).split()
RELATIVE = "score rank source_rank top second third top_second second_third minus_top above_50 above_80 above_95 strong_s2 strong_s3 source_top_margin".split()
CROSS = [*RELATIVE, "cross_name", "cross_core", "cross_address", "cross_numeric_agreement", "cross_numeric_conflict"]
#: The penalties on clashing numbers that are tried; the names in tune() are fixed too.
PENALTIES = (0.01, 0.03, 0.05)
SEED = 2031


def decision_tables(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row a record with ENTITY, a row a pair with CROSS) of scored pairs that have the 83 features and both sides' texts."""
    entity, pair = decide.decision_features(scored.join(decide.cross_evidence(scored), ["s1", "target"], "left"))
    return stored(entity), stored(pair)


def fit(pairs: DataFrame, truth: DataFrame, base: Pipeline | None = None, second: Pipeline | None = None, names: tuple[str, ...] = features.ALL) -> dict[str, PipelineModel]:
    """base, guardian, relative and cross, from the featured, labelled pairs of the fitting records. Records of truth without pairs teach the guardian by zeros."""
    base, second = base or model.logistic(), second or model.logistic()
    sample = lambda df: training(df).select(df.columns)
    p = pairs.withColumn("fold", sampling.halves(entity_key(F.col("s1"), SEED)))
    halves = [model.fit(sample(p.filter(F.col("fold") != k)), base, names) for k in (0, 1)]
    held = stored(model.scored(p.filter("fold = 0"), halves[0], names).unionByName(model.scored(p.filter("fold = 1"), halves[1], names)))
    entity, pair = decision_tables(held)
    entity = truth.select("s1", (F.size("targets") > 0).cast("int").alias("label")).join(entity, "s1", "left").fillna(0.0)
    pair = pair.join(pairs.select("s1", "target", "label"), ["s1", "target"])
    return {
        "base": model.fit(sample(pairs), base, names),
        "guardian": model.fit(entity, second, tuple(ENTITY)),
        "relative": model.fit(pair, second, tuple(RELATIVE)),
        "cross": model.fit(pair, second, tuple(CROSS)),
    }


def training(pairs: DataFrame) -> DataFrame:
    """The sampled pairs of linkage.training()."""
    from kindred.plans import linkage

    return linkage.training(pairs, SEED)


def scored_group(pairs: DataFrame, models: dict[str, PipelineModel], second_stage: str | None = None, names: tuple[str, ...] = features.ALL) -> DataFrame:
    """pairs with `score` of the base matcher or, if named, of a second-stage model over it."""
    first = decide.finite(model.scored(pairs, models["base"], names))
    if second_stage is None:
        return first
    again = model.scored(decision_tables(stored(first))[1], models[second_stage], tuple(CROSS if second_stage == "cross" else RELATIVE))
    return first.drop("score").join(again.select("s1", "target", "score"), ["s1", "target"])


def variants(pairs: DataFrame, models: dict[str, PipelineModel], names: tuple[str, ...] = features.ALL) -> DataFrame:
    """pairs with base, relative and cross scores, guardian_probability and numeric_conflict; every score is checked to be finite."""
    first = stored(decide.finite(model.scored(pairs, models["base"], names)))
    entity, pair = decision_tables(first)
    out = first.withColumn("base", F.col("score")).withColumn("numeric_conflict", F.col("primary_number_mismatch"))
    for name, inputs in (("relative", RELATIVE), ("cross", CROSS)):
        again = decide.finite(model.scored(pair, models[name], tuple(inputs)))
        out = out.join(again.select("s1", "target", F.col("score").alias(name)), ["s1", "target"])
    guard = decide.finite(model.scored(entity.withColumn("target", F.lit("")), models["guardian"], tuple(ENTITY)))
    out = out.join(guard.select("s1", F.col("score").alias("guardian_probability")), "s1")
    return stored(out.select("s1", "source", "target", "base", "relative", "cross", "guardian_probability", "numeric_conflict"))


def _assessed(scored: DataFrame, truth: DataFrame, name: str, variant: str, policy: decide.Policy) -> dict:
    found = decide.assessed(scored.withColumn("score", F.col(variant)), truth, policy).first()
    return {"name": name, "variant": variant, **asdict(policy), "macro_fbeta": found["macro_fbeta"], "macro_precision": found["macro_precision"], "macro_recall": found["macro_recall"]}


def best(rows: list[dict]) -> dict:
    """The greatest macro F0.5 (to 12 places), then precision, then sum of thresholds, then the earliest."""
    return max(enumerate(rows), key=lambda r: (round(r[1]["macro_fbeta"], 12), r[1]["macro_precision"], r[1]["s2"] + r[1]["s3"], -r[0]))[1]


def tune(scored: DataFrame, truth: DataFrame, ownership: DataFrame | None = None, grid=decide.GRID) -> tuple[dict, list[dict]]:
    """(the chosen policy, all that were tried) on the output of variants(). ownership: the truth whose targets decide whether one owner a target may be asked for; by default truth.

    Five policies stand on the base score: one threshold, one a source, and the latter with the guardian, with one owner a
    target, with both. The best of them lends its guardian and ownership to the two second-stage scores, each with its own
    thresholds; penalties on clashing numbers are then tried on the best of all.
    """
    on = lambda v: scored.withColumn("score", F.col(v))

    def thresholds(variant: str, **options) -> decide.Policy:
        x = decide.source_thresholds(on(variant), truth, grid, **options).first()
        return decide.Policy(x["s2"], x["s3"])

    owned = metrics.ownership(truth if ownership is None else ownership).first()["conflicts"] == 0
    source = thresholds("base")
    guarded = replace(source, guardian=decide.guardian_cutoff(on("base"), truth, source))
    tried = {
        "global_threshold": thresholds("base", single=True), "source_thresholds": source, "source_guardian": guarded,
        "source_exclusivity": replace(source, exclusivity=owned), "source_guardian_exclusivity": replace(guarded, exclusivity=owned),
    }
    rows = [_assessed(scored, truth, name, "base", p) for name, p in tried.items()]
    leader = best(rows)
    for name, variant in (("relative_decision", "relative"), ("cross_source_decision", "cross")):
        p = replace(thresholds(variant), exclusivity=leader["exclusivity"])
        if leader["guardian"] is not None:
            p = replace(p, guardian=decide.guardian_cutoff(on(variant), truth, p))
        rows.append(_assessed(scored, truth, name, variant, p))
    leader = best(rows)
    for x in PENALTIES:
        p = replace(thresholds(leader["variant"], penalty=x), guardian=leader["guardian"], exclusivity=leader["exclusivity"], penalty=x)
        rows.append(_assessed(scored, truth, f"numeric_penalty_{x:.2f}", leader["variant"], p))
    return best(rows), rows


def chosen(row: dict) -> decide.Policy:
    return decide.Policy(row["s2"], row["s3"], row["guardian"], row["exclusivity"], row["penalty"])


def decided(scored: DataFrame, row: dict) -> DataFrame:
    """The pairs that the chosen policy accepts, of the output of variants()."""
    return decide.accepted(scored.withColumn("score", F.col(row["variant"])), chosen(row))
