"""python -m kindred COMMAND …: the engine's jobs from the command line. Folders may lie in any file system that Spark reads."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import text as X
from kindred.functions.hashing import entity_key
from kindred.operators import audit, blocking, decide, features, index, metrics, miss, ranking, retrieve, sampling, validate
from kindred.plans import bundle, linkage, policy, presets, report
from kindred.sources import shards, tsv
from kindred.sources.store import discard, stored

CAPS = dict.fromkeys(ranking.PASSES, 40) | {"char_name": 0}
PARTS = ("fit", "tune", "evaluation")


def records(spark: SparkSession, data: str, split: str) -> DataFrame:
    out = [tsv.read_source(spark, f"{data}/{split}_source{k}.tsv", f"S{k}") for k in (1, 2, 3)]
    return out[0].unionByName(out[1]).unionByName(out[2])


def truth_of(spark: SparkSession, data: str) -> DataFrame:
    return tsv.read_truth(spark, f"{data}/train_ground_truth.tsv")


def identity(spark: SparkSession, a, split: str) -> str:
    inputs = {f"source{k}": f"{a.data}/{split}_source{k}.tsv" for k in (1, 2, 3)} | ({"truth": f"{a.data}/train_ground_truth.tsv"} if split == "train" else {})
    return shards.identity(spark, inputs, {"preset": a.preset})


def parts_of(r: DataFrame, truth: DataFrame) -> DataFrame:
    """(s1, part): three tenths of the records evaluate, three tenths of the rest tune."""
    held = linkage.split(r, truth, 0.3, 2028).filter("validation").select("s1")
    e = truth.select("s1", F.size("targets").alias("n_true")).join(r.select(F.col("entity_id").alias("s1"), "country"), "s1").withColumn("key", entity_key(F.col("s1"), 2029))
    return sampling.partitions(e, held, 0.3).select("s1", F.col("partition").alias("part"))


def pairs_job(r: DataFrame, truth: DataFrame | None, config: presets.IndexConfig):
    """What a shard does: the featured (and labelled) pairs of its records."""
    idx = index.materialised(index.build(r.filter("source <> 'S1'")))

    def job(mine: DataFrame) -> DataFrame:
        queries = r.filter("source = 'S1'").join(mine.select(F.col("s1").alias("entity_id")), "entity_id", "left_semi")
        found = ranking.eligible(retrieve.retrieved(stored(X.represented(queries)), idx, config), CAPS)
        out = features.with_all(found, queries, r.filter("source <> 'S1'"))
        out = linkage.labelled(out, truth) if truth is not None else out.withColumn("label", F.lit(None).cast("int"))
        return out.select("s1", "source", "target", "label", "qn2", "qa2", "tn2", "ta2", *features.ALL)

    return job


def cmd_audit(spark, a):
    r = records(spark, a.data, "train")
    t = truth_of(spark, a.data)
    both = r.withColumn("split", F.lit("train"))
    if a.test:
        both = both.unionByName(records(spark, a.data, "test").withColumn("split", F.lit("test")))
    tables = {"sources": audit.source_counts(r), "countries": audit.country_counts(r), "names": audit.lengths(r, "business_name"), "addresses": audit.lengths(r, "business_address"), "matches": audit.match_counts(t), "coverage": audit.coverage(t), "links": audit.links_by_source(t), "integrity": audit.integrity(t, r)}
    if not a.skip_duplicates:
        tables["duplicates"] = audit.duplicates(r, "business_name", "business_address", "country")
    if a.test:
        tables["shift"] = audit.country_shift(both)
    report.publish("Audit", tables, a.out)


def cmd_quick_audit(spark, a):
    r = records(spark, a.data, a.split)
    size = sum(n for k in (1, 2, 3) for _, n, _ in [shards.files(spark, f"{a.data}/{a.split}_source{k}.tsv")[0]])
    report.publish(f"Quick audit of {report.human_bytes(size)}", {"sources": audit.source_counts(r)}, a.out)


def cmd_profile(spark, a):
    r, t = records(spark, a.data, "train"), truth_of(spark, a.data)
    rep = stored(X.represented(r))
    sample = metrics.links(t).orderBy(F.xxhash64("s1", "target", F.lit(a.seed))).limit(a.sample)  # the sample is what is asked for
    q = rep.select(F.col("entity_id").alias("s1"), F.col("name").alias("qn"), F.col("address").alias("qa"))
    x = rep.select(F.col("entity_id").alias("target"), "source", "country", F.col("name").alias("tn"), F.col("address").alias("ta"))
    measures = [c for c in features.RULE if c.endswith(("ratio", "jaccard"))]
    report.publish("Positive pairs", {"profile": audit.profile(features.with_rule(sample.join(q, "s1").join(x, "target")), measures)}, a.out)


def cmd_link_countries(spark, a):
    report.publish("Countries of links", {"links": audit.link_countries(truth_of(spark, a.data), records(spark, a.data, "train"))}, a.out)


def cmd_rule(spark, a):
    r, t = records(spark, a.data, "train"), truth_of(spark, a.data)
    scored, found = linkage.rule_matches(r, a.threshold)
    scored = stored(scored.select("s1", "source", "target", "score"))
    tsv.write_tsv(tsv.submission(t.select("s1"), found), f"{a.out}/matching_results")
    report.publish("Lexical blocker and rule", {"candidates": metrics.candidate_metrics(t, scored), "thresholds": metrics.threshold_curve(scored, t, list(presets.RULE_THRESHOLDS))}, a.out)


def cmd_blocker(spark, a):
    r, t = records(spark, a.data, "train"), truth_of(spark, a.data)
    q, x = linkage.sides(r)
    pool = stored(blocking.multipass(stored(X.represented(q)), stored(X.represented(x))).select("s1", "source", "target", "best_score", "pass_count", *[f"{p}_rank" for p in ranking.PASSES]))
    report.publish("Multi-pass blocker", {"pool": metrics.candidate_metrics(t, pool), "budgets": metrics.budget_frontier(pool, t, presets.BUDGETS)}, a.out)


def cmd_index(spark, a):
    r = records(spark, a.data, a.split)
    for s in ("S2", "S3"):
        idx = index.build(r.filter(F.col("source") == s))
        tsv.store_index(idx, f"{a.out}/{s}", s, {"split": a.split, "identity": identity(spark, a, a.split)})


def opened(spark, folder: str, split: str, identity_: str) -> dict[str, DataFrame]:
    """Both sources' stored indexes as one; built for this split and identity, or an error."""
    two = [tsv.open_index(spark, f"{folder}/{s}", s, {"split": split, "identity": identity_}) for s in ("S2", "S3")]
    return {name: two[0][name].unionByName(two[1][name]) for name in two[0]}


def cmd_benchmark(spark, a):
    r, t = records(spark, a.data, "train"), truth_of(spark, a.data)
    idx = opened(spark, a.index, "train", identity(spark, a, "train"))
    e = t.select("s1", F.size("targets").alias("n_true")).join(r.select(F.col("entity_id").alias("s1"), "country"), "s1").withColumn("key", entity_key(F.col("s1"), 2029))
    asked = stored(sampling.stratified(e, min(a.sample, e.count()), ["country"]).select(F.col("s1").alias("entity_id")))
    start = time.time()
    queries = stored(X.represented(r.filter("source = 'S1'").join(asked, "entity_id", "left_semi")))
    pool = stored(retrieve.retrieved(queries, idx, presets.INDEX[a.preset]).select("s1", "source", "target", "best_score", "pass_count", *[f"{p}_rank" for p in ranking.PASSES]))
    seconds = time.time() - start
    mine = t.join(asked.select(F.col("entity_id").alias("s1")), "s1", "left_semi")
    tables = {"pool": metrics.candidate_metrics(mine, pool), "eligible": metrics.candidate_metrics(mine, ranking.eligible(pool, CAPS)), "time": spark.createDataFrame([(a.preset, asked.count(), seconds)], "preset string, records bigint, seconds double")}
    report.publish("Retrieval", tables | {"diagnostics": retrieve.diagnostics(queries, idx, presets.INDEX[a.preset]).drop("s1").groupBy("source").mean()}, a.out)


def cmd_misses(spark, a):
    r, t = records(spark, a.data, "train"), truth_of(spark, a.data)
    found = stored(linkage.candidates(r, presets.INDEX[a.preset]))
    classes = stored(miss.classified(t, found, presets.Budget("total", a.total, CAPS)))
    report.publish("Misses", {"classes": miss.summary(classes, r), "caps": miss.cap_counterfactual(t, found, CAPS)}, a.out)


def cmd_preflight(spark, a):
    print(json.dumps({"identity": identity(spark, a, "train"), "code": shards.code_digest(), "packages": shards.packages()}))


def cmd_ownership(spark, a):
    t = truth_of(spark, a.data)
    report.publish("Owners of targets", {"owners": metrics.ownership(t), "conflicts": metrics.conflicts(t)}, a.out)


def cmd_generate(spark, a):
    r, t, who = records(spark, a.data, "train"), truth_of(spark, a.data), identity(spark, a, "train")
    parts, job = stored(parts_of(r, t)), pairs_job(r, t, presets.INDEX[a.preset])
    for part in a.part or PARTS[:2]:
        print(part, shards.run(parts.filter(F.col("part") == part).select("s1"), job, f"{a.out}/{part}", a.shards, who, a.shard))


def pairs_of(spark, a, part: str, mine: DataFrame) -> DataFrame:
    return shards.merged(spark, f"{a.pairs}/{part}", a.shards, identity(spark, a, "train"), mine, unique=("s1", "target"))


def _part(spark, a, part: str) -> tuple[DataFrame, DataFrame]:
    r, t = records(spark, a.data, "train"), truth_of(spark, a.data)
    mine = stored(parts_of(r, t)).filter(F.col("part") == part).select("s1")
    return pairs_of(spark, a, part, mine), t.join(mine, "s1", "left_semi")


def cmd_oracle(spark, a):
    pairs, t = _part(spark, a, a.part)
    report.publish("Oracle of the blocker", {"oracle": metrics.oracle(t, pairs.select("s1", "target"))}, a.out)


def cmd_train(spark, a):
    (pairs, t), (tuning, tuning_truth) = _part(spark, a, "fit"), _part(spark, a, "tune")
    models = policy.fit(pairs, t)
    row, tried = policy.tune(policy.variants(tuning, models), tuning_truth, truth_of(spark, a.data))
    bundle.freeze(spark, models, row, tried, a.out, identity(spark, a, "train"), presets.INDEX[a.preset])
    print(json.dumps(row))


def cmd_evaluate(spark, a):
    pairs, t = _part(spark, a, "evaluation")
    found = stored(bundle.matches(spark, a.bundle, pairs, identity(spark, a, "train")))
    values = metrics.evaluated(metrics.entity_metrics(t, found))
    report.publish(f"Evaluation: {linkage.promotion(values.first()['macro_fbeta'])}", {"metrics": values, "misses": metrics.false_negatives(t, pairs.select("s1", "target"), found), "claims": decide.claims(found)}, a.out)


def cmd_infer(spark, a):
    r, who = records(spark, a.data, "test"), identity(spark, a, "test")
    entities = r.filter("source = 'S1'").select(F.col("entity_id").alias("s1"))
    models, body = bundle.load(spark, a.bundle)
    pairs = pairs_job(r, None, presets.IndexConfig(**body["config"]))

    def job(mine: DataFrame) -> DataFrame:
        scored = policy.variants(stored(pairs(mine)), models)
        return scored.select("s1", "target").join(policy.decided(scored, body["policy"]).select("s1", "target", F.lit(True).alias("accepted")), ["s1", "target"], "left").fillna(False, ["accepted"])

    print(shards.run(entities, job, a.out, a.shards, who, a.shard))


def cmd_infer_merge(spark, a):
    r, who = records(spark, a.data, "test"), identity(spark, a, "test")
    entities = r.filter("source = 'S1'").select(F.col("entity_id").alias("s1"))
    found = stored(shards.merged(spark, a.results, a.shards, who, entities, unique=("s1", "target")))
    accepted = found.filter("accepted")
    if bundle_policy(spark, a)["exclusivity"]:  # a target's owner is decided over all shards
        raise tsv.DataError("one owner a target needs scores: infer with one shard")
    matching, candidate = tsv.submission(entities, accepted), tsv.submission(entities, found, "candidate_entity_ids")
    validate.check(matching, "matched_entity_ids", entities)
    tsv.write_tsv(matching, f"{a.out}/matching_results")
    tsv.write_tsv(candidate, f"{a.out}/candidate_pairs")


def bundle_policy(spark, a) -> dict:
    return bundle.load(spark, a.bundle)[1]["policy"]


def lists(df: DataFrame, column: str) -> DataFrame:
    ids = F.when(F.col(column) == "", F.array().cast("array<string>")).otherwise(F.split(column, ","))
    return df.select(F.col("source1_entity_id").alias("s1"), ids.alias("targets"))


def cmd_validate(spark, a):
    entities = records(spark, a.data, "test").filter("source = 'S1'").select(F.col("entity_id").alias("s1"))
    known = records(spark, a.data, "test").filter("source <> 'S1'").select(F.col("entity_id").alias("target")) if a.check_ids else None
    matching, candidate = tsv.read_tsv(spark, a.matching, tsv.TRUTH), tsv.read_tsv(spark, a.candidate, tsv.CANDIDATES)
    broken = validate.violations(matching, "matched_entity_ids", entities, known).withColumn("file", F.lit("matching")).unionByName(validate.violations(candidate, "candidate_entity_ids", entities, known).withColumn("file", F.lit("candidate")))
    rows = broken.filter("n > 0").collect()  # at most one a rule and file
    for r in rows:
        print(r["file"], r["rule"], r["n"], r["example"])
    more = validate.not_subset(lists(matching, "matched_entity_ids"), lists(candidate, "candidate_entity_ids")).count()
    if more:
        print(f"warning: {more} records have matches that are no candidates")
    if rows:
        sys.exit(1)
    print("valid")


def cmd_output_audit(spark, a):
    matching, candidate = tsv.read_tsv(spark, a.matching, tsv.TRUTH), tsv.read_tsv(spark, a.candidate, tsv.CANDIDATES)
    report.publish("Outputs", {"outputs": audit.output_audit(lists(matching, "matched_entity_ids"), lists(candidate, "candidate_entity_ids"))}, a.out)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kindred")
    sub = p.add_subparsers(dest="command", required=True)
    options = {
        "--data": dict(required=True, help="folder of the sources"), "--out": dict(required=True), "--preset": dict(default="compact_18", choices=sorted(presets.INDEX)),
        "--split": dict(default="train", choices=("train", "test")), "--index": dict(required=True), "--pairs": dict(required=True), "--bundle": dict(required=True), "--results": dict(required=True),
        "--matching": dict(required=True), "--candidate": dict(required=True), "--check-ids": dict(action="store_true"), "--shards": dict(type=int, default=8), "--shard": dict(type=int),
        "--sample": dict(type=int, default=100_000), "--seed": dict(type=int, default=7), "--threshold": dict(type=float, default=96.0), "--total": dict(type=int, default=60),
        "--test": dict(action="store_true"), "--skip-duplicates": dict(action="store_true"),
    }
    uses = {
        "audit": "--data --out --test --skip-duplicates", "quick-audit": "--data --out --split", "profile": "--data --out --sample --seed", "link-countries": "--data --out", "rule": "--data --out --threshold",
        "blocker": "--data --out", "index": "--data --out --split --preset", "benchmark": "--data --out --index --preset --sample", "misses": "--data --out --preset --total", "preflight": "--data --preset",
        "ownership": "--data --out", "generate": "--data --out --preset --shards --shard", "oracle": "--data --out --pairs --preset --shards", "train": "--data --out --pairs --preset --shards",
        "evaluate": "--data --out --pairs --bundle --preset --shards", "infer": "--data --out --bundle --preset --shards --shard", "infer-merge": "--data --out --results --bundle --preset --shards",
        "validate": "--data --matching --candidate --check-ids", "output-audit": "--out --matching --candidate",
    }
    for name, flags in uses.items():
        c = sub.add_parser(name)
        for flag in flags.split():
            c.add_argument(flag, **options[flag])
        if name == "generate":
            c.add_argument("--part", action="append", choices=PARTS, help="fit and tune by default")
        if name == "oracle":
            c.add_argument("--part", default="tune", choices=PARTS[1:])
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"kindred {a.command}").getOrCreate()
    try:
        globals()["cmd_" + a.command.replace("-", "_")](spark, a)
    finally:
        discard(spark)


if __name__ == "__main__":
    main()
