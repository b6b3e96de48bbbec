"""Checks of output files: each rule is a count with an example; a file passes if all counts are 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def violations(raw: DataFrame, ids: str, entities: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(rule, n, example) over raw (source1_entity_id, ids: the comma lists). entities (s1) must be covered exactly; targets (target), if given, are all that may be named."""
    r = raw.select(F.col("source1_entity_id").alias("s1"), F.col(ids).alias("list")).withColumn("items", F.when(F.trim("list") == "", F.array().cast("array<string>")).otherwise(F.split("list", ",")))
    items = r.select("s1", F.explode("items").alias("target"))
    rules = {
        "blank_entity": r.filter("trim(s1) = ''").select(F.col("s1").alias("x")),
        "wrong_entity_prefix": r.filter("NOT startswith(s1, 'S1-')").select(F.col("s1").alias("x")),
        "repeated_entity": r.groupBy("s1").count().filter("count > 1").select(F.col("s1").alias("x")),
        "blank_item": items.filter("trim(target) = ''").select(F.col("s1").alias("x")),
        "repeated_item": r.filter(F.size(F.array_distinct("items")) < F.size("items")).select(F.col("s1").alias("x")),
        "unsorted": r.filter(F.array_sort("items") != F.col("items")).select(F.col("s1").alias("x")),
        "self_match": items.filter("target = s1").select(F.col("s1").alias("x")),
        "wrong_prefix": items.filter("NOT target RLIKE '^S[23]-.+$' AND target <> s1").select(F.col("target").alias("x")),
        "missing_entity": entities.select("s1").distinct().join(r, "s1", "left_anti").select(F.col("s1").alias("x")),
        "unknown_entity": r.select("s1").distinct().join(entities, "s1", "left_anti").select(F.col("s1").alias("x")),
    }
    if targets is not None:
        rules["unknown_target"] = items.select("target").distinct().join(targets, "target", "left_anti").select(F.col("target").alias("x"))
    one = lambda name, df: df.agg(F.count("*").alias("n"), F.min("x").alias("example")).withColumn("rule", F.lit(name))
    return reduce(DataFrame.unionByName, [one(k, v) for k, v in rules.items()]).select("rule", "n", "example")


def check(raw: DataFrame, ids: str, entities: DataFrame, targets: DataFrame | None = None) -> None:
    broken = violations(raw, ids, entities, targets).filter("n > 0").collect()
    if broken:
        raise ValueError("; ".join(f"{r['rule']}: {r['n']} (e.g. {r['example']})" for r in broken))


def not_subset(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Records (s1) whose matches (s1, targets) are not all candidates (s1, targets)."""
    c = candidates.select("s1", F.col("targets").alias("c"))
    return matches.join(c, "s1", "left").filter(F.size(F.array_except("targets", F.coalesce("c", F.array().cast("array<string>")))) > 0).select("s1")
