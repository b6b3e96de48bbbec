"""From scores to matches: thresholds for each source, one owner a target, a guardian of records without matches, a penalty on clashing numbers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import fuzzy
from kindred.operators import metrics as M
from kindred.operators.ranking import exclusive, score_ranks, top

#: The 187 thresholds that are tried for either source.
GRID = (*[i / 100 for i in range(50, 85)], *[i / 1000 for i in range(850, 1001)], 1.000001)


@dataclass(frozen=True)
class Policy:
    s2: float
    s3: float
    guardian: float | None = None
    exclusivity: bool = False
    penalty: float = 0.0

    def require(self, expected: dict) -> None:
        """Raises unless the policy is the approved one."""
        wrong = {k: (getattr(self, k), v) for k, v in expected.items() if getattr(self, k) != v}
        if wrong:
            raise ValueError(f"policy differs: {wrong}")


def finite(scored: DataFrame, column: str = "score") -> DataFrame:
    """scored with the check that every score is a finite number."""
    ok = F.col(column).isNotNull() & ~F.isnan(column) & (F.abs(column) < F.lit(float("inf")))
    return scored.withColumn(column, F.when(ok, F.col(column)).otherwise(F.raise_error(F.concat(F.lit("score is not finite for "), "s1", F.lit(" "), "target")).cast("double")))


def accepted(scored: DataFrame, policy: Policy) -> DataFrame:
    """The pairs (s1, target, score) that the policy accepts. scored: s1, source, target, score, and numeric_conflict and guardian_probability if the policy asks for them."""
    p = scored.withColumn("score", F.col("score") - policy.penalty * F.col("numeric_conflict")) if policy.penalty else scored
    p = p.filter(F.col("score") >= F.when(F.col("source") == "S2", F.lit(policy.s2)).when(F.col("source") == "S3", F.lit(policy.s3)))
    if policy.guardian is not None:
        p = p.filter(F.col("guardian_probability") > policy.guardian)
    return (exclusive(p) if policy.exclusivity else p).select("s1", "target", "score")


def claims(pairs: DataFrame) -> DataFrame:
    """One row: claimed targets, and claims beyond the first of each."""
    t = pairs.groupBy("target").agg(F.count("*").alias("n"))
    return t.agg(F.count("*").alias("claimed"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))


def check_exclusivity(truth: DataFrame) -> None:
    """One owner a target may be asked for only if no target of truth has two."""
    n = M.ownership(truth).first()["conflicts"]
    if n:
        raise ValueError(f"{n} targets have several owners")


def assessed(scored: DataFrame, truth: DataFrame, policy: Policy) -> DataFrame:
    return M.evaluated(M.entity_metrics(truth, accepted(scored, policy)))


def _corners(n: int):
    """For mapInPandas: the differences (i, j, d) of the records' summed values of F0.5 over a grid of n thresholds a source."""

    def steps(at: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Where values start, and the counts of the pairs that pass from there on."""
        return np.concatenate([[1], at + 1]), *(np.concatenate([c[::-1].cumsum()[::-1], [0]]) for c in counts)

    def corners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros((n + 2, n + 2))
        for batch in batches:
            for n_true, times, *x in batch.itertuples(index=False):
                (i, tp2, fp2), (j, tp3, fp3) = steps(*x[:3]), steps(*x[3:])
                tp, fp = np.add.outer(tp2, tp3), np.add.outer(fp2, fp3)
                value = np.divide(1.25 * tp, 1.25 * tp + 0.25 * (n_true - tp) + fp) if n_true else (fp == 0).astype(float)
                value = np.diff(np.diff(value, axis=0, prepend=0), axis=1, prepend=0)
                table[np.ix_(i, j)] += times * value
        i, j = np.nonzero(table[: n + 1, : n + 1])
        yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "d": table[i, j]})

    return corners


def source_thresholds(scored: DataFrame, truth: DataFrame, grid: Sequence[float] = GRID, penalty: float = 0.0, single: bool = False) -> DataFrame:
    """The pair of thresholds (s2, s3) of the greatest macro F0.5, and that; equal ones: the higher sum, then the higher s2.

    Each record's hits by source change at its own scores only. So instead of every pair of thresholds with every record,
    the records' steps are multiplied: between two neighbouring scores nothing changes. Records of the same steps count
    together. They give a value for each rectangle of (s2, s3) steps as a difference on the grid's corners; a task adds
    these up on one grid, and two running sums over the small grid finish it.
    """
    label = M.links(truth).withColumn("t", F.lit(1))
    p = scored.withColumn("score", F.col("score") - penalty * F.col("numeric_conflict")) if penalty else scored
    p = p.select("s1", "source", "target", "score").join(label, ["s1", "target"], "left").withColumn("at", M.level(F.col("score"), grid))
    steps = p.filter("at > 0").groupBy("s1", "source", "at").agg(F.count("t").alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"))
    lists = steps.groupBy("s1").agg(*[F.array_sort(F.collect_list(F.when(F.col("source") == s, F.struct("at", "tp", "fp")))).alias(s) for s in ("S2", "S3")])
    none = F.array().cast("array<struct<at:int,tp:bigint,fp:bigint>>")
    e = truth.select("s1", F.size("targets").alias("n")).join(lists, "s1", "left").withColumns({s: F.coalesce(s, none) for s in ("S2", "S3")})
    same = e.groupBy("n", "S2", "S3").agg(F.count("*").alias("times"))
    flat = same.select("n", "times", *[F.col(f"{s}.{f}").cast("array<bigint>").alias(f"{s}{f}") for s in ("S2", "S3") for f in ("at", "tp", "fp")])
    corners = flat.mapInPandas(_corners(len(grid)), "i int, j int, d double").groupBy("i", "j").agg(F.sum("d").alias("d"))
    table = np.zeros((len(grid) + 1, len(grid) + 1))
    for r in corners.collect():  # at most the grid squared
        table[r["i"], r["j"]] += r["d"]
    means = table.cumsum(0).cumsum(1)[1:, 1:] / max(1, truth.count())
    pairs = ((i, j) for i in range(len(grid)) for j in ([i] if single else range(len(grid))))
    best = max(pairs, key=lambda x: (round(float(means[x]), 12), grid[x[0]] + grid[x[1]], grid[x[0]], grid[x[1]]))
    return truth.sparkSession.createDataFrame([(float(grid[best[0]]), float(grid[best[1]]), float(means[best]))], "s2 double, s3 double, macro_fbeta double")


def guardian_cutoff(scored: DataFrame, truth: DataFrame, policy: Policy) -> float:
    """The cutoff among 0, 0.02 … 0.9 of the greatest macro F0.5; equal ones: the lowest. A record's pairs stand or fall together, so its value is found once."""
    per = M.entity_metrics(truth, accepted(scored, policy)).select("s1", "n_true", "fp", "fbeta")
    g = scored.groupBy("s1").agg(F.max("guardian_probability").alias("g"))
    blank = F.when(F.col("n_true") == 0, 1.0).otherwise(0.0)
    x = per.join(g, "s1", "left").withColumn("cutoff", F.explode(F.array(*[F.lit(i / 100) for i in range(0, 91, 2)])))
    kept = F.when(F.col("g") > F.col("cutoff"), F.col("fbeta")).otherwise(blank)
    return x.groupBy("cutoff").agg(F.avg(kept).alias("f")).orderBy(F.round("f", 12).desc(), "cutoff").first()["cutoff"]


def cross_pairs(scored: DataFrame, k: int = 3) -> DataFrame:
    """(s1, a, b): a record's k best candidates in S2 with its k best in S3, at most k * k pairs."""
    best = top(scored.select("s1", "source", "target", "score"), k, ["s1", "source"], F.desc("score"), F.col("target"))
    side = lambda s, p: best.filter(F.col("source") == s).select("s1", F.col("target").alias(p))
    return side("S2", "a").join(side("S3", "b"), "s1")


def guardian_confusion(scored: DataFrame, truth: DataFrame, cutoff: float) -> DataFrame:
    """One row: records with and without matches that the guardian lets pass or stops. A record without pairs is stopped."""
    g = truth.select("s1", (F.size("targets") > 0).alias("has")).join(scored.groupBy("s1").agg(F.max("guardian_probability").alias("g")), "s1", "left")
    passed = F.coalesce(F.col("g") > cutoff, F.lit(False))
    n = lambda c: F.count_if(c)
    return g.agg(n(passed & F.col("has")).alias("passed_matched"), n(passed & ~F.col("has")).alias("passed_single"), n(~passed & F.col("has")).alias("stopped_matched"), n(~passed & ~F.col("has")).alias("stopped_single"))


def cross_evidence(scored: DataFrame, k: int = 3) -> DataFrame:
    """(s1, target, cross_name, cross_core, cross_address, cross_numeric_agreement, cross_numeric_conflict): the most alike of a record's k best candidates in the other source, at most k * k pairs a record. scored has tn2, ta2."""
    best = top(scored.select("s1", "source", "target", "score", "tn2", "ta2"), k, ["s1", "source"], F.desc("score"), F.col("target"))
    side = lambda s, p: best.filter(F.col("source") == s).select("s1", F.col("target").alias(p), F.col("tn2").alias(f"{p}n"), F.col("ta2").alias(f"{p}a"))
    both = side("S2", "a").join(side("S3", "b"), "s1")
    c = F.col
    f = fuzzy.similarities({"name": (c("an.text"), c("bn.text"), "ratio"), "core": (c("an.core"), c("bn.core"), "set"), "address": (c("aa.text"), c("ba.text"), "ratio")})
    p, q = c("aa.primary"), c("ba.primary")
    same, clash = ((p != "") & (p == q)).cast("double"), ((p != "") & (q != "") & (p != q)).cast("double")
    both = both.withColumn("f", f).select("s1", "a", "b", (c("f.name_ratio") / 100).alias("cross_name"), (c("f.core_set") / 100).alias("cross_core"), (c("f.address_ratio") / 100).alias("cross_address"), same.alias("cross_numeric_agreement"), clash.alias("cross_numeric_conflict"))
    values = both.columns[3:]
    return both.withColumn("target", F.explode(F.array("a", "b"))).groupBy("s1", "target").agg(*[F.max(v).alias(v) for v in values])


def decision_features(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row a record with 22 features, one row a pair with 20) of scored, featured pairs with cross evidence; values by windows over the record."""
    c = F.col
    cross = ["cross_name", "cross_core", "cross_address", "cross_numeric_agreement", "cross_numeric_conflict"]
    p = score_ranks(scored).fillna(0.0, cross)
    at = lambda col, ok: F.coalesce(F.max(F.when(ok, c(col))), F.lit(0.0))
    best = lambda s, r: at("score", (c("source") == s) & (c("source_rank") == r))
    margin = lambda s: F.when(F.max(F.when((c("source") == s) & (c("source_rank") == 2), 1)).isNotNull(), best(s, 1) - best(s, 2)).otherwise(0.0)
    first = c("rank") == 1
    entity = p.groupBy("s1").agg(
        at("score", first).alias("top"), at("score", c("rank") == 2).alias("second"), at("score", c("rank") == 3).alias("third"), F.count("*").cast("double").alias("candidate_count"),
        *[F.count_if(c("score") >= x / 100).cast("double").alias(f"above_{x}") for x in (50, 80, 95)], best("S2", 1).alias("best_s2"), best("S3", 1).alias("best_s3"), margin("S2").alias("s2_margin"), margin("S3").alias("s3_margin"),
        at("best_retrieval_score", first).alias("top_retrieval"), at("pass_count", first).alias("top_pass_count"), at("normalized_name_exact", first).alias("top_exact_name"), at("core_name_exact", first).alias("top_core_name"),
        at("normalized_address_exact", first).alias("top_address"), at("primary_number_mismatch", first).alias("top_numeric_conflict"), F.max((first & (c("source") == "S3")).cast("double")).alias("top_is_s3"), at("cross_name", first).alias("cross_name_agreement"),
        *[F.count_if((c("source") == s) & (c("score") >= 0.9)).cast("double").alias(f"strong_{s.lower()}") for s in ("S2", "S3")],
    )
    entity = entity.withColumns({"top_second": c("top") - c("second"), "second_third": c("second") - c("third"), "both_sources_strong": ((c("best_s2") >= 0.8) & (c("best_s3") >= 0.8)).cast("double")})
    shared = ["top", "second", "third", "top_second", "second_third", "above_50", "above_80", "above_95", "strong_s2", "strong_s3", "best_s2", "best_s3"]
    pair = p.select("s1", "source", "target", "score", "rank", "source_rank", *cross).join(entity.select("s1", *shared), "s1")
    pair = pair.withColumns({"minus_top": c("score") - c("top"), "source_top_margin": c("score") - F.when(c("source") == "S2", c("best_s2")).otherwise(c("best_s3"))}).drop("best_s2", "best_s3")
    return entity.drop("strong_s2", "strong_s3"), pair
