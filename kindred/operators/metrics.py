"""Evaluation on link tables: truth (s1, targets), predictions (s1, target). Macro values are means of each record's value, singletons included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def links(truth: DataFrame) -> DataFrame:
    """(s1, target), a row a true link; records without a match give none."""
    return truth.select("s1", F.explode("targets").alias("target"))


def candidate_sets(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("s1").agg(F.array_sort(F.collect_set("target")).alias("targets"))


def fbeta(precision: Column, recall: Column, beta: float = 0.5) -> Column:
    """0 where both are 0."""
    b = beta * beta
    return F.coalesce(F.try_divide((1 + b) * precision * recall, b * precision + recall), F.lit(0.0))


def entity_metrics(truth: DataFrame, predicted: DataFrame, beta: float = 0.5) -> DataFrame:
    """Per record of truth: n_true, tp, fp, fn, precision, recall, fbeta. A record without matches scores 1 if nothing is predicted, else 0."""
    t = links(truth).withColumn("t", F.lit(1))
    p = predicted.select("s1", "target").distinct().join(truth.select("s1"), "s1", "left_semi").withColumn("p", F.lit(1))
    both = t.join(p, ["s1", "target"], "full")
    hit = F.col("t").isNotNull() & F.col("p").isNotNull()
    n = both.groupBy("s1").agg(F.count("t").alias("n_true"), F.count_if(hit).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    m = truth.select("s1").join(n, "s1", "left").fillna(0)
    clean = F.when(F.col("fp") == 0, 1.0).otherwise(0.0)
    single = F.col("n_true") == 0
    ratio = lambda x: F.coalesce(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col(x)).cast("double")), F.lit(0.0))
    m = m.withColumns({"precision": F.when(single, clean).otherwise(ratio("fp")), "recall": F.when(single, clean).otherwise(ratio("fn"))})
    return m.withColumn("fbeta", F.when(single, clean).otherwise(fbeta(F.col("precision"), F.col("recall"), beta)))




def evaluated(per_entity: DataFrame, *by: str, beta: float = 0.5) -> DataFrame:
    """Macro and micro values over entity_metrics, as a whole or by columns."""
    single = F.col("n_true") == 0
    e = per_entity.groupBy(*by).agg(
        F.count("*").alias("entities"), F.avg("fbeta").alias("macro_fbeta"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.count_if(single).alias("singletons"), F.count_if(single & (F.col("fp") == 0)).alias("correct_singletons"),
    )
    return _with_micro(e, beta)


def _with_micro(e: DataFrame, beta: float = 0.5) -> DataFrame:
    micro = lambda x: F.when(F.col("tp") + F.col(x) > 0, F.col("tp") / (F.col("tp") + F.col(x))).otherwise(F.when(F.col("tp") + F.col("fp") + F.col("fn") == 0, 1.0).otherwise(0.0))
    e = e.withColumns({"micro_precision": micro("fp"), "micro_recall": micro("fn")})
    return e.withColumn("micro_fbeta", fbeta(F.col("micro_precision"), F.col("micro_recall"), beta))


def check_coverage(truth: DataFrame, predicted_entities: DataFrame) -> None:
    """Every record of truth has a prediction (an empty one counts) and no other has."""
    missing, extra = truth.join(predicted_entities, "s1", "left_anti").count(), predicted_entities.join(truth, "s1", "left_anti").count()
    if missing or extra:
        raise ValueError(f"predictions lack {missing} records and have {extra} others")


def multiplicity(n: Column) -> Column:
    return F.when(n == 0, "0").when(n <= 2, "1-2").when(n <= 4, "3-4").otherwise("5+")


def sliced(per_entity: DataFrame, records: DataFrame, truth: DataFrame) -> DataFrame:
    """evaluated() for (dimension, value): overall, country, source of the matches, source and country, number of matches. One aggregation over labels exploded a record."""
    sources = truth.select("s1", F.when(F.size("targets") > 0, F.array_sort(F.array_distinct(F.transform("targets", lambda t: F.substring(t, 1, 2))))).otherwise(F.array(F.lit("singleton"))).alias("sources"))
    e = per_entity.join(records.select(F.col("entity_id").alias("s1"), "country"), "s1").join(sources, "s1")
    label = lambda d, v: F.struct(F.lit(d).alias("dimension"), v.alias("value"))
    labels = F.concat(
        F.array(label("overall", F.lit("all")), label("country", F.col("country")), label("multiplicity", multiplicity(F.col("n_true")))),
        F.transform("sources", lambda s: label("source", s)), F.transform("sources", lambda s: label("source_country", F.concat_ws("|", s, F.col("country")))),
    )
    return evaluated(e.withColumn("l", F.explode(labels)).withColumns({"dimension": F.col("l.dimension"), "value": F.col("l.value")}), "dimension", "value")


def false_negatives(truth: DataFrame, candidates: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: links missed by the blocker, missed by the matcher, and both."""
    t = links(truth)
    c = candidates.select("s1", "target").distinct().withColumn("c", F.lit(True))
    p = predicted.select("s1", "target").distinct().withColumn("p", F.lit(True))
    x = t.join(c, ["s1", "target"], "left").join(p, ["s1", "target"], "left").filter("p IS NULL")
    return x.agg(F.count_if(F.col("c").isNull()).alias("blocker_fn"), F.count_if(F.col("c").isNotNull()).alias("matcher_fn"), F.count("*").alias("fn"))


def candidate_metrics(truth: DataFrame, candidates: DataFrame, records: DataFrame | None = None, target_counts: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """Link recall, records whose links are all kept, candidates a record (mean and linear quantiles) and, with records and (country, n), the reduction ratio."""
    n = candidates.groupBy("s1").agg(F.count_distinct("target").alias("n"))
    kept = links(truth).join(candidates.select("s1", "target").distinct(), ["s1", "target"], "left_semi").groupBy("s1").agg(F.count("*").alias("kept"))
    e = truth.select("s1", F.size("targets").alias("n_true"), *(by or [])).join(n, "s1", "left").join(kept, "s1", "left").fillna(0, ["n", "kept"])
    possible = F.lit(None).cast("double")
    if records is not None and target_counts is not None:
        country = records.select(F.col("entity_id").alias("s1"), "country").join(target_counts.withColumnRenamed("n", "possible"), "country", "left").select("s1", "possible")
        e, possible = e.join(country, "s1", "left"), F.sum("possible").cast("double")
    else:
        e = e.withColumn("possible", F.lit(None).cast("double"))
    every, matched = F.col("kept") == F.col("n_true"), F.col("n_true") > 0
    q = lambda p: F.expr(f"percentile(n, {p})")
    return e.groupBy(*(by or [])).agg(
        F.count("*").alias("entities"), F.sum("n_true").alias("true_links"), F.sum("kept").alias("kept_links"), F.coalesce(F.try_divide(F.sum("kept").cast("double"), F.sum("n_true").cast("double")), F.lit(1.0)).alias("link_recall"),
        F.count_if(every).alias("all_kept"), (F.count_if(every) / F.count("*")).alias("all_kept_rate"), F.coalesce(F.try_divide(F.count_if(every & matched).cast("double"), F.count_if(matched).cast("double")), F.lit(1.0)).alias("matched_all_kept_rate"),
        F.avg("n").alias("mean_candidates"), q(0.5).alias("median_candidates"), q(0.95).alias("p95_candidates"), q(0.99).alias("p99_candidates"), F.max("n").alias("max_candidates"), F.count_if(F.col("n") == 0).alias("zero_entities"),
        (1.0 - F.try_divide(F.sum("n").cast("double"), possible)).alias("reduction_ratio"),
    )


def oracle(truth: DataFrame, eligible: DataFrame, low: float = 0.985, high: float = 0.99) -> DataFrame:
    """What a perfect matcher would reach on the eligible pairs: metrics of truth itself cut to them, coverage and two flags."""
    best = links(truth).join(eligible.select("s1", "target").distinct(), ["s1", "target"], "left_semi")
    per = entity_metrics(truth, best)
    some = F.col("n_true") > 0
    extra = per.agg(F.avg((F.col("fn") == 0).cast("double")).alias("coverage"), F.coalesce(F.try_divide(F.count_if(some & (F.col("tp") == 0)).cast("double"), F.count_if(some).cast("double")), F.lit(0.0)).alias("zero_retained_rate"))
    out = evaluated(per).join(extra)
    return out.withColumns({"too_low": F.col("macro_fbeta") < low, "high_enough": F.col("macro_fbeta") >= high})


def ownership(truth: DataFrame) -> DataFrame:
    """One row: links, targets, targets with several owners, the most owners, and such targets by source."""
    t = links(truth).groupBy("target").agg(F.count_distinct("s1").alias("owners"))
    many = F.col("owners") > 1
    source = lambda s: F.count_if(many & F.col("target").startswith(f"{s}-"))
    return t.agg(F.sum("owners").alias("links"), F.count("*").alias("targets"), F.count_if(many).alias("conflicts"), F.max("owners").alias("most_owners"), source("S2").alias("conflicts_s2"), source("S3").alias("conflicts_s3"))


def conflicts(truth: DataFrame, n: int = 20) -> DataFrame:
    """The first n targets with several owners."""
    return links(truth).groupBy("target").agg(F.array_sort(F.collect_set("s1")).alias("owners")).filter(F.size("owners") > 1).orderBy("target").limit(n)


def error_slices(truth: DataFrame, predicted: DataFrame, records: DataFrame) -> DataFrame:
    """TP, FP and FN links by (dimension, value): kind of record, number of matches, source and country."""
    t = links(truth).withColumn("t", F.lit(True))
    p = predicted.select("s1", "target").distinct().withColumn("p", F.lit(True))
    n = truth.select("s1", F.size("targets").alias("n_true"))
    x = t.join(p, ["s1", "target"], "full").join(n, "s1").join(records.select(F.col("entity_id").alias("s1"), "country"), "s1")
    label = lambda d, v: F.struct(F.lit(d).alias("dimension"), v.alias("value"))
    x = x.withColumn("l", F.explode(F.array(label("entity", F.when(F.col("n_true") == 0, "singleton").otherwise("matched")), label("multiplicity", multiplicity(F.col("n_true"))), label("source_country", F.concat_ws("|", F.substring("target", 1, 2), F.col("country"))))))
    hit = F.col("t").isNotNull()
    return x.groupBy("l.dimension", "l.value").agg(F.count_if(hit & F.col("p").isNotNull()).alias("tp"), F.count_if(~hit).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))


def error_causes(scored: DataFrame, threshold: float) -> DataFrame:
    """Errors of scored, featured, labelled pairs by cause, one row."""
    c = F.col
    accepted = c("score") >= threshold
    fp, fn = accepted & (c("label") == 0), ~accepted & (c("label") == 1)
    numbers = (c("left_has_numeric") == 1) & (c("right_has_numeric") == 1) & (c("digit_token_overlap") == 0)
    return scored.agg(
        F.count_if(fp).alias("fp"), F.count_if(fn).alias("fn"), F.count_if(fp & numbers).alias("fp_conflicting_numbers"), F.count_if(fp & (c("normalized_name_exact") == 1)).alias("fp_same_name"),
        F.count_if(fn & ((c("left_address_missing") == 1) | (c("right_address_missing") == 1))).alias("fn_missing_address"), F.count_if(fn & (c("name_token_set_ratio") >= 90) & (c("name_ratio") < 60)).alias("fn_high_set_low_edit"),
        F.count_if(fn & (c("score") >= 0.95 * threshold)).alias("fn_just_below"),
    )


def level(score: Column, grid: list[float]) -> Column:
    """How many of the rising thresholds a score passes, by halves; a score that is null passes none."""
    g = F.array(*[F.lit(float(x)) for x in grid])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(grid).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(grid)) & (F.get(g, at + s - 1) <= score), at + s).otherwise(at))


def threshold_curve(scored: DataFrame, truth: DataFrame, grid: list[float]) -> DataFrame:
    """evaluated() for each threshold of a grid. A pair is counted once, at the highest threshold it passes; a record's values change at its own pairs' thresholds only, come in there and go out at the next, and running sums over the grid finish it: the grid never meets pairs or records."""
    rising = sorted(grid)
    g = F.array(*[F.lit(float(x)) for x in rising])
    label = links(truth).withColumn("t", F.lit(1))
    p = scored.select("s1", "target", "score").join(label, ["s1", "target"], "left").withColumn("at", level(F.col("score"), rising)).filter("at > 0")
    n = truth.select("s1", F.size("targets").alias("n_true"))
    counts = p.groupBy("s1", "at").agg(F.count("t").alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"))
    lists = n.join(counts.groupBy("s1").agg(F.array_sort(F.collect_list(F.struct("at", "tp", "fp"))).alias("c")), "s1", "left")  # at most a grid's length each
    same = lists.groupBy("n_true", "c").agg(F.count("*").alias("entities"))
    starts = F.concat(F.array(F.lit(1)), F.coalesce(F.transform("c", lambda x: x["at"] + 1), F.array().cast("array<int>")))
    over = lambda f: F.coalesce(F.aggregate("c", F.lit(0).cast("bigint"), lambda s, x: s + F.when(x["at"] >= F.col("level"), x[f]).otherwise(0)), F.lit(0))
    e = same.withColumn("starts", F.array_distinct(starts)).select("n_true", "c", "entities", "starts", F.posexplode("starts").alias("k", "level")).withColumns({"tp": over("tp"), "fp": over("fp")}).withColumn("fn", F.col("n_true") - F.col("tp"))
    single, clean = F.col("n_true") == 0, F.when(F.col("fp") == 0, 1.0).otherwise(0.0)
    ratio = lambda x: F.coalesce(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col(x)).cast("double")), F.lit(0.0))
    e = e.withColumns({"precision": F.when(single, clean).otherwise(ratio("fp")), "recall": F.when(single, clean).otherwise(ratio("fn"))}).withColumn("fbeta", F.when(single, clean).otherwise(fbeta(F.col("precision"), F.col("recall"))))
    e = e.withColumns({"singletons": single.cast("int"), "correct_singletons": (single & (F.col("fp") == 0)).cast("int")})
    macro, whole = ("fbeta", "precision", "recall"), ("tp", "fp", "fn", "singletons", "correct_singletons")
    ends = F.array(F.struct(F.col("level").alias("level"), F.lit(1).alias("sign")), F.struct(F.get("starts", F.col("k") + 1).alias("level"), F.lit(-1).alias("sign")))
    e = e.withColumn("x", F.explode(ends)).withColumns({"level": F.col("x.level"), "times": F.col("x.sign") * F.col("entities")}).filter(F.col("level") <= len(rising))
    sums = e.groupBy("level").agg(F.sum("times").alias("entities"), *[F.sum(F.col("times") * F.col(x)).alias(x) for x in whole], *[F.sum(F.col("times").cast("decimal(18,0)") * F.col(x).cast("decimal(17,16)")).alias(x) for x in macro])
    every = truth.sparkSession.range(1, len(rising) + 1).select(F.col("id").cast("int").alias("level")).join(sums, "level", "left").fillna(0)
    running = Window.orderBy("level")  # a row a threshold
    e = every.withColumns({x: F.sum(x).over(running) for x in ("entities", *whole, *macro)}).filter("entities > 0")
    e = e.withColumns({f"macro_{x}": F.col(x).cast("double") / F.col("entities") for x in macro}).drop(*macro)
    return _with_micro(e).withColumn("threshold", F.element_at(g, F.col("level"))).drop("level")


def best_threshold(scored: DataFrame, truth: DataFrame, grid: list[float]) -> DataFrame:
    """The threshold of the greatest macro F; equal ones: the higher."""
    return threshold_curve(scored, truth, grid).orderBy(F.round("macro_fbeta", 12).desc(), F.desc("threshold")).limit(1)


def budget_frontier(pairs: DataFrame, truth: DataFrame, budgets: dict) -> DataFrame:
    """candidate_metrics of each budget, best recall first, then fewest candidates."""
    from functools import reduce

    from kindred.operators.ranking import budgeted

    rows = [candidate_metrics(truth, budgeted(pairs, b.caps, b.total)).withColumn("budget", F.lit(name)) for name, b in budgets.items()]
    return reduce(DataFrame.unionByName, rows).orderBy(F.round("link_recall", 12).desc(), "mean_candidates", "budget")
