"""Profiles of sources, truth and outputs: a few exact aggregates each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("entity_id", "business_name", "business_address", "country")


def source_counts(records: DataFrame) -> DataFrame:
    """Per source: rows, rows with each field missing (blank), ids without their prefix."""
    missing = [F.count_if(F.trim(c) == "").alias(f"missing_{c}") for c in FIELDS]
    return records.groupBy("source").agg(F.count("*").alias("n_rows"), *missing, F.count_if(~F.col("entity_id").startswith(F.concat("source", F.lit("-")))).alias("wrong_prefix"))


def country_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("source", "country").agg(F.count("*").alias("n_rows"))


def duplicates(records: DataFrame, *columns: str) -> DataFrame:
    """Exact repeats of the columns' values together, by source: distinct values, values that repeat, rows in them, rows beyond the first."""
    groups = records.groupBy("source", *columns).agg(F.count("*").alias("n"))
    many = F.col("n") > 1
    return groups.groupBy("source").agg(F.count("*").alias("n_distinct"), F.count_if(many).alias("repeated"), F.sum(F.when(many, F.col("n")).otherwise(0)).alias("rows_in_repeated"), F.sum(F.col("n") - 1).alias("excess"))


def lengths(records: DataFrame, column: str) -> DataFrame:
    """Lengths of non-blank values by source: number, mean, least, nearest-rank percentiles, greatest."""
    x = records.filter(F.trim(column) != "").withColumn("len", F.length(column))
    ranks = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY len)").cast("int").alias(f"p{round(100 * p)}") for p in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)]
    return x.groupBy("source").agg(F.count("*").alias("n"), F.avg("len").alias("mean_len"), F.min("len").alias("min_len"), *ranks, F.max("len").alias("max_len"))


def match_counts(truth: DataFrame) -> DataFrame:
    return truth.groupBy(F.size("targets").alias("matches")).agg(F.count("*").alias("entities"))


def coverage(truth: DataFrame) -> DataFrame:
    """Records by where their matches lie."""
    has = lambda s: F.exists("targets", lambda t: t.startswith(f"{s}-"))
    kind = F.when(F.size("targets") == 0, "singleton").when(has("S2") & has("S3"), "both").when(has("S2"), "S2 only").otherwise("S3 only")
    return truth.groupBy(kind.alias("kind")).agg(F.count("*").alias("entities"), F.sum(F.size("targets")).alias("links"))


def links_by_source(truth: DataFrame) -> DataFrame:
    t = truth.select(F.explode("targets").alias("target"))
    return t.groupBy(F.substring("target", 1, 2).alias("source")).agg(F.count("*").alias("links"), F.count_distinct("target").alias("targets"))


def country_shift(records: DataFrame) -> DataFrame:
    """records with `split` (train, test): rows and shares of each country by source and over all sources, the change in percentage points, and whether only test has it."""
    every = records.select("split", "source", "country").unionByName(records.select("split", F.lit("ALL").alias("source"), "country"))
    n = every.groupBy("source", "country").pivot("split", ["train", "test"]).agg(F.count(F.lit(1))).fillna(0, ["train", "test"])
    w = Window.partitionBy("source")
    share = lambda s: F.coalesce(F.try_divide(F.col(s).cast("double"), F.sum(s).over(w).cast("double")), F.lit(0.0))
    n = n.withColumns({"train_share": share("train"), "test_share": share("test")})
    return n.withColumns({"change_points": 100 * (F.col("test_share") - F.col("train_share")), "test_only": (F.col("train") == 0) & (F.col("test") > 0)})


def link_countries(truth: DataFrame, records: DataFrame) -> DataFrame:
    """One row: links, links whose target is unknown, links across countries."""
    side = lambda k: records.select(F.col("entity_id").alias(k), F.col("country").alias(f"{k}_country"))
    x = truth.select("s1", F.explode("targets").alias("target")).join(side("s1"), "s1", "left").join(side("target"), "target", "left")
    return x.agg(F.count("*").alias("links"), F.count_if(F.col("target_country").isNull()).alias("missing_targets"), F.count_if(F.col("target_country") != F.col("s1_country")).alias("across_countries"))


def integrity(truth: DataFrame, records: DataFrame) -> DataFrame:
    """One row: truth without a record, reference records without truth, targets without a record."""
    s1 = records.filter("source = 'S1'").select(F.col("entity_id").alias("s1"))
    targets = truth.select(F.explode("targets").alias("entity_id")).distinct()
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(truth.join(s1, "s1", "left_anti"), "truth_without_record").join(n(s1.join(truth, "s1", "left_anti"), "record_without_truth")).join(n(targets.join(records, "entity_id", "left_anti"), "unknown_targets"))


def profile(pairs: DataFrame, metrics: list[str]) -> DataFrame:
    """Quantiles (linear) and means of measures of positive pairs for all, by source, by country and by both, by grouping sets: (source, country, metric, n, mean, q10 … q90); a null stands for all."""
    long = pairs.select("source", "country", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")).select("source", "country", "m.metric", "m.value")
    long.createOrReplaceTempView("_kindred_profile")
    q = ", ".join(f"percentile(value, {p / 100}) AS q{p}" for p in (1, 5, 10, 25, 50, 75, 90, 95, 99))
    return long.sparkSession.sql(f"SELECT source, country, metric, count(*) AS n, avg(value) AS mean, {q} FROM _kindred_profile GROUP BY metric, source, country GROUPING SETS ((metric), (metric, source), (metric, country), (metric, source, country))")


def output_audit(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row over (s1, targets) tables: rows, linked records, links, candidate links, records in one table only, matches that are no candidates."""
    both = matches.select("s1", F.col("targets").alias("m")).join(candidates.select("s1", F.col("targets").alias("c")), "s1", "full")
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return both.agg(
        F.count("*").alias("n_rows"), F.count_if(size("m") > 0).alias("linked"), F.sum(size("m")).alias("links"), F.sum(size("c")).alias("candidate_links"),
        F.count_if(F.col("m").isNull() | F.col("c").isNull()).alias("one_sided"), F.count_if(size(F.array_except("m", "c")) > 0).alias("not_subset"),
    )


def throughput(shards: DataFrame) -> DataFrame:
    """shards (shard, n, seconds): each one's rate and the whole's, as shard -1."""
    whole = shards.agg(F.lit(-1).cast("bigint").alias("shard"), F.sum("n").alias("n"), F.max("seconds").alias("seconds"))
    return reduce(DataFrame.unionByName, [shards.select(F.col("shard").cast("bigint"), "n", "seconds"), whole]).withColumn("per_second", F.try_divide(F.col("n").cast("double"), F.col("seconds")))
