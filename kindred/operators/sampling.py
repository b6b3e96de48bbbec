"""Deterministic splits and samples. Order keys are hashes of ids (`key`), so neither partitions nor input order matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.operators.ranking import top
from kindred.sources.store import numbered


def _ordered(entities: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """entities (columns) with `_k`, each row's number from 1 by key within its stratum, and `_n`, the stratum's rows."""
    sizes = entities.groupBy(*by).agg(F.count("*").alias("_n"))
    return numbered(entities, by, "key", "s1", name="_k", first=1).join(sizes, by).select(*columns, *[c for c in by if c not in columns], "_k", "_n")


def split(entities: DataFrame, fraction: float) -> DataFrame:
    """entities (s1, country, n_true, key) with `validation`: of each stratum (country, has matches) the first round-half-even(n * fraction) by key; of two or more records at least one stays on either side."""
    rows = _ordered(entities.withColumn("_has", F.col("n_true") > 0), ["country", "_has"], entities.columns)
    take = F.bround(F.col("_n") * F.lit(fraction), 0).cast("bigint")
    take = F.when(F.col("_n") >= 2, F.greatest(F.lit(1), F.least(take, F.col("_n") - 1))).otherwise(take)
    return rows.withColumn("validation", F.col("_k") <= take).select(*entities.columns, "validation")


def allocate(groups: DataFrame, size: int, by: list[str]) -> DataFrame:
    """groups (by…, n) with `take`: shares of size by largest remainder, ties by the groups' order. Sums to size exactly."""
    total = groups.agg(F.sum("n").alias("total"))
    g = groups.join(F.broadcast(total)).withColumn("exact", F.lit(float(size)) * F.col("n") / F.col("total")).withColumn("base", F.floor("exact"))
    left = F.lit(size) - F.sum("base").over(Window.partitionBy())
    k = F.row_number().over(Window.orderBy((F.col("exact") - F.col("base")).desc(), *by))
    return g.withColumn("take", F.col("base") + (k <= left).cast("bigint")).drop("total", "exact", "base")


def stratified(entities: DataFrame, size: int, by: list[str]) -> DataFrame:
    """Exactly size rows of entities (…, key): each stratum's share, by key."""
    takes = allocate(entities.groupBy(*by).agg(F.count("*").alias("n")), size, by).drop("n")
    return _ordered(entities, by, entities.columns).join(takes, by).filter("_k <= take").select(*entities.columns)


def excluding(entities: DataFrame, used: DataFrame, size: int) -> DataFrame:
    """A country-quota sample of size among those not in used (s1)."""
    return stratified(entities.join(used.select("s1"), "s1", "left_anti"), size, ["country"])


def first(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first n rows; nested for growing n."""
    return df.orderBy(*order).limit(n)


def training_pairs(pairs: DataFrame, hard: int = 20, easy: int = 3, ceiling: float = 55.0) -> DataFrame:
    """All positives, the hardest negatives of each record (hardness falling, then target falling) and those of the smallest pair keys with hardness up to the ceiling. pairs: s1, target, label, hardness, pair_key; adds `kind`."""
    negative = pairs.filter("label = 0")
    hardest = top(negative, hard, ["s1"], F.desc("hardness"), F.desc("target")).withColumn("kind", F.lit("hard"))
    easiest = top(negative.filter(F.col("hardness") <= ceiling), easy, ["s1"], F.col("pair_key"), F.desc("target")).join(hardest.select("s1", "target"), ["s1", "target"], "left_anti").withColumn("kind", F.lit("easy"))
    return pairs.filter("label = 1").withColumn("kind", F.lit("positive")).unionByName(hardest).unionByName(easiest)


def hardness(rule: Column, best: Column) -> Column:
    """From single-precision values, as the matchers see them."""
    return 0.7 * rule.cast("float").cast("double") + 0.3 * F.least(best.cast("float").cast("double"), F.lit(100.0))


def partitions(entities: DataFrame, evaluation: DataFrame, tune_fraction: float) -> DataFrame:
    """entities with `partition`: evaluation for those in evaluation (s1), and tune or fit for the others."""
    rest = split(entities.join(evaluation.select("s1"), "s1", "left_anti"), tune_fraction).withColumn("partition", F.when(F.col("validation"), "tune").otherwise("fit")).drop("validation")
    return rest.unionByName(entities.join(evaluation.select("s1"), "s1", "left_semi").withColumn("partition", F.lit("evaluation")))


def halves(key: Column) -> Column:
    """0 or 1 by a binary key's last bit."""
    return F.conv(F.substring(F.hex(key), -1, 1), 16, 10).cast("int") % 2
