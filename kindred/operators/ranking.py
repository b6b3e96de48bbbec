"""Per-pass scores, ranks and budgets of candidate pairs, shared by all blockers. Every ranking has a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PASSES = ("exact_name", "exact_address", "name_signature", "name_token", "address_token", "numeric_address", "char_name")


def pass_scores(holds: dict[str, Column]) -> dict[str, Column]:
    """The score of each pass that holds for a pair, else 0. The pair has name_jaccard, address_jaccard, digit_overlap, name_idf, address_idf, char_jaccard."""
    n, a, d = F.col("name_jaccard"), F.col("address_jaccard"), F.col("digit_overlap")
    score = {
        "exact_name": 100 + 30 * a + 10 * d,
        "exact_address": 100 + 30 * n,
        "name_signature": 105 + 20 * a,
        "name_token": 100 * F.col("name_idf") + 20 * n,
        "address_token": 100 * F.col("address_idf") + 20 * a + 20 * d,
        "numeric_address": 80 * d + 20 * n + 20 * a,
        "char_name": 100 * F.col("char_jaccard") + 20 * n,
    }
    return {f"{p}_score": F.when(holds[p], score[p].cast("double")).otherwise(0.0) if p in holds else F.lit(0.0) for p in PASSES}


def summarised(pairs: DataFrame) -> DataFrame:
    """pairs with pass_count, best_score and second_score of their pass scores."""
    scores = [F.col(f"{p}_score") for p in PASSES]
    return pairs.withColumns({"pass_count": sum(((s > 0).cast("int") for s in scores), F.lit(0)), "best_score": F.greatest(*scores), "second_score": F.element_at(F.sort_array(F.array(*scores), False), 2)})


def ranked(pairs: DataFrame) -> DataFrame:
    """pairs with a rank for each pass within (s1, source): score falling, then target; 0 where the pass does not hold. All windows share one exchange."""
    by = lambda p: Window.partitionBy("s1", "source").orderBy(F.when(F.col(f"{p}_score") > 0, F.col(f"{p}_score")).desc_nulls_last(), "target")
    return pairs.withColumns({f"{p}_rank": F.when(F.col(f"{p}_score") > 0, F.row_number().over(by(p))).otherwise(0) for p in PASSES})


def top(pairs: DataFrame, n: int, by: list[str], *order: Column) -> DataFrame:
    """The first n rows of each group. Plans as a group limit before and after the exchange."""
    return pairs.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_k") <= n).drop("_k")


def pruned(pairs: DataFrame, n: int) -> DataFrame:
    """A pool of n a record and source: best score, number of passes, target."""
    return top(pairs, n, ["s1", "source"], F.desc("best_score"), F.desc("pass_count"), F.col("target"))


def eligible(pairs: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Pairs that some pass ranks within its cap."""
    ok = F.lit(False)
    for p, cap in caps.items():
        ok = ok | ((F.col(f"{p}_rank") > 0) & (F.col(f"{p}_rank") <= cap))
    return pairs.filter(ok)


def budgeted(pairs: DataFrame, caps: dict[str, int], total: int | None, with_passes: bool = True) -> DataFrame:
    """Eligible pairs, at most `total` a record and source. with_passes: equal scores go by the number of passes before the target."""
    found = eligible(pairs, caps)
    if total is None:
        return found
    order = [F.desc("best_score"), *([F.desc("pass_count")] if with_passes else []), F.col("target")]
    return top(found, total, ["s1", "source"], *order)


def score_ranks(pairs: DataFrame, score: str = "score") -> DataFrame:
    """pairs with rank within s1 and source_rank within (s1, source), by falling score, then target."""
    order = (F.desc(score), F.col("target"))
    return pairs.withColumns({"rank": F.row_number().over(Window.partitionBy("s1").orderBy(*order)), "source_rank": F.row_number().over(Window.partitionBy("s1", "source").orderBy(*order))})


def exclusive(claims: DataFrame, score: str = "score") -> DataFrame:
    """One owner for each target: the highest score, then the smallest s1."""
    return top(claims, 1, ["target"], F.desc(score), F.col("s1"))


def shard(df: DataFrame, order: str, shards: int) -> DataFrame:
    """Round-robin shard numbers in the given order; df has `position`."""
    return df.withColumn("shard", F.pmod(F.col(order), F.lit(shards)))
