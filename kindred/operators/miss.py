"""Why true links are missed: kept, cut by a cap, or never found; and what other bounds would have done."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import text as X
from kindred.operators import metrics as M
from kindred.operators.ranking import budgeted, eligible
from kindred.plans.presets import Budget, IndexConfig
from kindred.sources.store import stored

#: The document frequencies of the counterfactuals.
THRESHOLDS = {"name": (60, 125, 250, 500, 1000), "address": (40, 80, 160, 320, 640), "numeric": (250, 500, 1000, 2500, 5000)}


def classified(truth: DataFrame, pool: DataFrame, budget: Budget) -> DataFrame:
    """Every true link with its rank in the pool, its rank among eligible pairs, its passes, and its class: retained, cap_ranking_miss or discovery_miss."""
    order = Window.partitionBy("s1", "source").orderBy(F.desc("best_score"), F.desc("pass_count"), "target")
    ranks = pool.select("s1", "target", "passes", F.row_number().over(order).alias("pool_rank"))
    fit = eligible(pool, budget.caps).select("s1", "target", F.row_number().over(order).alias("eligible_rank"))
    kept = budgeted(pool, budget.caps, budget.total).select("s1", "target").withColumn("kept", F.lit(True))
    x = M.links(truth).join(ranks, ["s1", "target"], "left").join(fit, ["s1", "target"], "left").join(kept, ["s1", "target"], "left")
    kind = F.when(F.col("kept"), "retained").when(F.col("pool_rank").isNotNull(), "cap_ranking_miss").otherwise("discovery_miss")
    return x.withColumn("class", kind).drop("kept")


def summary(classes: DataFrame, records: DataFrame) -> DataFrame:
    """Links by class for all, by country, by source and by both, by grouping sets."""
    x = classes.join(records.select(F.col("entity_id").alias("s1"), "country"), "s1").withColumn("source", F.substring("target", 1, 2))
    x.createOrReplaceTempView("_kindred_miss")
    return x.sparkSession.sql("SELECT country, source, count(*) AS links, count_if(class = 'retained') AS retained, count_if(class = 'cap_ranking_miss') AS cap_ranking_miss, count_if(class = 'discovery_miss') AS discovery_miss FROM _kindred_miss GROUP BY GROUPING SETS ((), (country), (source), (country, source))")


def cap_counterfactual(truth: DataFrame, pool: DataFrame, caps: dict[str, int], totals: tuple[int, ...] = (10, 20, 40, 60, 80, 120)) -> DataFrame:
    """Links kept by total caps on the eligible pairs and on the whole pool: (mode, total, kept_links)."""
    order = Window.partitionBy("s1", "source").orderBy(F.desc("best_score"), F.desc("pass_count"), "target")
    t = M.links(truth)
    rows = []
    for mode, pairs in (("eligible", eligible(pool, caps)), ("pool", pool)):
        ranks = pairs.select("s1", "target", F.row_number().over(order).alias("k")).join(t, ["s1", "target"], "left_semi")
        kept = [F.count_if(F.col("k") <= n).alias(str(n)) for n in totals]
        rows.append(ranks.agg(*kept).unpivot([], [str(n) for n in totals], "total", "kept_links").withColumn("mode", F.lit(mode)))
    return reduce(DataFrame.unionByName, rows).select("mode", F.col("total").cast("int").alias("total"), "kept_links")


def discovery(found: DataFrame, queries: DataFrame, records: DataFrame, token_df: DataFrame, config: IndexConfig) -> DataFrame:
    """For links (s1, target): equality of texts, shared tokens and the rarest one's frequency, and, for each frequency bound, whether a shared token is eligible (the link could be met) and among the query's chosen ones (it would be).

    Frequencies and the order of a query's own tokens, in its country and the target's source, are made once for queries of
    equal texts; pairs of equal texts are compared once, and links carry ids only.
    """
    bounds = {"name": (config.min_name_token_length, config.name_query_terms, config.max_name_token_df), "address": (config.min_address_token_length, config.address_query_terms, config.max_address_token_df), "numeric": (1, config.numeric_query_terms, config.max_numeric_token_df)}
    parts = lambda x: [F.col("name.norm").alias(f"{x}n"), F.col("address.norm").alias(f"{x}a"), F.col("name.uniq").alias(f"{x}_name"), F.col("address.uniq").alias(f"{x}_address"), F.col("address.digits").alias(f"{x}_numeric")]
    q = queries.select(F.col("entity_id").alias("s1"), "country", *parts("q"))
    t = records.select(F.col("entity_id").alias("target"), "source", F.col("country").alias("target_country"), *parts("t"))

    def classes(df: DataFrame, name: str, own: str, key: list[str]) -> tuple[DataFrame, DataFrame]:
        """(name, own) of the rows, own being the smallest id of those with equal texts; and one row for each."""
        one = df.groupBy(*key).agg(F.min(name).alias(own), *[F.first(c).alias(c) for c in df.columns if c not in (name, *key)])
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key])
        return df.join(one.select(*[F.col(k).alias(f"_{k}") for k in key], own), same).select(name, own), one

    own_q, one_q = classes(q, "s1", "q", ["country", "qn", "qa"])
    own_t, one_t = classes(t, "target", "t", ["source", "target_country", "tn", "ta"])
    links = stored(found.select("s1", "target").join(own_q, "s1").join(own_t, "target"))

    role = lambda name: F.transform(f"q_{name}", lambda x: F.struct(F.lit(name).alias("role"), x.alias("token")))
    e = one_q.select("q", "country", F.explode(F.concat(*map(role, bounds))).alias("r")).select("q", "country", "r.*").withColumn("field", F.when(F.col("role") == "name", "name").otherwise("address"))
    e = e.crossJoin(records.select("source").distinct()).join(token_df, ["source", "country", "field", "token"], "left").fillna(0, ["df"])
    shortest = F.when(F.col("role") == "name", bounds["name"][0]).when(F.col("role") == "address", bounds["address"][0]).otherwise(1)
    late = ((F.col("df") == 0) | (F.length("token") < shortest)).alias("late")  # not usable: after the others
    ordered = lambda name: F.array_sort(F.collect_list(F.when(F.col("role") == name, F.struct(late, "df", "token"))))
    numbered = lambda name: F.transform(name, lambda x, i: F.struct(x["token"].alias("token"), x["df"].alias("df"), F.when(~x["late"], i + 1).alias("k"))).alias(name)
    terms = e.groupBy("q", "source").agg(*[ordered(n).alias(n) for n in bounds]).select("q", "source", *map(numbered, bounds))

    p = links.select("q", "t").distinct().join(one_q, "q").join(one_t, "t").join(terms, ["q", "source"], "left")
    none = F.expr("CAST(array() AS array<struct<token: string, df: bigint, k: int>>)")
    p = p.withColumns({n: F.coalesce(F.filter(n, lambda x: F.array_contains(f"t_{n}", x["token"])), none) for n in bounds})  # shared ones
    p = p.withColumns({
        "country_equal": F.col("country") == F.col("target_country"), "name_equal": (F.col("qn") != "") & (F.col("qn") == F.col("tn")), "address_equal": (F.col("qa") != "") & (F.col("qa") == F.col("ta")),
        "signature_equal": (F.size("q_name") > 0) & (F.col("q_name") == F.col("t_name")), "name_jaccard": X.jaccard(F.col("q_name"), F.col("t_name")), "address_jaccard": X.jaccard(F.col("q_address"), F.col("t_address")), "numeric_overlap": X.overlap(F.col("q_numeric"), F.col("t_numeric")),
    })
    outs: list[Column] = []
    for name, (_, limit, current) in bounds.items():
        outs += [F.size(name).cast("long").alias(f"shared_{name}"), F.array_min(F.transform(name, lambda x: x["df"])).alias(f"min_{name}_df")]
        for bound in dict.fromkeys((current, *THRESHOLDS[name])):
            first = F.array_min(F.transform(F.filter(name, lambda x: x["k"].isNotNull() & (x["df"] <= bound)), lambda x: x["k"]))
            here = F.coalesce(F.col("country_equal"), F.lit(False))
            outs += [(here & first.isNotNull()).alias(f"{name}_{bound}_eligible"), (here & F.coalesce(first <= limit, F.lit(False))).alias(f"{name}_{bound}_retrievable")]
    kept = ["country_equal", "name_equal", "address_equal", "signature_equal", "name_jaccard", "address_jaccard", "numeric_overlap"]
    per = stored(p.select("q", "t", *kept, *outs))
    return links.join(per, ["q", "t"]).drop("q", "t").select("s1", "target", *per.columns[2:])


def intersection_reasons(found: DataFrame, terms: DataFrame, records: DataFrame, probed: DataFrame, hits: DataFrame, config: IndexConfig) -> DataFrame:
    """For links (s1, target), why intersections of shared terms (legacy order) did not find them; a link has all reasons that its pairs of shared terms give. terms: of the queries, usable ones; hits: (source, country, lf, lt, rf, rt, hits)."""
    if config.intersection_scheduler != "legacy":
        raise ValueError("the reasons describe the legacy order")
    rows = lambda *names: F.array_sort(F.collect_list(F.struct(*names)))
    ranked = terms.withColumn("i", F.row_number().over(Window.partitionBy("s1", "source").orderBy("df", "field", "token")))
    own = ranked.groupBy("s1", "source").agg(rows("i", "field", "token", "df").alias("terms"))
    key = ["source", "country", "lf", "lt", "rf", "rt"]
    tried = probed.select("s1", *key).join(hits.select(*key, "hits").dropDuplicates(key), key, "left").groupBy("s1", "source").agg(rows("lf", "lt", "rf", "rt", "hits").alias("tried"))

    def reason(x: Column, y: Column) -> Column:
        same = F.filter("tried", lambda p: (p["lf"] == x["field"]) & (p["lt"] == x["token"]) & (p["rf"] == y["field"]) & (p["rt"] == y["token"]))
        return F.when(x["df"] > config.intersection_anchor_df, "anchor_df_exceeded").when(F.coalesce(F.size(same), F.lit(0)) <= 0, "pair_budget_exceeded").when(F.get(same, F.lit(0))["hits"] > config.max_intersection_hits, "intersection_overflow").otherwise("other_unresolved")

    def cells(first: Column) -> Column:
        """Of each pair of a query's terms within the limit: their places and the reason."""
        return F.flatten(F.transform(first, lambda x: F.transform(F.filter(first, lambda y: y["i"] > x["i"]), lambda y: F.struct(x["i"].alias("l"), y["i"].alias("r"), reason(x, y).alias("reason")))))

    own = own.join(tried, ["s1", "source"], "left").withColumn("first", F.filter("terms", lambda x: x["i"] <= config.intersection_terms))
    own = stored(own.select("s1", "source", "terms", cells(F.col("first")).alias("cells")))
    t = records.select(F.col("entity_id").alias("target"), "source", F.col("name.uniq").alias("tn"), F.col("address.uniq").alias("ta"))
    x = found.select("s1", "target").join(t, "target", "left").join(own, ["s1", "source"], "left")
    there = F.filter("terms", lambda x: F.when(x["field"] == "name", F.array_contains("tn", x["token"])).otherwise(F.array_contains("ta", x["token"])))
    x = x.withColumn("at", F.transform(there, lambda x: x["i"]))
    met = F.transform(F.filter("cells", lambda c: F.array_contains("at", c["l"]) & F.array_contains("at", c["r"])), lambda c: c["reason"])
    omitted = F.when((F.size("at") > 1) & (F.array_max("at") > config.intersection_terms), F.array(F.lit("term_omitted"))).otherwise(X.no_words())
    reasons = F.array_sort(F.array_distinct(F.concat(met, omitted)))
    return x.select("s1", "target", F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("no_usable_combination"))).alias("reasons"))
