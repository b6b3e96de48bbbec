"""Query-side blockers: keys of the reference records are met by the target records' keys; both sides are exploded and joined once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import text as X
from kindred.operators import index as I
from kindred.operators import ranking as R
from kindred.plans.presets import ALL, LexicalConfig, MultiPassConfig
from kindred.sources.store import stored


def _keys(df: DataFrame, name: str, kinds: dict[str, Column], *keep: str) -> DataFrame:
    """(name, country, kind, value) from arrays of values, and the columns to keep."""

    def of(kind: str, values: Column) -> Column:
        return F.transform(values, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value")))

    each = F.concat(*[of(k, v) for k, v in kinds.items()])
    return df.select(F.col("entity_id").alias(name), "country", *keep, F.explode(each).alias("k")).select(name, "country", "k.kind", "k.value", *keep).filter("value <> ''")


def _frequent(keys: DataFrame, caps: dict[str, int], many: Column | None = None) -> DataFrame:
    """keys of the reference records without those that too many of them have (many: how these are counted); kinds without a cap stay."""
    cap = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n)) for k, n in caps.items()])
    df = keys.groupBy("country", "kind", "value").agg((F.count("*") if many is None else many).alias("df"))
    return keys.join(df.filter((F.col("df") <= cap) | cap.isNull()), ["country", "kind", "value"]).drop("df")


def query_df(queries: DataFrame) -> DataFrame:
    """(country, kind, token, df) of names, addresses, numbers and 4-grams of represented reference records."""
    kinds = {"name": F.col("name.uniq"), "address": F.col("address.uniq"), "numeric": F.col("address.digits"), "char": X.ngrams(F.col("name.norm"), 4, True)}
    return _keys(queries, "s1", kinds).groupBy("country", "kind", F.col("value").alias("token")).agg(F.count("*").alias("df"))


def _long(words: Column, n: int) -> Column:
    return F.filter(words, lambda t: F.length(t) >= n)


def _with_texts(pairs: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    side = lambda df, key, p: df.select(F.col("entity_id").alias(key), F.col("name").alias(f"{p}n"), F.col("address").alias(f"{p}a"))
    return pairs.join(side(queries, "s1", "q"), "s1").join(side(targets, "target", "t"), "target")


def _sides(found: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    q = queries.select(F.col("entity_id").alias("s1"), F.col("country").alias("query_country"), F.col("name").alias("qn"), F.col("address").alias("qa"))
    t = targets.select(F.col("entity_id").alias("target"), "source", "country", F.col("name").alias("tn"), F.col("address").alias("ta"))
    both = found.join(q, "s1").join(t, "target")
    return both.withColumns({
        "shared_name": X.shared(F.col("qn.uniq"), F.col("tn.uniq")), "shared_address": X.shared(F.col("qa.uniq"), F.col("ta.uniq")), "shared_digits": X.shared(F.col("qa.digits"), F.col("ta.digits")),
        "exact_name": (F.col("qn.norm") != "") & (F.col("qn.norm") == F.col("tn.norm")), "exact_address": (F.col("qa.norm") != "") & (F.col("qa.norm") == F.col("ta.norm")),
    }).drop("query_country")


def _first_copies(targets: DataFrame, n: int) -> DataFrame:
    """targets without those that n others with equal texts, source and country and smaller ids come before: every reference record scores copies alike and prefers the smaller id, so these are never among its best n."""
    t = targets.withColumns({"_n": F.col("name.norm"), "_a": F.col("address.norm")})
    return R.top(t, n, ["source", "country", "_n", "_a"], F.col("entity_id")).drop("_n", "_a")


def lexical(queries: DataFrame, targets: DataFrame, c: LexicalConfig | None = None) -> DataFrame:
    """Pairs (s1, source, target) that share an exact name or address or a token that few reference records have, with blocking score and provenance; the best top_k a record and source.

    Reference records of equal texts and country find the same targets, so one of them asks for all; copies among the targets
    beyond the top_k-th stay out. So g copies on both sides make no g * g pairs.
    """
    c = c or LexicalConfig()
    kinds = {"exact_name": F.array("name.norm"), "exact_address": F.array("address.norm"), "name_token": _long(F.col("name.uniq"), c.min_token_length), "address_token": _long(F.col("address.uniq"), c.min_token_length)}
    texts = queries.select("entity_id", "country", F.col("name.norm").alias("n"), F.col("address.norm").alias("a"))
    one = texts.groupBy("country", "n", "a").agg(F.min("entity_id").alias("s1"))
    asked = _frequent(_keys(queries, "s1", kinds), {"name_token": c.max_query_df, "address_token": c.max_query_df}).join(one.select("s1"), "s1", "left_semi")
    found = asked.join(_keys(_first_copies(targets, c.top_k), "target", kinds), ["country", "kind", "value"]).select("s1", "target").distinct()
    p = _sides(found, queries, targets)
    several = (F.col("shared_address") >= 2) | ((F.col("shared_address") >= 1) & (F.col("shared_digits") >= 1))
    p = p.filter(F.col("exact_name") | F.col("exact_address") | (F.col("shared_name") >= 1) | several)
    whys = {"exact_name": F.col("exact_name"), "exact_address": F.col("exact_address"), "rare_name_token": F.col("shared_name") >= 1, "address_tokens": F.col("shared_address") >= 2, "address_number": (F.col("shared_address") >= 1) & (F.col("shared_digits") >= 1)}
    score = 100 * F.col("exact_name").cast("int") + 90 * F.col("exact_address").cast("int") + 20 * F.col("shared_name") + 8 * F.col("shared_address") + 12 * F.col("shared_digits")
    p = p.withColumns({"blocking_score": score.cast("double"), "provenance": F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in whys.items()]))})
    best = R.top(p, c.top_k, ["s1", "source"], F.desc("blocking_score"), F.col("target"))
    copies = texts.join(one.withColumnRenamed("s1", "one"), ["country", "n", "a"]).select("one", F.col("entity_id").alias("own"))
    own = queries.select(F.col("entity_id").alias("own"), F.col("name").alias("qn"), F.col("address").alias("qa"))
    return best.drop("qn", "qa").join(copies, F.col("s1") == F.col("one")).join(own, "own").drop("s1", "one").withColumnRenamed("own", "s1")


def _distinct_texts(records: DataFrame, first: int | None = None) -> DataFrame:
    """(entity_id, source, country, name, address, times, own): records of equal texts, source and country as one, with a number for an id, how many they are and the lists of their ids, in order; first: only so many ids."""
    t = records.select("source", "country", F.col("name.norm").alias("n"), F.col("address.norm").alias("a"), F.col("entity_id").alias("id"))
    one = t.groupBy("source", "country", "n", "a").agg(F.count("*").alias("times"), F.array_sort(F.collect_list("id")).alias("ids"))
    ids = F.col("ids") if first is None else F.slice("ids", 1, first)
    lists = F.transform(F.sequence(F.lit(1), F.size(ids), F.lit(_LIST)), lambda i: F.slice(ids, i, _LIST))
    one = stored(one.select("source", "country", "n", "a", "times", lists.alias("own"), F.monotonically_increasing_id().alias("entity_id")))
    return one.withColumns({"name": X.parts(F.col("n"), F.col("n")), "address": X.parts(F.col("a"), F.col("a"))})


#: Ids of one list; a family of copies has as many lists as it needs.
_LIST = 1_000


def multipass(queries: DataFrame, targets: DataFrame, c: MultiPassConfig | None = None, texts: bool = True) -> DataFrame:
    """Pairs of seven passes with scores and ranks, a pool of at most c.pool a record and source. Weights come from the reference records' own frequencies. texts: with qn, qa, tn and ta.

    Records of equal texts and country meet once, on either side: what a pair scores depends on its texts only, and reference
    records of equal texts have the same pool. Pairs travel as two numbers, then with the target's two normalised texts and
    the list of its copies; the copies of either side are told apart after the last exchange.
    """
    c = c or MultiPassConfig()
    q, t = _distinct_texts(queries), _distinct_texts(targets, c.pool if c.pool < ALL else None)
    gram = lambda: X.ngrams(F.col("name.norm"), 4, True)
    kinds = lambda: {
        "exact_name": F.array("name.norm"), "exact_address": F.array("address.norm"), "name_signature": F.array(F.array_join("name.uniq", " ")),
        "name": _long(F.col("name.uniq"), c.min_name_token_length), "address": _long(F.col("address.uniq"), c.min_address_token_length), "numeric": F.col("address.digits"), "char": gram(),
    }
    asked = _frequent(_keys(q, "s1", kinds(), "times"), {"name": c.max_name_df, "address": c.max_address_df, "numeric": c.max_numeric_df, "char": c.max_char_df}, F.sum("times")).drop("times")
    met = asked.join(_keys(t, "target", kinds()), ["country", "kind", "value"]).groupBy("s1", "target").agg(F.count_if(F.col("kind") == "char").alias("char_hits"), F.count_if(F.col("kind") != "char").alias("other_hits"))
    met = met.filter((F.col("other_hits") > 0) | (F.col("char_hits") >= c.min_shared_grams))

    words = _keys(q, "s1", {"name": F.col("name.uniq"), "address": F.col("address.uniq")}, "times")
    df = words.groupBy("country", "kind", "value").agg(F.sum("times").alias("df"))
    population = q.groupBy("country").agg(F.sum("times").alias("population"))
    pick = lambda f: F.array_sort(F.collect_list(F.when(F.col("kind") == f, F.struct("value", "idf"))))
    weights = words.join(df, ["country", "kind", "value"]).join(population, "country").withColumn("idf", I.idf(F.col("df"), F.col("population"))).groupBy("s1").agg(pick("name").alias("wn"), pick("address").alias("wa"))

    there = t.select(F.col("entity_id").alias("target"), "source", "country", F.col("n").alias("tn"), F.col("a").alias("ta"), F.explode("own").alias("found"))
    asking = q.select(F.col("entity_id").alias("s1"), F.col("n").alias("qn"), F.col("a").alias("qa"), gram().alias("qg")).join(weights, "s1", "left")
    asking = asking.withColumns({f"{w}_all": F.aggregate(w, F.lit(0.0), lambda s, e: s + e["idf"]) for w in ("wn", "wa")})
    known = lambda w, words: F.aggregate(w, F.lit(0.0), lambda s, e: s + F.when(F.array_contains(words, e["value"]), e["idf"]).otherwise(0.0))
    part = lambda w, words: F.when(F.col(f"{w}_all") > 0, known(w, words) / F.col(f"{w}_all")).otherwise(0.0)
    p = met.join(there, "target").join(asking, "s1").drop("target")
    p = p.withColumns({f"{x}u": X.unique(X.tokens(F.col(x))) for x in ("qn", "qa", "tn", "ta")}).withColumns({"qd": X.digits(F.col("qau")), "td": X.digits(F.col("tau")), "tg": X.ngrams(F.col("tn"), 4, True)})
    exact = lambda x: (F.col(f"q{x}") != "") & (F.col(f"q{x}") == F.col(f"t{x}"))
    p = p.withColumns({
        "shared_name": X.shared(F.col("qnu"), F.col("tnu")), "shared_address": X.shared(F.col("qau"), F.col("tau")), "shared_digits": X.shared(F.col("qd"), F.col("td")), "exact_name": exact("n"), "exact_address": exact("a"),
        "name_jaccard": X.jaccard(F.col("qnu"), F.col("tnu")), "address_jaccard": X.jaccard(F.col("qau"), F.col("tau")), "digit_overlap": X.overlap(F.col("qd"), F.col("td")),
        "char_jaccard": X.jaccard(F.col("qg"), F.col("tg")), "name_idf": part("wn", F.col("tnu")), "address_idf": part("wa", F.col("tau")), "_here": F.monotonically_increasing_id(),
    })
    holds = {
        "exact_name": F.col("exact_name"), "exact_address": F.col("exact_address"), "name_signature": (F.size("tnu") > 0) & (F.col("qnu") == F.col("tnu")), "name_token": (F.col("shared_name") > 0) & (F.col("name_idf") > 0),
        "address_token": (F.col("shared_address") >= 2) | (F.col("address_idf") >= 0.25), "numeric_address": F.col("shared_digits") > 0, "char_name": (F.col("char_hits") >= c.min_shared_grams) & (F.col("char_jaccard") >= c.min_char_jaccard),
    }
    some = F.lit(False)
    for h in holds.values():
        some = some | h
    some = some & (F.col("_here") >= 0)  # else the filter is pushed below the measures and makes each of them again wherever it names one
    p = R.summarised(p.filter(some).withColumns(R.pass_scores(holds))).withColumn("target", F.explode("found"))
    p = p.drop("found", "_here", "wn", "wa", "wn_all", "wa_all", "qd", "td", "qg", "tg", *[f"{x}{u}" for x in ("qn", "qa", "tn", "ta") for u in ("", "u")])
    p = R.ranked(R.pruned(p, c.pool) if c.pool < ALL else p)
    p = p.join(q.select(F.col("entity_id").alias("s1"), F.explode("own").alias("own")), "s1").withColumn("s1", F.explode("own")).drop("own")
    return _with_texts(p, queries, targets) if texts else p
