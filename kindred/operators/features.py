"""Pair features: the 16 of the rule, the 51 of the first learned matcher and 32 more. Everything but the fuzzy ratios is native; those cross to Python once a pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import fuzzy
from kindred.functions import text as X
from kindred.operators.ranking import PASSES

#: The order of the model's input.
LEXICAL = (
    "normalized_name_exact name_ratio name_token_set_ratio name_token_sort_ratio name_token_jaccard name_token_containment shared_name_tokens "
    "name_idf_overlap name_length_ratio name_first_token_agreement name_initials_agreement left_address_missing right_address_missing "
    "normalized_address_exact address_ratio address_token_set_ratio address_token_sort_ratio address_token_jaccard address_token_containment "
    "shared_address_tokens address_idf_overlap address_length_ratio digit_token_overlap left_has_numeric right_has_numeric "
    "exact_numeric_token_agreement postal_like_agreement shared_digit_tokens source_is_s3 country_agreement pass_count best_retrieval_score "
    "second_best_retrieval_score"
).split()
FIRST = (*LEXICAL, *(f"{p}_score" for p in PASSES), *(f"{p}_reciprocal_rank" for p in PASSES), "name_address_similarity_product", "name_high_address_low", "address_high_name_low", "exp001_rule_score")
MORE = tuple(
    (
        "trans_name_exact trans_name_ratio trans_name_token_set trans_name_token_sort trans_name_jw core_name_exact core_name_token_set "
        "core_name_token_sort core_name_jaccard core_name_containment core_name_char3 significant_first_token_similarity "
        "significant_first_token_conflict trans_name_length_ratio legal_suffix_only_difference trans_address_ratio trans_address_token_set "
        "trans_address_token_sort trans_address_jw trans_address_char3 numeric_token_overlap numeric_token_containment numeric_sets_disjoint "
        "primary_number_exact primary_number_mismatch primary_number_log_difference secondary_postal_like_agreement postal_like_conflict "
        "core_name_primary_conflict high_name_numeric_conflict left_address_missing_x_name right_address_missing_x_name"
    ).split()
)
ALL = FIRST + MORE
RULE = (
    "raw_name_exact normalized_name_exact raw_address_exact normalized_address_exact name_ratio name_token_set_ratio name_token_sort_ratio "
    "address_ratio address_token_set_ratio address_token_sort_ratio name_token_jaccard address_token_jaccard digit_token_overlap "
    "postal_like_agreement left_address_missing right_address_missing"
).split()
#: What each measure adds to the rule's score.
WEIGHTS = {
    "name_ratio": 0.36, "name_token_set_ratio": 0.24, "name_token_sort_ratio": 0.08, "address_ratio": 0.12, "address_token_set_ratio": 0.12, "address_token_sort_ratio": 0.04,
    "name_token_jaccard": 8.0, "address_token_jaccard": 5.0, "digit_token_overlap": 3.0, "postal_like_agreement": 2.0, "normalized_name_exact": 8.0, "normalized_address_exact": 7.0,
}


def _num(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def _equal(a: Column, b: Column, empty: Column | str = "") -> Column:
    return _num((a != empty) & (a == b))


def with_rule(pairs: DataFrame) -> DataFrame:
    """pairs (qn, qa, tn, ta: represented texts) with the 16 lexical measures of the rule and exp001_rule_score."""
    c = F.col
    ratios = fuzzy.similarities({"name": (c("qn.norm"), c("tn.norm"), "ratio,set,sort"), "address": (c("qa.norm"), c("ta.norm"), "ratio,set,sort")})
    p = pairs.withColumn("_f", ratios)
    p = p.withColumns({
        "raw_name_exact": _equal(c("qn.raw"), c("tn.raw")), "normalized_name_exact": _equal(c("qn.norm"), c("tn.norm")), "raw_address_exact": _equal(c("qa.raw"), c("ta.raw")), "normalized_address_exact": _equal(c("qa.norm"), c("ta.norm")),
        **{f"{f}_{out}": c(f"_f.{f}_{m}") for f in ("name", "address") for m, out in (("ratio", "ratio"), ("set", "token_set_ratio"), ("sort", "token_sort_ratio"))},
        "name_token_jaccard": X.jaccard(c("qn.uniq"), c("tn.uniq")), "address_token_jaccard": X.jaccard(c("qa.uniq"), c("ta.uniq")), "digit_token_overlap": X.overlap(c("qa.digits"), c("ta.digits")),
        "postal_like_agreement": _num(F.arrays_overlap(c("qa.postal"), c("ta.postal"))), "left_address_missing": _num(c("qa.norm") == ""), "right_address_missing": _num(c("ta.norm") == ""),
    }).drop("_f")
    score = F.lit(0.0)
    for name, w in WEIGHTS.items():
        score = score + w * c(name)
    return p.withColumn("exp001_rule_score", F.round(F.least(F.lit(100.0), score), 6))


def with_first(pairs: DataFrame) -> DataFrame:
    """Retrieved pairs with the 51 features."""
    c = F.col
    p = with_rule(pairs.withColumnRenamed("pass_count", "_passes")).withColumn("pass_count", c("_passes").cast("double")).drop("_passes")
    share = lambda f: c(f"{f}_token_set_ratio") / 100.0
    p = p.withColumns({
        "name_token_containment": X.overlap(c("qn.uniq"), c("tn.uniq")), "shared_name_tokens": c("shared_name").cast("double"), "name_idf_overlap": c("name_idf"), "name_length_ratio": X.length_ratio(c("qn.norm"), c("tn.norm")),
        "name_first_token_agreement": _num(F.get(c("qn.tokens"), F.lit(0)) == F.get(c("tn.tokens"), F.lit(0))), "name_initials_agreement": _equal(X.initials(c("qn.tokens")), X.initials(c("tn.tokens"))),
        "address_token_containment": X.overlap(c("qa.uniq"), c("ta.uniq")), "shared_address_tokens": c("shared_address").cast("double"), "address_idf_overlap": c("address_idf"), "address_length_ratio": X.length_ratio(c("qa.norm"), c("ta.norm")),
        "left_has_numeric": _num(F.size("qa.digits") > 0), "right_has_numeric": _num(F.size("ta.digits") > 0), "exact_numeric_token_agreement": _num((F.size("qa.digits") > 0) & (c("qa.digits") == c("ta.digits"))),
        "shared_digit_tokens": c("shared_digits").cast("double"), "source_is_s3": _num(c("source") == "S3"), "country_agreement": F.lit(1.0), "best_retrieval_score": c("best_score"), "second_best_retrieval_score": c("second_score"),
        **{f"{k}_reciprocal_rank": F.when(c(f"{k}_rank") > 0, 1.0 / c(f"{k}_rank")).otherwise(0.0) for k in PASSES},
        "name_address_similarity_product": share("name") * share("address"), "name_high_address_low": _num((share("name") >= 0.9) & (share("address") < 0.5)), "address_high_name_low": _num((share("address") >= 0.9) & (share("name") < 0.5)),
    })
    return p


def with_more(pairs: DataFrame) -> DataFrame:
    """pairs (qn2, qa2, tn2, ta2: structs of the secondary normalisation) with the 32 further features."""
    c = F.col
    first = lambda s: F.substring_index(c(f"{s}.core"), " ", 1)
    f = fuzzy.similarities({
        "name": (c("qn2.text"), c("tn2.text"), "ratio,set,sort,jw"), "core": (c("qn2.core"), c("tn2.core"), "ratio,set,sort"), "first": (first("qn2"), first("tn2"), "ratio"), "address": (c("qa2.text"), c("ta2.text"), "ratio,set,sort,jw"),
    })
    p = pairs.withColumn("_f", f)
    f = lambda name: c(f"_f.{name}") / 100.0
    grams = lambda text: X.ngrams(c(text), 3, False)
    p = p.withColumns({"_qw": X.unique(X.tokens(c("qn2.core"))), "_tw": X.unique(X.tokens(c("tn2.core"))), "_q3": grams("qn2.core"), "_t3": grams("tn2.core"), "_qa3": grams("qa2.text"), "_ta3": grams("ta2.text")})  # made once a pair
    qw, tw = c("_qw"), c("_tw")
    a, b = c("qa2.numbers"), c("ta2.numbers")
    pa, pb = c("qa2.primary"), c("ta2.primary")
    clash = (pa != "") & (pb != "") & (pa != pb)
    number = lambda x: F.coalesce(F.expr(f"try_cast({x} AS decimal(38,0))").cast("double"), F.expr(f"try_cast({x} AS double)"))
    both = lambda x, y: (F.size(x) > 0) & (F.size(y) > 0)
    return p.withColumns({
        "trans_name_exact": _equal(c("qn2.text"), c("tn2.text")), "trans_name_ratio": f("name_ratio"), "trans_name_token_set": f("name_set"), "trans_name_token_sort": f("name_sort"), "trans_name_jw": c("_f.name_jw"),
        "core_name_exact": _equal(c("qn2.core"), c("tn2.core")), "core_name_token_set": f("core_set"), "core_name_token_sort": f("core_sort"), "core_name_jaccard": X.jaccard(qw, tw), "core_name_containment": X.overlap(qw, tw),
        "core_name_char3": X.jaccard(c("_q3"), c("_t3")), "significant_first_token_similarity": f("first_ratio"),
        "significant_first_token_conflict": _num((first("qn2") != "") & (first("tn2") != "") & (first("qn2") != first("tn2")) & (f("first_ratio") < 0.5)), "trans_name_length_ratio": X.length_ratio(c("qn2.text"), c("tn2.text")),
        "legal_suffix_only_difference": _num((c("qn2.text") != "") & (c("tn2.text") != "") & (c("qn2.text") != c("tn2.text")) & (c("qn2.core") == c("tn2.core"))),
        "trans_address_ratio": f("address_ratio"), "trans_address_token_set": f("address_set"), "trans_address_token_sort": f("address_sort"), "trans_address_jw": c("_f.address_jw"),
        "trans_address_char3": X.jaccard(c("_qa3"), c("_ta3")), "numeric_token_overlap": X.jaccard(a, b), "numeric_token_containment": X.overlap(a, b), "numeric_sets_disjoint": _num(both(a, b) & ~F.arrays_overlap(a, b)),
        "primary_number_exact": _equal(pa, pb), "primary_number_mismatch": _num(clash), "primary_number_log_difference": F.when((pa != "") & (pb != ""), F.log1p(F.abs(number("qa2.primary") - number("ta2.primary")))).otherwise(0.0),
        "secondary_postal_like_agreement": _num(F.arrays_overlap(c("qa2.postal"), c("ta2.postal"))), "postal_like_conflict": _num(both(c("qa2.postal"), c("ta2.postal")) & ~F.arrays_overlap(c("qa2.postal"), c("ta2.postal"))),
        "core_name_primary_conflict": _num((c("qn2.core") != "") & (c("qn2.core") == c("tn2.core")) & clash), "high_name_numeric_conflict": _num((f("core_ratio") >= 0.9) & clash),
        "left_address_missing_x_name": _num(c("qa2.text") == "") * f("core_ratio"), "right_address_missing_x_name": _num(c("ta2.text") == "") * f("core_ratio"),
    }).drop("_f", "_qw", "_tw", "_q3", "_t3", "_qa3", "_ta3")


def with_all(pairs: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """Retrieved pairs with the 83 features. queries and targets: records; their secondary texts are made once a record. Texts join pairs before there are features; pairs with tn2 and ta2 need no join by target."""
    side = lambda df, key, p: X.enhanced(df.select(F.col("entity_id").alias(key), "business_name", "business_address")).select(key, F.col("name2").alias(f"{p}n2"), F.col("address2").alias(f"{p}a2"))
    both = pairs if "tn2" in pairs.columns else pairs.join(side(targets, "target", "t"), "target")
    return with_more(with_first(both.join(side(queries, "s1", "q").hint("merge"), "s1")))


def vectors(pairs: DataFrame, names: tuple[str, ...] = ALL) -> DataFrame:
    """pairs with `features`, an MLlib vector of single-precision values in the given order."""
    from pyspark.ml.functions import array_to_vector

    return pairs.withColumn("features", array_to_vector(F.array(*[F.col(n).cast("float").cast("double") for n in names])))
