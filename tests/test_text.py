"""Hand-checked values of the text functions."""

import pytest
from pyspark.sql import functions as F

from kindred.functions import fuzzy
from kindred.functions import text as X


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("raw, expected", [("  ACME, Inc.\t１２３  ", "acme inc 123"), ("राम-मार्केटिंग Pvt. Ltd.", "राम मार्केटिंग pvt ltd"), ("12-A Main Rd.", "12 a main rd"), ("a+b $c", "a+b $c"), ("Straße", "strasse"), (None, ""), ("", "")])
def test_normalize(spark, raw, expected):
    assert one(spark, raw, X.normalize) == expected


@pytest.mark.parametrize("raw, expected", [("Société Électricité", "societe electricite"), ("श्री राम", "sri ram"), ("https://www.Acme.com/Widgets", "acme widgets"), ("Bâtiment12 Rue", "batiment 12 rue")])
def test_secondary(spark, raw, expected):
    assert one(spark, raw, X.secondary) == expected


@pytest.mark.parametrize("raw, expected", [("Acme Société Anonyme SA", "acme"), ("Acme GmbH", "acme"), ("Bank of India", "bank of india"), ("Holdings Ltd", "holdings ltd")])
def test_core_name(spark, raw, expected):
    assert one(spark, raw, lambda c: X.core_name(X.secondary(c))) == expected


def test_digits_and_postal(spark):
    row = X.represented(spark.createDataFrame([("S1-1", "x", "ZIP 75001 / 42", "US")], "entity_id string, business_name string, business_address string, country string")).first()
    assert (row["address"]["digits"], row["address"]["postal"]) == (["42", "75001"], ["75001"])


def test_numbers(spark):
    rows = X.enhanced(spark.createDataFrame([("00012 Baker St",), ("SW1A London",)], "business_address string").withColumn("business_name", F.lit(""))).collect()
    assert rows[0]["address2"]["primary"] == "12" and rows[1]["address2"]["postal"] == ["sw1a"]


def test_grams_of_short_texts(spark):
    assert [one(spark, v, lambda c: F.size(X.ngrams(c, 4, True))) for v in ("", "abc", "ab cd", "abcde")] == [0, 1, 1, 2]
    assert [one(spark, v, lambda c: F.size(X.ngrams(c, 3, False))) for v in ("", "ab", "abc", "abab")] == [0, 0, 1, 2]


def test_fuzzy():
    assert fuzzy.ratio("abcd", "abxd") == 75.0 and fuzzy.ratio("", "a") == 0.0
    assert fuzzy.token_sort("b a", "a b") == 100.0
    assert fuzzy.token_set("acme trading llc", "acme trading") == 100.0 and 0 < fuzzy.token_set("acme one", "acme two") < 100
    assert round(fuzzy.jaro_winkler("dwayne", "duane"), 2) == 0.84


def test_common_subsequence_by_brute_force():
    import random

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choices("abc", k=r.randint(0, 12))) for _ in range(2))
        assert fuzzy._common(a, b) == slow(a, b)


def test_measures_of_many_pairs():
    """To the bit those of one pair at a time: short and long texts, letters beyond the basic plane, empty sides, chunks of a few pairs."""
    import random

    r = random.Random(2)
    text = lambda letters, most: "".join(r.choices(letters, k=r.randint(0, most)))
    for letters, most in (("ab ", 12), ("abcdefgh  é日𝒳", 70), ("abc  ", 140), ("ab ", 300)):
        a, b = [[text(letters, most) for _ in range(60)] for _ in range(2)]
        a, b = [*a, *a[:30], "", "a", "", "b a"], [*b, *(x[: len(x) // 2] + "a" + x[len(x) // 2 + 1 :] for x in a[:30]), "", "", "a", "a b"]
        for name, one in fuzzy.MEASURES.items():
            assert list(fuzzy.OF_ALL[name](a, b)) == [one(x, y) for x, y in zip(a, b)], (name, letters)


def test_pairs_in_two_places_are_measured_once(spark, monkeypatch):
    """A name without a legal form is its own core, so both have the same pair."""
    asked = []
    monkeypatch.setitem(fuzzy.OF_ALL, "ratio", lambda a, b: asked.append(len(a)) or fuzzy.ratio_all(a, b))
    seen = {}
    monkeypatch.setattr(F, "pandas_udf", lambda f, *_: lambda *columns: seen.setdefault("f", f))
    fuzzy.similarities({"name": (F.col("a"), F.col("b"), "ratio"), "core": (F.col("a"), F.col("b"), "ratio")})
    import pandas as pd

    x, y = pd.Series(["acme", "acme", "beta", None]), pd.Series(["acne", "acne", "bet", "x"])
    out = seen["f"](x, y, x, y)
    assert asked == [3] and out["name_ratio"].tolist() == out["core_ratio"].tolist() == [75.0, 75.0, fuzzy.ratio("beta", "bet"), 0.0]


def test_grams_and_words_of_a_pair_are_made_once(spark):
    """Expressions that several features read are columns of their own below them in the plan."""
    from kindred.operators import retrieve

    row = [(*["Acme One"] * 4, *["acme one"] * 4)]
    names = [f"_{t}_{form}" for form in ("raw", "norm") for t in retrieve.TEXTS]
    p = retrieve.expanded(spark.createDataFrame(row, names)).select(X.jaccard(F.col("qn.uniq"), F.col("tn.uniq")).alias("j"), X.overlap(F.col("qn.uniq"), F.col("tn.uniq")).alias("o"), F.size("qn.uniq").alias("n"))
    plan = p._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array") == 2 and p.first()[:] == (1.0, 1.0, 2)
