import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kindred.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, words string"
TEXTS = ["", None, "one", "a b\tc\x0bd\r\ne", "x " * 500, "line one\nline one\n\n \nline two\nline one", "a b c d e f g h " * 3 + "tail", "##$$ ** && <> | %", "ÄÖ ß 漢字 word\u00a0joined " * 9, " ".join(f"w{i}" for i in range(30_000)), "p q r s t u v w x " + "m n " + "p q r s t u v w x"]


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), repeated, len(covered)


def docs(spark, texts):
    return spark.createDataFrame([(i, t, None if i % 3 else "en", "s", "clash") for i, t in enumerate(texts)], DOC)


def test_counts(spark):
    rows = quality.measures(docs(spark, TEXTS)).collect()
    assert {r["doc_id"]: tuple(r[c] for c in quality.COUNTS) for r in rows} == {i: brute(t) for i, t in enumerate(TEXTS)}
    assert {r["doc_id"]: r["base_failed"] for r in rows} == {i: (b[0] < 20 or 100 * b[4] > 30 * b[0]) for i, b in ((i, brute(t)) for i, t in enumerate(TEXTS))}


@pytest.mark.parametrize("n, alpha, delta", [(50, 0.1, 0.05), (300, 0.02, 0.01), (900, 0.02, 0.001), (0, 0.1, 0.05), (1, 0.9, 0.2), (1000, 0.03, 0.0125)])
def test_exact_binomial_bound(spark, n, alpha, delta):
    df = spark.range(0, n + 1).select(F.col("id").alias("k"), F.lit(n).cast("bigint").alias("n"))
    got = {r["k"]: r["ok"] for r in df.select("k", quality.certified(F.col("k"), F.col("n"), F.lit(alpha), F.lit(delta)).alias("ok")).collect()}
    cdf = 0.0
    for k in range(n + 1):
        cdf += math.comb(n, k) * alpha**k * (1 - alpha) ** (n - k)
        if abs(cdf - delta) > 1e-9 * delta:
            assert got[k] == (n > 0 and k < n * alpha and cdf <= delta)


def labelled(spark):
    good = [" ".join(f"word{i}x{j}" for j in range(30)) for i in range(1200)]
    bad = [" ".join(f"word{i}x{j}%%%" for j in range(30)) for i in range(300)]
    d = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(good + bad)], "doc_id long, text string, lang string, source string")
    return d, spark.createDataFrame([(i, int(i < 1200), 0) for i in range(1500)], "doc_id long, quality int, toxic int")


def test_cutoffs_catch_bad_and_keep_good(spark):
    d, labels = labelled(spark)
    got = quality.judged(d, labels, alpha=0.06)
    assert got.filter("doc_id < 1200 AND NOT kept").count() == 0 and got.filter("doc_id >= 1200 AND kept").count() == 0
    kept = quality.quality_rules(d.withColumn("_x", F.lit(1)), labels)
    assert kept.count() == 1200 and kept.columns == ["doc_id", "text", "lang", "source", "_x"]


def test_few_or_no_labels_certify_nothing(spark):
    d, labels = labelled(spark)
    for some in (labels.limit(0), labels.filter("doc_id >= 1190"), labels.withColumn("quality", F.lit(None).cast("int"))):
        assert quality.judged(d, some).filter("NOT kept").count() == 0


def test_empty(spark):
    d, labels = labelled(spark)
    assert quality.result(d.limit(0), labels).count() == 0 and quality.quality_rules(d.limit(0), labels.limit(0)).count() == 0


def test_plan_has_no_python(spark):
    d, labels = labelled(spark)
    plan = quality.result(d, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_many_labels(spark):
    """A million good documents: the bound is that of the normal approximation, within a few parts in a thousand, in few steps."""
    n, alpha = 1_000_000, 0.03
    sd = math.sqrt(n * alpha * (1 - alpha))
    df = spark.createDataFrame([(int(n * alpha - z * sd), n) for z in (1.5, 1.7, 3.0)], "k bigint, n bigint")
    got = [r[0] for r in df.select(quality.certified(F.col("k"), F.col("n"), F.lit(alpha), F.lit(0.05))).collect()]
    assert got == [False, True, True]


def plain_cutoffs(rows, alpha, delta, loss, tuning):
    """rows: (id, stratum, good, {rule: value}). The choice by loops over documents."""
    strata = {s for i, s, _, _ in rows if not tuning[i]}
    out = {}
    for s in strata:
        mine = [r for r in rows if r[1] == s]
        first, second = [r for r in mine if tuning[r[0]]], [r for r in mine if not tuning[r[0]]]
        good, bad = [r for r in first if r[2]], [r for r in first if not r[2]]
        if not good or not bad:
            continue
        path = []
        for rule, grid in quality.GRIDS.items():
            share = lambda docs, c: sum(r[3][rule] >= c for r in docs) / len(docs)
            gains = [(share(bad, c) - loss * share(good, c), c) for c in grid]
            if max(gains)[0] > 0:
                path += [(share(good, c), -share(bad, c), rule, -c) for g, c in gains if c >= max(gains)[1] and share(bad, c) > 0]
        n = sum(r[2] for r in second)
        chosen = {}
        for _, _, rule, c in sorted(path):
            trial = chosen | {rule: min(-c, chosen.get(rule, math.inf))}
            lost = sum(r[2] and any(r[3][x] >= y for x, y in trial.items()) for r in second)
            if sum(math.comb(n, k) * alpha**k * (1 - alpha) ** (n - k) for k in range(lost + 1)) > delta / len(strata) or lost >= n * alpha:
                break
            chosen = trial
        out |= {(s, rule): c for rule, c in chosen.items()}
    return out


@pytest.mark.parametrize("seed, n", [(1, 1500), (2, 400), (3, 6000)])
def test_cutoffs_equal_brute_force(spark, seed, n):
    import random

    r = random.Random(seed)
    rows = []
    for i in range(n):
        good = int(r.random() < 0.7)
        values = {name: float(r.choice([0.0, *grid[: 3 if good and r.random() < 0.99 else 8]]) if r.random() < (0.03 if good else 0.4) else 0.0) for name, grid in quality.GRIDS.items()}
        rows.append((i, r.choice(["en"] * 6 + ["de", None]), good, values))
    measured = spark.createDataFrame([(i, s, False, *v.values()) for i, s, _, v in rows], "doc_id bigint, stratum string, base_failed boolean, " + ", ".join(f"{x} double" for x in quality.GRIDS))
    labels = spark.createDataFrame([(i, g, 0) for i, _, g, _ in rows] + [(rows[0][0], 1, 0), (None, 0, 0), (10**9, 0, 0)], "doc_id bigint, quality int, toxic int")
    tuning = {r["id"]: r["t"] for r in spark.range(n).select("id", quality.tuning(F.col("id")).alias("t")).collect()}
    got = {(x["stratum"], x["rule"]): x["cutoff"] for x in quality.cutoffs(measured, labels).collect()}
    assert got == plain_cutoffs(rows, 0.05, 0.05, 20.0, tuning)
    assert got or n == 400


def test_null_strata_and_contradictory_labels(spark):
    d, labels = labelled(spark)
    both = labels.unionByName(labels.filter("doc_id < 40").withColumn("quality", F.lit(0)))  # 40 good ones are called bad too
    got = quality.judged(d.withColumn("lang", F.lit(None).cast("string")).unionByName(d.limit(5)), both)
    assert got.count() == 1505 and got.filter("doc_id >= 1200 AND NOT kept").count() == 300 and got.filter("doc_id < 1200 AND NOT kept").count() == 0
