"""Hand-checked values of the engine's operators, and sequential models against the set-based ones."""

import random

import pytest
from pyspark.sql import functions as F

from kindred.functions import text as X
from kindred.operators import audit, blocking, decide, features, index, metrics, miss, model, ranking, retrieve, sampling, validate
from kindred.plans import linkage, presets
from kindred.sources import tsv

RECORD = "entity_id string, business_name string, business_address string, country string"
TRUTH = "s1 string, targets array<string>"
LINK = "s1 string, target string"


def records(spark, *rows):
    return spark.createDataFrame(list(rows), RECORD).withColumn("source", F.substring("entity_id", 1, 2))


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_reader_keeps_na_and_empty(spark, tmp_path):
    p = write(tmp_path / "a.tsv", "\t".join(tsv.RECORD), "S2-1\tNA\t\tUS")
    row = tsv.read_source(spark, p, "S2").first()
    assert (row["business_name"], row["business_address"], row["source"]) == ("NA", "", "S2")


def test_reader_rejects(spark, tmp_path):
    with pytest.raises(tsv.DataError):
        tsv.read_source(spark, write(tmp_path / "a.tsv", ",".join(tsv.RECORD), "S2-1,a,b,US"), "S2")
    for bad in ("S3-1\ta\tb\tUS", "S2-1\ta\tb"):
        with pytest.raises(Exception, match="S2-|malformed"):
            tsv.read_source(spark, write(tmp_path / "b.tsv", "\t".join(tsv.RECORD), bad), "S2").collect()


def test_truth(spark, tmp_path):
    good = tsv.read_truth(spark, write(tmp_path / "t.tsv", "\t".join(tsv.TRUTH), "S1-1\t", "S1-2\tS2-9, S3-8"))
    assert {r["s1"]: r["targets"] for r in good.collect()} == {"S1-1": [], "S1-2": ["S2-9", "S3-8"]}
    assert metrics.links(good).count() == 2
    for bad in (["S1-2\tS2-2,S2-2"], ["S1-2\tS2-2", "S1-2\t"], ["S1-2\tX-2"], ["S1-2\tS2-2,,S3-1"]):
        with pytest.raises(Exception):  # noqa: B017
            tsv.read_truth(spark, write(tmp_path / "b.tsv", "\t".join(tsv.TRUTH), *bad)).collect()


@pytest.mark.parametrize("targets, predicted, expected", [(["S2-1", "S3-1"], ["S2-1"], 5 / 6), (["S2-1"], ["S2-1", "S3-9"], 5 / 9), (["S2-1", "S2-2", "S2-3"], ["S2-1", "S2-2", "S3-9"], 2 / 3), ([], [], 1.0), ([], ["S2-1"], 0.0)])
def test_entity_fbeta(spark, targets, predicted, expected):
    t = spark.createDataFrame([("S1-1", targets)], TRUTH)
    p = spark.createDataFrame([("S1-1", x) for x in predicted], LINK)
    assert metrics.entity_metrics(t, p).first()["fbeta"] == pytest.approx(expected)


def test_macro_counts_singletons(spark):
    t = spark.createDataFrame([("S1-1", []), ("S1-2", ["S2-1", "S3-1"])], TRUTH)
    e = metrics.evaluated(metrics.entity_metrics(t, spark.createDataFrame([("S1-2", "S2-1")], LINK))).first()
    assert e["macro_fbeta"] == pytest.approx(11 / 12) and e["correct_singletons"] == 1


def test_blocker_and_matcher_errors_add_up(spark):
    t = spark.createDataFrame([("S1-1", ["S2-a", "S3-a"]), ("S1-2", []), ("S1-3", ["S2-c"])], TRUTH)
    eligible = spark.createDataFrame([("S1-1", "S2-a"), ("S1-1", "S2-x"), ("S1-2", "S2-x")], LINK)
    n = metrics.false_negatives(t, eligible, spark.createDataFrame([], LINK)).first()
    assert (n["blocker_fn"], n["matcher_fn"], n["fn"]) == (2, 1, 3)
    o = metrics.oracle(t, eligible).first()
    assert o["coverage"] == pytest.approx(1 / 3) and o["zero_retained_rate"] == 0.5
    c = metrics.candidate_metrics(t, eligible).first()
    assert c["link_recall"] == pytest.approx(1 / 3) and c["zero_entities"] == 1


def test_lexical_blocker(spark):
    q = X.represented(records(spark, ("S1-1", "Acme LLC", "12 Main Street 75001", "US")))
    rows = [("S2-1", "ACME llc", "other", "US"), ("S2-2", "Other", "Main Street 9", "US"), ("S2-3", "Acme LLC", "12 Main Street 75001", "CA")]
    for order in (rows, rows[::-1]):
        got = blocking.lexical(q, X.represented(records(spark, *order)))
        assert {r["target"] for r in got.collect()} == {"S2-1", "S2-2"}


def test_copies_on_both_sides_make_no_square(spark):
    """40 copies ask, 60 copies are there: each reference record still gets the first five, with its own raw text."""
    q = X.represented(records(spark, *[(f"S1-{i:02}", "Acme  LLC" if i % 2 else "ACME llc", "1 Road", "US") for i in range(40)], ("S1-x", "Acme LLC", "", "US")))
    t = X.represented(records(spark, *[(f"S2-{i:02}", "Acme LLC", "1 Road", "US") for i in range(60)], *[(f"S2-y{i}", "Acme LLC", "", "US") for i in range(9)]))
    got = blocking.lexical(q, t, presets.LexicalConfig(top_k=5)).select("s1", "target", "qn.raw").collect()
    for e in [f"S1-{i:02}" for i in range(40)]:
        assert sorted(r["target"] for r in got if r["s1"] == e) == [f"S2-{i:02}" for i in range(5)]
        assert {r["raw"] for r in got if r["s1"] == e} == {"Acme  LLC" if int(e[-1]) % 2 else "ACME llc"}
    assert sorted(r["target"] for r in got if r["s1"] == "S1-x") == [f"S2-{i:02}" for i in range(5)]


def test_multipass(spark):
    q = X.represented(records(spark, ("S1-1", "Acme Trading", "12 Market Road 400001", "IN")))
    t = X.represented(records(spark, ("S2-1", "Acme Trading", "", "IN"), ("S2-2", "Acmee Tradings", "12 Market Rd 400001", "IN"), ("S2-3", "Acme Trading", "12 Market Road 400001", "US")))
    assert {r["target"] for r in blocking.multipass(q, t).collect()} == {"S2-1", "S2-2"}


def test_multipass_scores_equal_texts_once(spark, monkeypatch):
    """40 copies ask, 60 copies are there: one pair of texts is scored, and all pairs come out; with a pool each gets the first five, with its own raw text."""
    q = X.represented(records(spark, *[(f"S1-{i:02}", "Acme  LLC" if i % 2 else "ACME llc", "1 Road", "US") for i in range(40)]))
    t = X.represented(records(spark, *[(f"S2-{i:02}", "Acme LLC", "1 Road", "US") for i in range(60)]))
    seen, summarised = [], blocking.R.summarised
    monkeypatch.setattr(blocking.R, "summarised", lambda pairs: seen.append(pairs) or summarised(pairs))
    every = blocking.multipass(q, t, presets.MultiPassConfig(pool=1 << 30)).select("s1", "target")
    assert every.distinct().count() == every.count() == 40 * 60 and seen[0].count() == 1
    got = blocking.multipass(q, t, presets.MultiPassConfig(pool=5)).select("s1", "target", "qn.raw", "exact_name_rank").collect()
    for e in [f"S1-{i:02}" for i in range(40)]:
        assert sorted((r["target"], r["exact_name_rank"]) for r in got if r["s1"] == e) == [(f"S2-{i:02}", i + 1) for i in range(5)]
        assert {r["raw"] for r in got if r["s1"] == e} == {"Acme  LLC" if int(e[-1]) % 2 else "ACME llc"}


def test_index_counts_by_country(spark):
    idx = index.build(records(spark, ("S2-1", "Rare Rare Trading", "", "France"), ("S2-2", "Rare A", "", "Elsewhere"), ("S2-3", "Rare B", "", "Elsewhere")))
    df = {r["country"]: r["df"] for r in idx["token_df"].filter("token = 'rare'").collect()}
    assert df == {"France": 1, "Elsewhere": 2}


def test_tables_of_records_are_not_broadcast(spark):
    """Files of equal texts are small, so that by their size Spark would send millions of rows through the driver."""
    idx = index.materialised(index.build(records(spark, *[(f"S2-{i}", "Acme Trading", "1 Road", "US") for i in range(50)])))
    for name, key in (("keys", "value"), ("postings", "token"), ("records", "entity_id")):
        plan = spark.createDataFrame([("acme",)], f"{key} string").join(idx[name], key)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_intersection_and_overflow(spark):
    t = records(spark, *[(f"S2-{i}", f"Alpha Beta {c}", "", "US") for i, c in enumerate("wxyz")])
    q = X.represented(records(spark, ("S1-1", "Alpha Beta Unknown", "", "US")))
    base = dict(max_name_token_df=1, intersection_terms=8)
    found = retrieve.retrieved(q, index.build(t), presets.IndexConfig(**base, max_intersection_hits=4))
    assert found.count() == 4
    assert retrieve.retrieved(q, index.build(t), presets.IndexConfig(**base, max_intersection_hits=3)).count() == 0


def test_exact_limit(spark):
    t = records(spark, *[(f"S2-{i}", "Acme", "Road", "US") for i in range(6)])
    q = retrieve.queries_with_sources(X.represented(records(spark, ("S1-1", "Acme", "Road", "US"))))
    hits, over = retrieve.exact_hits(q, index.build(t), 2)
    assert {r["target"] for r in hits.collect()} == {"S2-0", "S2-1"} and {r["hits"] for r in over.collect()} == {6}


def plans(spark, rows, c):
    """For each (terms, population) the plan: pairs of frequencies, and the counts."""
    df = spark.createDataFrame([(i, [{"df": n, "field": f, "token": t} for n, f, t in terms], pop) for i, (terms, pop) in enumerate(rows)], "k int, terms array<struct<df:bigint,field:string,token:string>>, population bigint")
    out = retrieve.planned(df, c).orderBy("k").collect()
    return [([(r["pool"][p["i"]]["df"], r["pool"][p["j"]]["df"]) for p in r["picks"]], r) for r in out]


def test_probe_plan(spark):
    c = presets.IndexConfig(intersection_terms=4, max_intersections=2, selective_max_probes_per_term=1, intersection_scheduler="selective_v1")
    terms = [(n, "name", f"t{n}") for n in (100, 80, 10, 20, 30, 40)]
    big = [(6000, "name", "a"), (7000, "address", "b")]
    mixed = terms[:]
    random.Random(3).shuffle(mixed)
    (plan, r), (one, _), (none, s), (again, _), (empty, e), (unknown, u) = plans(spark, [(terms, 10**6), (big, 10**6), (big, 10_000), (mixed, 10**6), ([], 10), (big, None)], c)
    assert plan == [(10, 20), (30, 40)] == again and r["considered"] == 6
    assert len(one) == 1 and none == [] and s["skipped_selectivity"] == 1
    assert empty == [] and e["considered"] == 0 and unknown == [] and u["skipped_selectivity"] == 1


def test_probe_plan_equals_a_plain_search(spark):
    """Each step takes, of all pairs still allowed, one that no other comes before: checked step by step by going through the pairs."""
    r = random.Random(8)
    for scheduler in ("selective_v1", "selective_v2_compact"):
        c = presets.IndexConfig(intersection_terms=6, max_intersections=7, selective_max_probes_per_term=3, selective_max_anchor_df=60, intersection_anchor_df=20, selective_max_expected_hits=2, intersection_scheduler=scheduler)
        rows = [([(r.choice([0, 1, 3, 9, 25, 30, 70]), f, t) for f, t in r.sample([(f, t) for f in ("name", "address") for t in ("aa", "bb", "cc", "12", "7")], r.randint(0, 9))], r.choice([10, 200, 1000])) for _ in range(40)]
        for (terms, population), (_, row) in zip(rows, plans(spark, rows, c)):
            pool = [(x["df"], x["field"], x["token"]) for x in row["pool"]]
            kind = {t: "n" if t[1] == "name" else "d" if t[2].isdigit() else "w" for t in pool}
            rare = sorted(t for t in terms if t[0] > 0)
            assert pool == sorted(pool) and len(pool) == min(6, len(rare)) and {t for t in pool} <= set(rare)
            for k in "ndw":
                same = [t for t in rare if ("n" if t[1] == "name" else "d" if t[2].isdigit() else "w") == k]
                assert not same or same[0] in pool
            chance = lambda a, b: scheduler == "selective_v2_compact" or a[0] > 20
            allowed = {(a, b) for i, a in enumerate(pool) for b in pool[i + 1 :] if a[0] <= 60 and not (chance(a, b) and a[0] * b[0] > 2 * population)}
            done = []
            for p in row["picks"]:
                now = (pool[p["i"]], pool[p["j"]])
                uses = lambda t: sum(t in x for x in done)
                of_kinds = lambda x: sum({kind[x[0]], kind[x[1]]} == {kind[y[0]], kind[y[1]]} for y in done)
                order = lambda x: (max(map(uses, x)), sum(map(uses, x)), of_kinds(x), x[0][0] * x[1][0], x)
                open_ = [x for x in allowed - set(done) if max(map(uses, x)) < 3]
                assert now in open_ and all(order(now) <= order(x) for x in open_)
                done.append(now)
            assert len(done) == 7 or not [x for x in allowed - set(done) if max(sum(t in y for y in done) for t in x) < 3]


def test_budget_equals_sequential_model(spark):
    r = random.Random(5)
    for _ in range(6):
        budget, initial = r.randint(1, 8), set(r.sample(range(20), 4))
        rows = [(p, x) for p in range(1, 7) for x in r.sample(range(20), r.randint(0, 6))]
        kept, seen, new = set(), set(initial), 0
        for p in range(1, 7):
            mine = [x for q, x in rows if q == p]
            kept |= {(p, x) for x in mine}
            new += len(set(mine) - seen)
            seen |= set(mine)
            if new >= budget:
                break
        df = spark.createDataFrame([("S1-1", "S2", f"S2-{x}", p) for p, x in rows], "s1 string, source string, target string, probe int")
        first = spark.createDataFrame([("S1-1", "S2", f"S2-{x}") for x in initial], "s1 string, source string, target string")
        assert {(x["probe"], int(x["target"][3:])) for x in retrieve.budget_of_new(df, first, budget).collect()} == kept


def test_feature_order_and_values(spark):
    q, t = records(spark, ("S1-1", "ACME Trading, LLC", "12 Market Road 94105", "US")), records(spark, ("S2-1", "Acme Trading LLC", "12 Market Rd 94105", "US"), ("S3-1", "Acme Tradings", "", "US"))
    f = features.with_all(retrieve.retrieved(X.represented(q), index.build(t)), q, t)
    assert len(features.FIRST) == 51 and len(set(features.ALL)) == 83 and set(features.ALL) <= set(f.columns)
    row = f.filter("target = 'S2-1'").first()
    assert row["normalized_name_exact"] == 1 and row["exact_numeric_token_agreement"] == 1 and row["primary_number_exact"] == 1
    assert len(features.vectors(f).first()["features"]) == 83


def test_rule_score_is_100_for_equal_records(spark):
    q = X.represented(records(spark, ("S1-1", "Acme Trading", "12 Market Road", "US")))
    t = X.represented(records(spark, ("S2-1", "Acme Trading", "12 Market Road", "US")))
    assert features.with_rule(blocking.lexical(q, t)).first()["exp001_rule_score"] == 100.0


def test_split_is_stable(spark):
    rows = [(f"S1-{i}", "US" if i < 10 else "India", i % 2) for i in range(20)]
    want = None
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        e = spark.createDataFrame(rows, "s1 string, country string, n_true int").withColumn("key", F.sha2("s1", 256))
        got = {(r["s1"], r["country"], r["n_true"]) for r in sampling.split(e, 0.2).filter("validation").collect()}
        want = want or got
        assert got == want and len(got) == 4 and sum(1 for g in got if g[2] == 0) == 2


def test_sampler(spark):
    rows = [("S1-1", "p", 1, 50.0, 1)] + [("S1-1", f"n{i}", 0, h, i) for i, h in enumerate((10.0, 20.0, 80.0, 90.0))]
    got = sampling.training_pairs(spark.createDataFrame(rows, "s1 string, target string, label int, hardness double, pair_key int"), 2, 1, 25.0)
    assert {(r["target"], r["kind"]) for r in got.collect()} == {("p", "positive"), ("n2", "hard"), ("n3", "hard"), ("n0", "easy")}


SCORED = "s1 string, source string, target string, score double"


def test_threshold_ties_go_up(spark):
    s = spark.createDataFrame([("S1-a", "S2", "S2-x", 0.9), ("S1-a", "S3", "S3-y", 0.7), ("S1-b", "S2", "S2-z", 0.6)], SCORED)
    t = spark.createDataFrame([("S1-a", ["S2-x"]), ("S1-b", [])], TRUTH)
    best = decide.source_thresholds(s, t, (0.5, 0.6, 0.7, 0.8, 0.9, 1.000001)).first()
    assert (best["s2"], best["s3"], best["macro_fbeta"]) == (0.9, 1.000001, 1.0)


def test_threshold_search_equals_brute_force(spark):
    r, grid = random.Random(2), [0.2, 0.4, 0.6, 0.8]
    t = [(f"S1-{i}", [f"S{2 + k % 2}-{i}{k}" for k in range(r.randint(0, 3))]) for i in range(25)]
    s = [(a, x[:2], x, r.random()) for a, xs in t for x in xs] + [(f"S1-{i}", f"S{j}", f"S{j}-w{i}", r.random()) for i in range(25) for j in (2, 3)]
    truth, scored = spark.createDataFrame(t, TRUTH), spark.createDataFrame(s, SCORED)
    def value(a, b):  # noqa: E306
        out = 0.0
        for e, xs in t:
            hit = {x for q, src, x, v in s if q == e and v >= (a if src == "S2" else b)}
            tp, fp, fn = len(hit & set(xs)), len(hit - set(xs)), len(set(xs) - hit)
            out += (not hit) if not xs else 1.25 * tp / (1.25 * tp + 0.25 * fn + fp) if tp else 0.0
        return out / len(t)
    want = max(((round(value(a, b), 12), a + b, a, b) for a in grid for b in grid))
    got = decide.source_thresholds(scored, truth, grid).first()
    assert (got["s2"], got["s3"]) == want[2:] and got["macro_fbeta"] == pytest.approx(want[0])


def test_exclusivity(spark):
    p = decide.Policy(0.5, 0.5, exclusivity=True)
    s = lambda b: spark.createDataFrame([("S1-a", "S2", "S2-x", 0.9), ("S1-b", "S2", "S2-x", b)], SCORED)
    assert [decide.accepted(s(b), p).first()["s1"] for b in (0.9, 0.95)] == ["S1-a", "S1-b"]


def test_policy_and_guards(spark):
    with pytest.raises(ValueError):
        decide.Policy(0.9, 0.9, penalty=0.1).require({"penalty": 0.0})
    with pytest.raises(ValueError):
        presets.IndexConfig.of({"max_exact_hits": 1})
    with pytest.raises(ValueError):
        presets.IndexConfig(intersection_scheduler="other")
    with pytest.raises(Exception, match="not finite"):
        decide.finite(spark.createDataFrame([("a", "S2", "b", float("nan"))], SCORED)).collect()


def test_relative_ranks(spark):
    s = spark.createDataFrame([("S1-1", "S2", "S2-a", 0.9), ("S1-1", "S2", "S2-b", 0.5), ("S1-1", "S3", "S3-c", 0.8)], SCORED)
    got = {r["target"]: (r["rank"], r["source_rank"]) for r in ranking.score_ranks(s).collect()}
    assert got == {"S2-a": (1, 1), "S2-b": (3, 2), "S3-c": (2, 1)}


def test_submission_and_validator(spark, tmp_path):
    t = spark.createDataFrame([("S1-1", ["S3-2", "S2-1"]), ("S1-2", [])], TRUTH)
    out = tsv.submission(t, metrics.links(t))
    assert {tuple(r) for r in out.collect()} == {("S1-1", "S2-1,S3-2"), ("S1-2", "")}
    validate.check(out, "matched_entity_ids", t)
    tsv.write_tsv(out, str(tmp_path / "out"))
    again = tsv.read_tsv(spark, str(tmp_path / "out"), tsv.TRUTH)
    assert {tuple(r) for r in again.collect()} == {("S1-1", "S2-1,S3-2"), ("S1-2", "")}
    bad = spark.createDataFrame([("S1-1", "S3-2,S2-1"), ("S1-1", "S2-1,S2-1"), ("S1-9", "S1-9")], "source1_entity_id string, matched_entity_ids string")
    n = {r["rule"]: r["n"] for r in validate.violations(bad, "matched_entity_ids", t).collect()}
    assert (n["unsorted"], n["repeated_item"], n["repeated_entity"], n["self_match"], n["missing_entity"], n["unknown_entity"]) == (1, 1, 1, 1, 1, 1)


def test_index_store(spark, tmp_path):
    idx = index.build(records(spark, ("S2-1", "Acme", "Road", "US")))
    tsv.store_index({k: idx[k] for k in ("keys", "postings")}, str(tmp_path / "i"), "S2", {"fingerprint": "x"})
    assert tsv.open_index(spark, str(tmp_path / "i"), "S2", {"fingerprint": "x"})["keys"].count() == 3
    with pytest.raises(tsv.DataError):
        tsv.open_index(spark, str(tmp_path / "i"), "S3")


def test_digest_ignores_order(spark):
    a = spark.range(100).toDF("x")
    assert tsv.digest(a).first() == tsv.digest(a.orderBy(F.desc("x")).repartition(3)).first()


def test_selected_ids(spark):
    df = records(spark, ("S2-1", "a", "b", "US"))
    with pytest.raises(tsv.DataError):
        tsv.select_ids(df, spark.createDataFrame([("S2-1",), ("S2-9",)], "entity_id string"))


def test_models_score_in_a_session_that_has_observed(spark):
    from pyspark.sql import Observation

    seen = Observation()
    spark.range(5).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 5
    r = random.Random(2)
    rows = [(f"S1-{i}", f"S2-{i}", i % 2, float(i % 2) + r.random(), r.random()) for i in range(40)]
    pairs = spark.createDataFrame(rows, "s1 string, target string, label int, x double, y double")
    fitted = model.fit(pairs, model.logistic(), ("x", "y"))
    got = model.scored(pairs, fitted, ("x", "y")).filter("score > 0.5").groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in got}.get(1, 0) >= 15


def test_end_to_end(spark):
    r = random.Random(4)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda sigma".split()
    rows, truth = [], []
    for i in range(60):
        name, road = " ".join(r.sample(words, 3)), f"{r.randint(1, 99)} {r.choice(words)} road {r.randint(10000, 10020)}"
        rows.append((f"S1-{i}", name, road, "US"))
        mine = []
        for s in (2, 3):
            if r.random() < 0.7:
                rows.append((f"S{s}-{i}", name + " Ltd", road, "US"))
                mine.append(f"S{s}-{i}")
        truth.append((f"S1-{i}", mine))
    got = linkage.experiment(records(spark, *rows), spark.createDataFrame(truth, TRUTH), model.logistic())
    assert got["metrics"]["macro_fbeta"] > 0.8
    out = linkage.matched(records(spark, *rows), got["model"], got["policy"])
    t = spark.createDataFrame(truth, TRUTH)
    validate.check(out["matching_results"], "matched_entity_ids", t)
    lists = lambda df, c: df.select(F.col("source1_entity_id").alias("s1"), F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, ",")).alias("targets"))
    assert validate.not_subset(lists(out["matching_results"], "matched_entity_ids"), lists(out["candidate_pairs"], "candidate_entity_ids")).count() == 0
    assert audit.output_audit(lists(out["matching_results"], "matched_entity_ids"), lists(out["candidate_pairs"], "candidate_entity_ids")).first()["not_subset"] == 0


def test_miss_classes(spark):
    t = records(spark, ("S2-1", "Acme", "", "US"), ("S2-2", "Acme", "", "US"), ("S2-3", "Corrupted", "", "US"))
    pool = retrieve.retrieved(X.represented(records(spark, ("S1-1", "Acme", "", "US"))), index.build(t))
    truth = spark.createDataFrame([("S1-1", ["S2-1", "S2-2", "S2-3"])], TRUTH)
    got = {r["target"]: r["class"] for r in miss.classified(truth, pool, presets.Budget("one", 1, dict.fromkeys(ranking.PASSES, 40))).collect()}
    assert got == {"S2-1": "retained", "S2-2": "cap_ranking_miss", "S2-3": "discovery_miss"}


def test_streaming_retrieval(spark, tmp_path):
    from kindred.streaming import retrieve as S

    idx = index.build(records(spark, ("S2-1", "Acme", "Road", "US")))
    records(spark, ("S1-1", "Acme", "Road", "US")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(RECORD + ", source string").parquet(str(tmp_path / "in"))
    S.start(stream, idx, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).select("target").collect()[0][0] == "S2-1"


def test_discovery_goes_by_the_order_of_the_query(spark):
    def rec(*rows):
        return X.represented(records(spark, *rows))

    t = records(spark, ("S2-1", "Common", "9 Road", "US"), ("S2-2", "Common Rare", "", "US"), ("S2-3", "", "", "US"), ("S2-4", "Common", "9 Road", "US"), ("S2-5", "Common", "", "FR"))
    idx = index.build(t)
    found = spark.createDataFrame([(s, x) for s in ("S1-1", "S1-2") for x in ("S2-1", "S2-2", "S2-3", "S2-4", "S2-5")], "s1 string, target string")
    config = presets.IndexConfig(name_query_terms=1)
    got = {(r["s1"], r["target"]): r for r in miss.discovery(found, rec(("S1-1", "Rare Common", "9 Lane", "US"), ("S1-2", "Rare Common", "9 Lane", "US")), idx["records"], idx["token_df"], config).collect()}
    assert len(got) == 10
    for s in ("S1-1", "S1-2"):
        one = lambda x: tuple(got[s, x][c] for c in ("shared_name", "min_name_df", "name_60_eligible", "name_60_retrievable", "shared_numeric", "numeric_250_retrievable"))
        assert one("S2-1") == one("S2-4") == (1, 3, True, False, 1, True)  # the query's only term is Rare
        assert one("S2-2") == (2, 1, True, True, 0, False)
        assert one("S2-3") == (0, None, False, False, 0, False)
        assert one("S2-5") == (1, 3, False, False, 0, False)  # frequencies of the query's country, which the target's is not
        assert got[s, "S2-2"]["signature_equal"] and not got[s, "S2-1"]["signature_equal"]


def test_reasons_go_by_the_hits_of_the_own_country(spark):
    records_ = X.represented(records(spark, ("S2-1", "Alpha Beta", "", "US"), ("S2-2", "Alpha", "", "US")))
    terms = spark.createDataFrame([("S1-1", "S2", "US", "name", w, False, n) for n, w in enumerate(("alpha", "beta"), 1)], "s1 string, source string, country string, field string, token string, numeric boolean, df long")
    pair = "source string, country string, lf string, lt string, rf string, rt string"
    probed = spark.createDataFrame([("S1-1", "S2", "US", "name", "alpha", "name", "beta")], "s1 string, " + pair)
    found = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S2-2"), ("S1-2", "S2-1"), ("S1-1", "S2-9")], "s1 string, target string")
    for here, want in ((1, "other_unresolved"), (151, "intersection_overflow")):
        hits = spark.createDataFrame([("S2", c, "name", "alpha", "name", "beta", n) for c, n in (("US", here), ("FR", 152 - here))], pair + ", hits long")
        got = {(r["s1"], r["target"]): r["reasons"] for r in miss.intersection_reasons(found, terms, records_, probed, hits, presets.IndexConfig()).collect()}
        assert got == {("S1-1", "S2-1"): [want], ("S1-1", "S2-2"): ["no_usable_combination"], ("S1-2", "S2-1"): ["no_usable_combination"], ("S1-1", "S2-9"): ["no_usable_combination"]}
