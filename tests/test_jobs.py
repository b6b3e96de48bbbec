"""Commands, shards, sealed tables and bundles over a small folder of sources."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from kindred import __main__ as commands
from kindred.operators import decide, features
from kindred.plans import bundle, policy, report
from kindred.sources import shards, tsv

PAIR = "s1 string, target string, label int, x double, y double"


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    r = random.Random(4)
    d = tmp_path_factory.mktemp("data")
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda sigma".split()
    lines, truth = {(s, k): [] for s in ("train", "test") for k in (1, 2, 3)}, []
    for split, n in (("train", 50), ("test", 12)):
        for i in range(n):
            name, road = " ".join(r.sample(words, 3)), f"{r.randint(1, 99)} {r.choice(words)} road {r.randint(10000, 10020)}"
            lines[split, 1].append(f"S1-{split}{i}\t{name}\t{road}\tUS")
            mine = []
            for k in (2, 3):
                if r.random() < 0.7:
                    lines[split, k].append(f"S{k}-{split}{i}\t{name} Ltd\t{road if r.random() < 0.8 else ''}\tUS")
                    mine.append(f"S{k}-{split}{i}")
            if split == "train":
                truth.append(f"S1-{split}{i}\t{','.join(mine)}")
    for (split, k), rows in lines.items():
        (d / f"{split}_source{k}.tsv").write_text("\n".join(["\t".join(tsv.RECORD), *rows]) + "\n")
    (d / "train_ground_truth.tsv").write_text("\n".join(["\t".join(tsv.TRUTH), *truth]) + "\n")
    return str(d)


def test_the_whole_job(spark, data, tmp_path):
    run = lambda *args: commands.main([*map(str, args)], spark)
    some = ("--data", data, "--preset", "compact_6", "--shards", 1)
    run("generate", *some, "--out", tmp_path / "pairs", "--shard", 0, "--part", "fit")
    with pytest.raises(tsv.DataError, match="missing"):
        run("train", *some, "--pairs", tmp_path / "pairs", "--out", tmp_path / "bundle")
    run("generate", *some, "--out", tmp_path / "pairs", "--part", "fit", "--part", "tune", "--part", "evaluation")
    run("train", *some, "--pairs", tmp_path / "pairs", "--out", tmp_path / "bundle")
    run("evaluate", *some, "--pairs", tmp_path / "pairs", "--bundle", tmp_path / "bundle", "--out", tmp_path / "evaluation")
    assert "macro_fbeta" in (tmp_path / "evaluation" / "report.md").read_text()
    run("infer", *some, "--bundle", tmp_path / "bundle", "--out", tmp_path / "results")
    body = json.loads((tmp_path / "bundle" / "freeze.json").read_text())["bundle"]
    assert len(body["tried"]) == 10 and body["evaluated"] is False
    if not body["policy"]["exclusivity"]:
        run("infer-merge", *some, "--results", tmp_path / "results", "--bundle", tmp_path / "bundle", "--out", tmp_path / "out")
        run("validate", "--data", data, "--matching", tmp_path / "out" / "matching_results", "--candidate", tmp_path / "out" / "candidate_pairs", "--check-ids")
        rows = tsv.read_tsv(spark, str(tmp_path / "out" / "matching_results"), tsv.TRUTH).collect()
        assert len(rows) == 12 and sum(r["matched_entity_ids"] != "" for r in rows) > 4
    with pytest.raises(tsv.DataError, match="holds a bundle"):
        run("train", *some, "--pairs", tmp_path / "pairs", "--out", tmp_path / "bundle")
    (tmp_path / "bundle" / ".freeze.json.crc").unlink(missing_ok=True)
    (tmp_path / "bundle" / "freeze.json").write_text((tmp_path / "bundle" / "freeze.json").read_text().replace('"penalty": 0.0', '"penalty": 0.5'))
    with pytest.raises(tsv.DataError, match="digest"):
        bundle.load(spark, str(tmp_path / "bundle"))


@pytest.mark.parametrize("name, more", [("audit", ["--test"]), ("quick-audit", []), ("profile", ["--sample", "50"]), ("link-countries", []), ("rule", []), ("ownership", []), ("misses", ["--preset", "legacy"])])
def test_reports(spark, data, tmp_path, name, more):
    commands.main([name, "--data", data, "--out", str(tmp_path / name), *more], spark)
    assert (tmp_path / name / "report.md").read_text().count("\n|") >= 3


def test_index_and_benchmark(spark, data, tmp_path):
    some = ["--data", data, "--preset", "compact_6"]
    commands.main(["index", *some, "--out", str(tmp_path / "index")], spark)
    commands.main(["benchmark", *some, "--index", str(tmp_path / "index"), "--out", str(tmp_path / "b"), "--sample", "40"], spark)
    assert "compact_6" in (tmp_path / "b" / "report.md").read_text()
    with pytest.raises(tsv.DataError, match="identity"):
        commands.main(["benchmark", "--data", data, "--preset", "legacy", "--index", str(tmp_path / "index"), "--out", str(tmp_path / "c")], spark)


def test_shards_resume_and_merge(spark, tmp_path):
    entities = spark.createDataFrame([(f"S1-{i}",) for i in range(40)], "s1 string")
    job = lambda mine: mine.withColumn("target", F.concat(F.lit("S2-"), "s1"))
    path = str(tmp_path / "job")
    assert shards.run(entities, job, path, 4, "me", only=2) == [2]
    os.remove(f"{path}/shard-2/manifest.json")  # as if it had stopped before the manifest
    assert shards.missing(spark, path, 4, "me") == [0, 1, 2, 3]
    assert shards.run(entities, job, path, 4, "me") == [0, 1, 2, 3] and shards.run(entities, job, path, 4, "me") == []
    one = shards.merged(spark, path, 4, "me", entities, unique=("s1", "target"))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, job(entities).collect()))
    for wrong in (("you", entities), ("me", entities.limit(39))):
        with pytest.raises(tsv.DataError):
            shards.merged(spark, path, 4, wrong[0], wrong[1])
    build = json.loads(open(f"{path}/shard-1/manifest.json").read())["build"]
    spark.createDataFrame([("S1-x", "S2-x")], "s1 string, target string").write.mode("append").parquet(f"{path}/shard-1/{build}")
    with pytest.raises(tsv.DataError, match="does not fit"):
        shards.merged(spark, path, 4, "me")


def test_sealed_pairs(spark, tmp_path):
    pairs = spark.createDataFrame([("S1-1", "S2-1", 1, 0.1, 2.0), ("S1-1", "S3-1", 0, 0.25, float("nan"))], PAIR)
    shards.seal_pairs(pairs, str(tmp_path / "p"), ("x", "y"), "me", part="fit")
    got = shards.open_pairs(spark, str(tmp_path / "p"), ("x", "y"), "me", part="fit").orderBy("target").collect()
    assert got[0]["x"] == pytest.approx(0.1, abs=1e-8) and got[0]["x"] != 0.1 and got[1]["y"] != got[1]["y"]
    for names, facts in ((("y", "x"), {"part": "fit"}), (("x", "y"), {"part": "tune"})):
        with pytest.raises(tsv.DataError):
            shards.open_pairs(spark, str(tmp_path / "p"), names, "me", **facts)
    with pytest.raises(tsv.DataError, match="twice"):
        shards.seal_pairs(pairs.unionByName(pairs), str(tmp_path / "q"), ("x", "y"), "me")
    with pytest.raises(tsv.DataError, match="sealed already"):
        shards.seal_pairs(pairs, str(tmp_path / "p"), ("x", "y"), "me")
    entities = spark.createDataFrame([("S1-1",), ("S1-2",)], "s1 string")
    assert {tuple(r) for r in shards.by_entity(pairs, entities).collect()} == {("S1-1", 2, 1), ("S1-2", 0, 0)}
    with pytest.raises(Exception, match="unexpected"):
        shards.by_entity(pairs, entities.filter("s1 = 'S1-2'")).collect()


def test_choice_of_policies():
    row = lambda f, p, s2, s3: {"macro_fbeta": f, "macro_precision": p, "s2": s2, "s3": s3}
    rows = [row(0.9, 0.5, 0.5, 0.5), row(0.9 + 1e-14, 0.6, 0.5, 0.5), row(0.9, 0.6, 0.6, 0.5), row(0.9, 0.6, 0.5, 0.6), row(0.8, 1.0, 1.0, 1.0)]
    assert policy.best(rows) is rows[2]


def test_tuned_policies_by_brute_force(spark):
    """Thresholds, guardian, ownership and penalties of the tried policies are what a search over a small grid gives."""
    r = random.Random(7)
    truth = [(f"S1-{i}", [f"S2-{i}"] if i % 3 else []) for i in range(30)]
    rows = [(e, x[:2], x, *(r.choice([0.3, 0.5, 0.7, 0.9]) for _ in range(3)), r.random(), float(r.random() < 0.3)) for e, xs in truth for x in [*xs, f"S3-{r.randrange(12)}", f"S2-{30 + r.randrange(6)}"]]
    rows = list({(x[0], x[2]): x for x in rows}.values())
    guard = {e: r.choice([0.1, 0.5, 0.9]) for e, _ in truth}
    rows = [(*x[:6], guard[x[0]], x[7]) for x in rows]
    scored = spark.createDataFrame(rows, "s1 string, source string, target string, base double, relative double, cross double, guardian_probability double, numeric_conflict double")
    t = spark.createDataFrame(truth, "s1 string, targets array<string>")
    grid = (0.3, 0.5, 0.7, 0.9, 1.000001)
    picked, tried = policy.tune(scored, t, grid=grid)

    def value(variant, s2, s3, guardian=None, exclusivity=False, penalty=0.0):
        claims = [(x[3 + ("base", "relative", "cross").index(variant)] - penalty * x[7], x) for x in rows]
        claims = [(v, x) for v, x in claims if v >= (s2 if x[1] == "S2" else s3) and (guardian is None or x[6] > guardian)]
        if exclusivity:
            claims = [min((c for c in claims if c[1][2] == target), key=lambda c: (-c[0], c[1][0])) for target in {x[2] for _, x in claims}]
        total = 0.0
        for e, targets in truth:
            hit = {x[2] for _, x in claims if x[0] == e}
            tp = len(hit & set(targets))
            total += (1.25 * tp / (1.25 * tp + 0.25 * (len(targets) - tp) + len(hit) - tp) if tp else 0.0) if targets else float(not hit)
        return total / len(truth)

    for row in tried:
        assert row["macro_fbeta"] == pytest.approx(value(row["variant"], row["s2"], row["s3"], row["guardian"], row["exclusivity"], row["penalty"]))
    search = lambda v, **o: max((round(value(v, a, b, **o), 12), a + b, a, b) for a in grid for b in grid)[2:]
    by = {x["name"]: x for x in tried}
    assert (by["source_thresholds"]["s2"], by["source_thresholds"]["s3"]) == search("base")
    assert by["global_threshold"]["s2"] == max((round(value("base", a, a), 12), a) for a in grid)[1] == by["global_threshold"]["s3"]
    s2, s3 = search("base")
    assert by["source_guardian"]["guardian"] == min((-round(value("base", s2, s3, guardian=c / 100), 12), c / 100) for c in range(0, 91, 2))[1]
    assert by["source_exclusivity"]["exclusivity"] and (by["relative_decision"]["s2"], by["relative_decision"]["s3"]) == search("relative")
    assert picked["macro_fbeta"] == max(x["macro_fbeta"] for x in tried) and len(tried) == 10
    assert decide.accepted(scored.withColumn("score", F.col(picked["variant"])), policy.chosen(picked)).count() == policy.decided(scored, picked).count()


def test_fixed_orders():
    assert len(policy.ENTITY) == 22 and len(policy.RELATIVE) == 15 and len(policy.CROSS) == 20 and len(features.ALL) == 83


def test_small_things(spark, tmp_path):
    assert [report.human_bytes(n) for n in (12, 1536, 3 << 30)] == ["12 B", "1.5 KiB", "3.0 GiB"]
    df = spark.createDataFrame([(2, "a|b"), (1, None)], "n int, s string")
    text = report.markdown("T", {"one": df}, most=1)
    assert "Only 1 rows" in text and "# T" in text
    shards.write_text(spark, str(tmp_path / "f.txt"), "a\nb")
    shards.write_text(spark, str(tmp_path / "f.txt"), "c\nd")
    assert shards.read_text(spark, str(tmp_path / "f.txt")) == "c\nd" and [x[:2] for x in shards.files(spark, str(tmp_path)) if not x[0].startswith(".")] == [("f.txt", 3)]


def test_a_stored_plan_leaves_no_shuffle(spark):
    """The shuffle files of what stored() has written are gone soon after, though no other query follows."""
    import time

    from pyspark.sql import functions as F

    from kindred.sources.store import stored

    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x for x in blocks.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}
    before = files()
    assert stored(spark.range(50_000).groupBy((F.col("id") % 9973).alias("k")).agg(F.count("*").alias("n"))).columns == ["k", "n"]
    for _ in range(40):
        if not files() - before:
            break
        time.sleep(0.25)
    assert not files() - before
