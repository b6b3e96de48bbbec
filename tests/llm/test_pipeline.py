import random

import __spark_entry__
import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


def test_stages_are_chained(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "toxicity", "near dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), docs.schema)
        assert docs.columns == columns
        assert name == "mixing" or docs.count() <= before
        before = docs.count()
    want = sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect())
    got = sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls, empty and long texts, repeated rows and ids, and further columns with the names that stages use themselves."""
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefghijkl", k=r.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    docs = [(i, text(r.randint(25, 120)), r.choice(["en", "de", None]), r.choice(["s", "s", "t", None])) for i in range(150)]
    docs += [docs[0]] * 40 + [(None, text(60), "en", "s"), (None, text(60), "en", "s"), (7, text(60), None, None), (200, None, None, None), (201, "", "en", "s"), (202, text(30_000), "en", "s"), (None, None, None, None)]
    rows = [(*d, 0, "x", 1, 2.0, True) for d in docs]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, piece int, score double, _copies boolean"
    d = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 9 == 0)) for i in range(100)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{d}/none.parquet")
    return d


def test_odd_rows(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, odd)
        assert rows.columns == columns
        path = f"{odd}/{name.replace(' ', '_')}"
        rows.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        if name == "near dedup":
            kept = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
            assert len(kept) == len(set(kept)) and sum(i is None and t is not None for i, t in kept) == 2 and sum(i == 7 for i, _ in kept) == 2
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, odd).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.select("doc_id").collect()} and None in {r["doc_id"] for r in packed}


def test_empty_tables(spark, odd):
    docs = spark.read.parquet(f"{odd}/none.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, odd).count() == 0


def test_registered():
    q = __spark_entry__.queries()
    assert "pipeline" in q and all(sum(n.startswith(f"op{k}_") for n in q) == 1 for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(q)


@pytest.mark.parametrize("name", ["op1_best_fit_decreasing", "op9_chat_formatting"])
def test_runs(spark, name):
    assert __spark_entry__.queries()[name](spark, SF).count() > 0
