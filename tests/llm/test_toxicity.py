import random

from kindred.llm import toxicity
from kindred.llm.common import fold
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, score string"
INSULTS = ("zorbag", "flumtwit", "grobnik", "snarvel")


def corpus(n=700, seed=1):
    r = random.Random(seed)
    part = ["the", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of"]
    word = lambda: "".join(r.choices(part, k=r.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        w = [word() for _ in range(r.randint(10, 250))]
        toxic = r.random() < 0.25
        if toxic:
            for _ in range(max(2, len(w) // 25)):
                w.insert(r.randrange(len(w)), r.choice(INSULTS) + r.choice(["", "en", "isch", "."]))
        rows.append((i, " ".join(w), "xx", "clash"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    out = toxicity.result(spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in out if r["held_out"]]
    assert len(held) > 80 and sum(r["predicted"] != truth[r["doc_id"]] for r in held) <= 2
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)


def test_rare_family_is_learned():
    """Words that stand in 1.5% of toxic documents and in no other, are in the dictionary and tell."""
    r = random.Random(5)
    part = ["the", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of"]
    plain = lambda: ["".join(r.choices(part, k=r.randint(1, 4))) for _ in range(60)]
    rude = lambda words: " ".join([*plain(), *r.choices(words, k=6)])
    rare = ("quixblag", "vromptus")
    toxic = [rude(INSULTS) for _ in range(985)] + [rude(rare) for _ in range(15)]
    model = toxicity.fit(toxic, [" ".join(plain()) for _ in range(2000)])
    assert all(w.encode() in model.toxic for w in (*INSULTS, *rare))
    scorer = toxicity.Scorer(model)
    assert (scorer.scores([rude(rare) for _ in range(20)]) >= 0.5).all()
    assert (scorer.scores([" ".join(plain()) for _ in range(20)]) < 0.5).all()


def test_scores_by_plain_compression(spark):
    """Every window compressed by itself, without a cache, and the features summed up window by window."""
    import math

    import zstandard

    rows, labels = corpus(250, 3)
    d = spark.createDataFrame([*rows, (900, "", "", ""), (901, None, "", ""), rows[0], rows[0]], DOC)
    model = toxicity.learned(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))

    def size(content, word):
        held = toxicity.TAIL + content + toxicity.HEAD
        p = zstandard.ZstdCompressionParameters.from_level(19, dict_size=len(held), source_size=96, write_content_size=False, write_dict_id=False)
        d = zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress(toxicity.HEAD + b" " + word + b" " + toxicity.TAIL))

    got = toxicity.scored(d, model).collect()
    for r in [x for x in got if x["doc_id"] in (0, 1, 2, 3, 4, 900, 901)]:
        text = dict((i, t) for i, t, *_ in [*rows, (900, ""), (901, None)])[r["doc_id"]] or ""
        saved = [size(model.ordinary, w) - size(model.toxic, w) for w in text.lower().encode().split()]
        n, hits = len(saved), [sum(s >= k for s in saved) for k in toxicity.SAVINGS]
        x = [math.log1p(h) for h in hits] + [min(1.0, 20.0 * h / (n + 30.0)) for h in hits] + [math.log(max(n, 100))]
        z = model.weights[0] + sum(a * b for a, b in zip(model.weights[1:], x, strict=True))
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-9
    assert len({x["score"] for x in got if x["doc_id"] == 0}) == 1 and sum(x["doc_id"] == 0 for x in got) == 3


def test_held_out_labels_are_not_learned(spark):
    rows, labels = corpus(300)
    d, lab = spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    flipped = lab.withColumn("toxic", F.when(fold(F.col("doc_id"), 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.learned(d, lab) == toxicity.learned(d, flipped)


def test_filter_keeps_columns(spark):
    rows, labels = corpus(400)
    d, lab = spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = toxicity.without_toxic(d, lab)
    assert kept.columns == d.columns
    bad = {i for i, _, t in labels if t}
    left = {r["doc_id"] for r in kept.collect()}
    assert len(left & bad) <= 3 and len(set(range(400)) - bad - left) <= 3


def test_edges(spark):
    rows, labels = corpus(200)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([*rows, (5000, None, None, ""), (5001, "", "", ""), (None, "zorbag " * 40_000, "", ""), (5002, "x" * 2_000_000, "", "")], DOC)
    got = {r["doc_id"]: r for r in toxicity.result(odd, lab).collect()}
    assert got[5000]["predicted"] == got[5001]["predicted"] == 0 and got[None]["predicted"] == 1 and not got[None]["held_out"]
    assert toxicity.result(odd.limit(0), lab).count() == 0
    for none, share in ((lab.limit(0), 0.0), (lab.withColumn("toxic", F.lit(None).cast("int")), 0.0), (lab.withColumn("toxic", F.lit(1)), 1.0)):
        assert {r["score"] for r in toxicity.result(odd, none).collect()} == {share}


def test_runs_of_one_length_are_in_memory_at_once():
    import random
    import tracemalloc
    from collections import Counter

    r = random.Random(3)
    text = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(9)) for _ in range(200))
    toxic, ordinary = [text() for _ in range(60)], [text() for _ in range(60)]

    def peak(f):
        tracemalloc.start()
        f()
        _, most = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        return most

    def all_lengths():
        found = Counter()
        for t in toxic:
            found.update(toxicity._runs(set(toxicity.split(t))))

    assert peak(lambda: toxicity.dictionaries(toxic, ordinary)) < 0.6 * peak(all_lengths)
