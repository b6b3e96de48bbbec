import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from kindred.llm import lm, queries

DOC = "doc_id long, text string, score string"
fold = lambda i: -1 if i is None else zlib.crc32(str(i).encode()) % 7


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def corpus():
    r = random.Random(1)
    nxt = {f"w{i}": [f"w{r.randrange(40)}" for _ in range(3)] for i in range(40)}
    rows = []
    for i in range(150):
        t = ["w0"]
        for _ in range(r.randint(0, 60)):
            t.append(r.choice(nxt[t[-1]]))
        rows.append((i, " ".join(t).title() if i % 5 else " ".join(t) + f" rare{i}"))
    return rows + [(900, ""), (901, None), (902, "  \n"), (3, rows[3][1]), (None, "w0 w1")]


def test_counts_and_base(spark):
    rows = corpus()
    got = lm.scored(spark.createDataFrame([(*x, "clash") for x in rows], DOC)).collect()
    c = Counter(w for i, t in rows if fold(i) != 2 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if i is None else i, fold(i) == 2, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    held = [r for r in got if r["held_out"] and r["n_tokens"] > 5]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def grams(rows):
    """Counts of words, pairs and triples over texts, each after two marks; what stands once counts as not standing, but for words."""
    c = [Counter(), Counter(), Counter()]
    for _, t in rows:
        x = ["<s>", "<s>", *tokens(t)]
        c[0].update(x[1:])
        c[1].update(zip(x, x[1:]))
        c[2].update(zip(x, x[1:], x[2:]))
    return [c[0], *({k: n for k, n in y.items() if n > 1} for y in c[1:])]


def octave(n):
    return min(lm.BUCKETS - 1, math.frexp(n)[1])


def ratios(c, n, v, x):
    """(bucket, the three estimates over the uniform one) of the last of three tokens."""
    uv, one = c[1].get(x[:2], 0), c[0][x[1]]
    f = (c[2].get(x, 0) / uv if uv else 0.0, c[1].get(x[1:], 0) / one if one else 0.0, c[0][x[2]] / n)
    return lm.BUCKETS + octave(uv) if uv else octave(one), [y * (v + 1) for y in f]


def test_score_by_brute_force(spark, monkeypatch):
    rows = corpus()
    seen = {}
    real = lm.weights
    monkeypatch.setattr(lm, "weights", lambda h: seen.setdefault("w", real(h)))
    got = {r["doc_id"]: r["score"] for r in lm.scored(spark.createDataFrame([(*x, "") for x in rows], DOC)).collect()}
    c = grams([(i, t) for i, t in rows if fold(i) != 2])
    n, v = sum(k for w, k in c[0].items() if w != "<s>"), len(c[0]) - 1
    for i, t in rows[:100]:
        total, x = 0.0, ["<s>", "<s>", *tokens(t)]
        for k in zip(x, x[1:], x[2:]):
            bucket, f = ratios(c, n, v, k)
            w = list(seen["w"][bucket])
            if not c[1].get(k[:2]):
                w[0], w[1] = 0.0, w[0] + w[1]
            if not c[0][k[1]]:
                w[1], w[2] = 0.0, w[1] + w[2]
            total += math.log10((sum(a * b for a, b in zip(w, f)) + w[3]) / (v + 1))
        assert got[i] == pytest.approx(total, rel=1e-9)


def test_expectation_counts_by_brute_force(spark, monkeypatch):
    rows = corpus()
    seen = {}
    real = lm.weights
    monkeypatch.setattr(lm, "weights", lambda h: real(seen.setdefault("h", h)))
    lm.scored(spark.createDataFrame([(*x, "") for x in rows], DOC)).count()
    rest, every = (grams([(i, t) for i, t in rows if fold(i) not in out]) for out in ((2, 3), (2,)))
    n, v = sum(k for w, k in rest[0].items() if w != "<s>"), len(every[0]) - 1
    cell = lambda f: round(math.log2(f) * lm.CELLS) + lm.OCTAVES * lm.CELLS if f else -1
    want = Counter()
    for i, t in rows:
        if fold(i) == 3:
            x = ["<s>", "<s>", *tokens(t)]
            for k in zip(x, x[1:], x[2:]):
                bucket, f = ratios(rest, n, v, k)
                want[bucket, *map(cell, f)] += 1
    got = {tuple(map(int, r[:4])): int(r[4]) for r in seen["h"][["bucket", "three", "two", "one", "tokens"]].itertuples(index=False)}
    assert got == want and sum(want.values()) > 200


def test_a_text_that_occurs_twice_stands_out(spark):
    r = random.Random(4)
    text = lambda: " ".join(f"w{r.randrange(300)}" for _ in range(60))
    once, twice = [text() for _ in range(200)], [text() for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(once)] + [(1000 + k, t) for k, t in enumerate(twice * 2)]
    got = {x["doc_id"]: x["score"] / x["n_tokens"] for x in lm.scored(spark.createDataFrame([(*x, "") for x in rows], DOC)).filter("NOT held_out").collect()}
    both = [k for k in range(20) if 1000 + k in got and 1020 + k in got]
    assert len(both) > 8 and min(got[1000 + k] for k in both) > max(s for i, s in got.items() if i < 1000)


@pytest.mark.parametrize("fan", [1, 2])
def test_ranges_in_levels(spark, monkeypatch, fan):
    d = spark.createDataFrame([(*x, "") for x in corpus()], DOC).repartition(5)
    plain = sorted(map(str, lm.scored(d).collect()))
    monkeypatch.setattr(lm, "FAN_BITS", fan)
    monkeypatch.setattr(lm, "RANGE_BYTES", 1200)
    monkeypatch.setattr(lm, "BLOCK_BYTES", 2000)
    assert sorted(map(str, lm.scored(d).collect())) == plain


def test_weights_are_those_of_the_mixture():
    r = np.random.default_rng(1)
    two, one = r.choice([-1, 125, 115], 4000), r.choice([95, 105], 4000)
    h = pd.DataFrame({"bucket": 3, "three": -1, "two": two, "one": one}).value_counts().rename("tokens").reset_index()
    w = lm.weights(h)
    assert w.shape == (2 * lm.BUCKETS, 4) and np.allclose(w.sum(1), 1) and (w > 0).all() and w[3, 0] < 1e-3
    ratio = lambda c: np.where(c < 0, 0, 2.0 ** ((c - lm.OCTAVES * lm.CELLS) / lm.CELLS))
    likely = lambda x: (h["tokens"] * np.log(x[0] * ratio(h["two"].to_numpy()) + x[1] * ratio(h["one"].to_numpy()) + x[2])).sum()
    best = max(likely(np.array([a, b, 1 - a - b])) for a in np.linspace(0.01, 0.97, 49) for b in np.linspace(0.01, 0.97, 49) if a + b < 0.99)
    assert likely(w[3, 1:]) >= best - 1.0
    assert np.allclose(lm.weights(h.iloc[:0]), [0, 0, 0, 1])


def test_edges(spark):
    assert lm.scored(spark.createDataFrame([], DOC)).count() == 0
    only = next(i for i in range(100) if fold(i) == 2)
    r = lm.scored(spark.createDataFrame([(only, "a b", "")], DOC)).first()
    assert (r["train_tokens"], r["n_known"], r["base_score"], r["score"]) == (0, 0, 0.0, 0.0)


def test_hot_words_and_very_long_texts(spark):
    rows = [(i, "hot " * 300) for i in range(60)] + [(100, "hot word " * 400_000), (101, "x" * 3_000_000), (102, " ".join(f"n{k}" for k in range(200_000)))]
    got = {r["doc_id"]: r for r in lm.scored(spark.createDataFrame([(*x, "") for x in rows], DOC).repartition(3)).collect()}
    c = Counter(w for i, t in rows if fold(i) != 2 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        x = tokens(t)
        assert got[i]["n_tokens"] == len(x) and got[i]["train_tokens"] == n
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x), rel=1e-9)
        assert math.isfinite(got[i]["score"])


def test_blocks_do_not_matter(spark, monkeypatch):
    d = spark.createDataFrame([(*x, "") for x in corpus() if x[0] is not None], DOC)
    a = {(r["doc_id"], round(r["score"], 8)) for r in lm.scored(d).collect()}
    assert a == {(r["doc_id"], round(r["score"], 8)) for r in lm.scored(d.repartition(7)).collect()}


def test_packed_numbers():
    x = np.array([0, 1, 2**63, 2**64 - 1, 77], np.uint64)
    assert (lm._unpacked(lm._packed(x)) == x).all() and len(lm._unpacked(lm._packed(x[:0]))) == 0


def full(rows):
    """Counts as in grams(), of all that stands."""
    c = [Counter(), Counter(), Counter()]
    for _, t in rows:
        x = ["<s>", "<s>", *tokens(t)]
        for k, y in enumerate((x[1:], zip(x, x[1:]), zip(x, x[1:], x[2:]))):
            c[k].update(y)
    return c


def novel():
    """corpus() and texts of rare words, parts of which stand once in training documents and again in held-out ones."""
    r = random.Random(9)
    once = [[f"q{k}_{j}" for j in range(12)] for k in range(40)]
    rows = corpus() + [(2000 + k, " ".join(w)) for k, w in enumerate(once)]
    for k in range(120):
        w = r.choice(once)
        a = r.randrange(9)
        rows.append((3000 + k, " ".join([f"w{r.randrange(40)}", *w[a : a + r.randint(2, 4)], r.choice(w), "w1", "w2"])))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_what_occurs_once_counts(spark, monkeypatch, small):
    """The query's scores and the histogram of the deleted fold, by brute force over all counts; small: in blocks of few texts and ranges in levels."""
    rows = novel()
    if small:
        monkeypatch.setattr(lm, "FAN_BITS", 1)
        monkeypatch.setattr(lm, "RANGE_BYTES", 2400)
        monkeypatch.setattr(lm, "BLOCK_BYTES", 3000)
    seen = {}
    real = lm.weights
    monkeypatch.setattr(lm, "weights", lambda h: seen.setdefault("w", real(seen.setdefault("h", h))))
    monkeypatch.setattr(queries, "table", lambda *a: spark.createDataFrame([(*x, "") for x in rows], DOC).repartition(3))
    got = {r["doc_id"]: r["score"] for r in queries.op2_deleted_interpolation(spark, "").collect()}
    rest, every = (full([(i, t) for i, t in rows if fold(i) not in out]) for out in ((2, 3), (2,)))
    n, v = sum(k for w, k in every[0].items() if w != "<s>"), len(every[0]) - 1
    singles = 0
    for i, t in rows:
        if i == 3:
            continue  # stands twice
        total, x = 0.0, ["<s>", "<s>", *tokens(t)]
        for k in zip(x, x[1:], x[2:]):
            singles += fold(i) == 2 and every[2].get(k) == 1
            bucket, f = ratios(every, n, v, k)
            w = list(seen["w"][bucket])
            if not every[1].get(k[:2]):
                w[0], w[1] = 0.0, w[0] + w[1]
            if not every[0][k[1]]:
                w[1], w[2] = 0.0, w[1] + w[2]
            total += math.log10((sum(a * b for a, b in zip(w, f)) + w[3]) / (v + 1))
        assert got[i] == pytest.approx(total, rel=1e-9)
    assert singles > 20
    left = sum(k for w, k in rest[0].items() if w != "<s>")
    cell = lambda f: round(math.log2(f) * lm.CELLS) + lm.OCTAVES * lm.CELLS if f else -1
    want = Counter()
    for i, t in rows:
        if fold(i) == 3:
            x = ["<s>", "<s>", *tokens(t)]
            for k in zip(x, x[1:], x[2:]):
                bucket, f = ratios(rest, left, v, k)
                want[bucket, *map(cell, f)] += 1
    assert {tuple(map(int, r[:4])): int(r[4]) for r in seen["h"][["bucket", "three", "two", "one", "tokens"]].itertuples(index=False)} == want
