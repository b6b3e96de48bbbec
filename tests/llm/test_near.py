import random
import re

import numpy as np
import pytest

from kindred.llm import near, shingles
from kindred.llm.common import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, component_id string"


def sets(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """The smallest id that each id reaches by links."""
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    s = [(i, sets(t)) for i, t in rows]
    for k, (i, a) in enumerate(s):
        for j, b in s[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: root(i) for i, _ in rows}


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(2, 7)))
    passage = [word() for _ in range(60)]
    rows = []
    for base in range(6):
        text = [word() for _ in range(r.choice([6, 30, 120, 400]))]
        for _ in range(r.choice([1, 3, 12])):
            t = list(text)
            for _ in range(r.randint(0, max(1, len(t) // 25))):
                t[r.randrange(len(t))] = word()
            rows.append(" ".join(t if r.random() < 0.7 else [x.upper() for x in t]))
    rows += [" ".join([word() for _ in range(n)] + passage + [word() for _ in range(n)]) for n in (5, 8, 10, 20, 40) for _ in range(4)]
    rows += ["", None, "  \n\t", "one", "ONE", "one two", "a b c d e", "A b\tc d\x0be", rows[0], rows[0]]
    r.shuffle(rows)
    return list(enumerate(rows, 10))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    got = {r["doc_id"]: r for r in near.grouped(spark.createDataFrame([(*x, "clash") for x in rows], DOC)).collect()}
    want = brute(rows)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(sets(t)) for i, t in rows}
    assert all(r["kept"] == (i == want[i]) for i, r in got.items())
    kept = near.deduplicated(spark.createDataFrame([(*x, "clash") for x in rows], DOC))
    assert {r["doc_id"] for r in kept.collect()} == {i for i in want if want[i] == i} and kept.columns == ["doc_id", "text", "component_id"]


def test_chain_of_links(spark):
    """Each text links with the next only; the chain is one component."""
    w = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(w[8 * i : 8 * i + 100])) for i in range(20)]
    assert set(brute(rows).values()) == {0}
    assert {r["component_id"] for r in near.grouped(spark.createDataFrame([(*x, "") for x in rows], DOC)).collect()} == {0}


def test_edges(spark):
    assert near.grouped(spark.createDataFrame([], DOC)).count() == 0
    rows = [(None, "a b c d e f", ""), (3, "a b c d e f", ""), (4, "x " * 50_000 + "y", ""), (4, "x " * 50_000 + "y", ""), (None, "q r s t u v", "")]
    got = near.grouped(spark.createDataFrame(rows, DOC)).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in got) == [(-1, -1, True), (-1, 3, False), (3, 3, True), (4, 4, True), (4, 4, True)]
    assert near.deduplicated(spark.createDataFrame(rows, DOC)).filter("doc_id = 4").count() == 1


def test_null_and_repeated_ids(spark):
    """Components are of texts: ids that are null or repeated neither merge different texts nor bring copies back."""
    r = random.Random(8)
    text = lambda: " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(100))
    t = [text() for _ in range(9)]
    near_ = lambda x: x.rsplit(" ", 2)[0] + " changed end"
    rows = [(None, t[0]), (None, t[1]), (None, t[2]), (3, t[2]), (None, near_(t[3])), (4, t[3]), (None, t[4]), (None, t[4]), (None, near_(t[4]))]
    rows += [(5, t[5]), (5, t[6]), (5, near_(t[6])), (6, t[7]), (6, t[8]), (2, t[8]), (6, t[7]), (7, ""), (7, ""), (None, None), (None, "  ")]
    got = near.deduplicated(spark.createDataFrame([(*x, "clash") for x in rows], DOC))
    kept = [(x["doc_id"], x["text"]) for x in got.collect()]
    assert len(kept) == len(set(kept)) and got.columns == ["doc_id", "text", "component_id"]
    fixed = {(None, t[0]), (None, t[1]), (3, t[2]), (4, t[3]), (5, t[5]), (6, t[7]), (2, t[8]), (7, ""), (None, None), (None, "  ")}
    either = [{(None, t[4]), (None, near_(t[4]))}, {(5, t[6]), (5, near_(t[6]))}]
    assert fixed <= set(kept) and [len(x & set(kept)) for x in either] == [1, 1] and len(kept) == len(fixed) + 2


def test_hashes():
    r = random.Random(0)
    texts = ["".join(r.choices("aB \n\t\x0b.é漢", k=r.randint(0, 80))) for _ in range(400)]
    known = {}
    for t, h in zip(texts, shingles.word_hashes(texts), strict=True):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        assert len(w) == len(h)
        for a, b in zip(w, h.tolist(), strict=True):
            assert known.setdefault(a, b) == b
    assert len(set(known.values())) == len(known)
    long = "word " * 10 + "y" * 1_500_000 + " " + "tail end " * 200_000
    got = next(shingles.word_hashes([long]))
    assert len(got) == len(long.split()) and len(np.unique(got)) == 4
    assert (shingles.runs(np.arange(4, dtype=np.uint64)) != shingles.runs(np.arange(4, dtype=np.uint64)[::-1])).all()


def test_components(spark):
    r = random.Random(9)
    for n, m in ((30, 20), (60, 90)):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(100 + i, 101 + i) for i in range(40)]
        up = {}

        def root(x):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for a, b in edges:
            x, y = sorted((root(a), root(b)))
            up[y] = x
        got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: root(x) for x in up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_edges_are_solved_on_the_driver_and_alike(spark, monkeypatch):
    pick = random.Random(9)
    node = lambda: pick.choice([-3, 0, 1 << 62, *range(5, 60)])
    edges = [(node(), node()) for _ in range(45)] + [(k, k + 1) for k in range(100, 160)] + [(7, 7), (None, 4)]
    df = spark.createDataFrame(edges, "a long, b long")
    far = {tuple(r) for r in components(df, few=0).collect()}
    assert len({a for a, _ in far}) == len(far) > 60
    assert {tuple(r) for r in components(df, max_rounds=0).collect()} == far  # no round of the cluster
