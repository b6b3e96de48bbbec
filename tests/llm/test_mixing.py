import random

import pytest

from kindred.llm import mixing

DOC = "doc_id long, text string, source string, target string"


def water(sizes, share=1.5):
    """Targets by resharing round after round."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {s: 0.0 for s in names}
    while left > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        for s in list(open_):
            out[s] += left * w[s] / total
        left = 0.0
        for s in list(open_):
            if out[s] >= 2 * sizes[s]:
                left += out[s] - 2 * sizes[s]
                out[s] = 2.0 * sizes[s]
                open_.discard(s)
    return out


def corpus(seed, n=300):
    r = random.Random(seed)
    return [(i, " ".join(["w"] * r.choice([0, 1, 5, 40, 200])) if r.random() > 0.03 else None, r.choice(["a", "b", "B", "é", None] + ["hot"] * 5), "clash") for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_taken(spark, seed):
    rows = corpus(seed)
    got = mixing.result(spark.createDataFrame(rows, DOC)).collect()
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = water(sizes)
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["size"] == len((rows[r["doc_id"]][1] or "").split()) and (r["size"] == 0) <= (r["taken"] == 0)
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, n in taken.items():
        assert abs(n - want[s]) <= 100 + 1e-6  # half the largest document
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.result(spark.createDataFrame(rows[::-1], DOC).repartition(5)).collect())) if all(r["source"] is not None for r in got) else True


def test_selection_is_the_sorted_prefix(spark):
    rows = corpus(3)
    d = spark.createDataFrame(rows, DOC)
    keyed = {r["doc_id"]: (r["_m_key"], r["_m_tie"]) for r in mixing.sized(d).collect()}
    by = {}
    for r in mixing.result(d).collect():
        by.setdefault(r["source"], []).append(r)
    for group in by.values():
        room = group[0]["target"]
        epochs = int(room // group[0]["source_size"]) if group[0]["source_size"] else 0
        room -= epochs * group[0]["source_size"]
        before = 0
        for r in sorted(group, key=lambda r: keyed[r["doc_id"]]):
            extra = before + r["size"] / 2 <= room and room > 0
            before += r["size"]
            assert r["taken"] == r["size"] * (epochs + extra)


def test_mixed_repeats_rows(spark):
    rows = corpus(4)
    d = spark.createDataFrame(rows, DOC)
    want = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.result(d).filter("size > 0").collect()}
    out = mixing.mixed(d)
    assert out.columns == d.columns
    got = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_edges(spark):
    assert mixing.result(spark.createDataFrame([], DOC)).count() == 0
    none = mixing.result(spark.createDataFrame([(1, None, None, ""), (2, "", "a", "")], DOC)).collect()
    assert [(r["size"], r["taken"], r["target"]) for r in none] == [(0, 0, 0.0)] * 2
    same = mixing.result(spark.createDataFrame([(7, "a b", "s", "")] * 4, DOC)).collect()
    assert sorted(r["taken"] for r in same) == [2, 2, 4, 4]  # 8 words, target 12
    plan = mixing.result(spark.createDataFrame(corpus(1), DOC))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_equal_rows_are_taken_as_often_as_fits(spark):
    equal = [(1, "one two three", "s", str(i)) for i in range(900)]
    rows = equal + [(i, "w " * (i % 7), "s", "") for i in range(2, 200)] + [(5, "a b c", "t", "")] * 50
    d = spark.createDataFrame(rows, DOC).repartition(6)
    got = mixing.result(d).collect()
    for s in "st":
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 3 and all(r["taken"] <= 2 * r["size"] for r in mine)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.result(d).collect()))
    out = mixing.mixed(d)
    assert out.columns == d.columns
    want = {}
    for r in got:
        want[r["doc_id"], r["source"]] = want.get((r["doc_id"], r["source"]), 0) + (r["taken"] // r["size"] if r["size"] else 0)
    have = {(r["doc_id"], r["source"]): r["count"] for r in out.groupBy("doc_id", "source").count().collect()}
    assert have == {k: v for k, v in want.items() if v}
    assert out.filter("doc_id = 1").select("target").distinct().count() >= 450  # rows of their own, beside the equal columns
