import numpy as np
import pytest

from kindred.llm import graph

SCHEMA = "vec_id long, embedding array<float>, label int, vector string"


def brute(rows, threshold=0.95):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and np.linalg.norm(v) > 0]
    u = np.array([v / np.linalg.norm(v) for _, v in ok])
    near = u @ u.T >= threshold
    ids = np.array([i for i, _ in ok])
    label = np.arange(len(ok))
    while True:
        new = np.array([label[near[k]].min() for k in range(len(ok))])
        if (new == label).all():
            break
        label = new
    smallest = {c: min(ids[label == c]) for c in set(label)}
    return {int(i): (int(near[k].sum()) - 1, int(smallest[label[k]])) for k, i in enumerate(ids)}


def corpus(seed, n=500):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        rows.append((r.normal(size=16) if i % 4 or not rows else rows[r.integers(len(rows))] + r.normal(size=16) * 0.12).astype(np.float32))
    hot = r.normal(size=16)
    rows += [(hot + r.normal(size=16) * 0.1).astype(np.float32) for _ in range(150)] + [rows[0]] * 30
    return [(i, v.tolist()) for i, v in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(graph, "SHARD", 100)
    rows = corpus(seed)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in graph.grouped(spark.createDataFrame([(i, v, 0, "") for i, v in rows], SCHEMA)).collect()}
    want = brute(rows)
    true, found = sum(n for n, _ in want.values()), sum(min(got[i][0], n) for i, (n, _) in want.items())
    assert found >= 0.98 * true and all(got[i][0] <= n for i, (n, _) in want.items())
    assert sum(got[i][1] == c for i, (_, c) in want.items()) >= 0.98 * len(want)


def test_blocks_of_a_large_shard(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 64)
    rows = corpus(3, 200)
    got = {r["vec_id"]: r["n_links"] for r in graph.grouped(spark.createDataFrame([(i, v, 0, "") for i, v in rows], SCHEMA)).collect()}
    want = brute(rows)
    assert sum(got.values()) >= 0.98 * sum(n for n, _ in want.values()) and all(got[i] <= want[i][0] for i in want)


def test_invalid_vectors(spark):
    rows = [(1, [1.0, 0.0], 0, ""), (2, [2.0, 0.0], 0, ""), (3, None, 0, ""), (4, [], 0, ""), (5, [0.0, 0.0], 0, ""), (6, [1.0, None], 0, ""), (7, [float("nan"), 1.0], 0, ""), (8, [float("inf"), 1.0], 0, ""), (9, [1.0, 0.0, 0.0], 0, ""), (2, [2.0, 0.0], 1, "")]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in graph.grouped(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False)] + [(i, 0, i, True) for i in range(3, 10)]
    assert graph.grouped(spark.createDataFrame([], SCHEMA)).count() == 0
    assert graph.grouped(spark.createDataFrame(rows[2:4], SCHEMA)).filter("kept").count() == 2


def test_cells_with_centres_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(graph, "SHARD", 40)
    monkeypatch.setattr(graph, "MOST_SHARDS", 4)
    monkeypatch.setattr(graph, "BLOCK", 64)
    rows = corpus(4, 300)
    out = graph.grouped(spark.createDataFrame([(i, v, 0, "") for i, v in rows], SCHEMA)).collect()
    got, want = {r["vec_id"]: r["n_links"] for r in out}, brute(rows)
    assert sum(got.values()) >= 0.97 * sum(n for n, _ in want.values()) and all(got[i] <= want[i][0] for i in want)
    assert out[0]["recall"] >= 0.98


def test_double_precision_whatever_the_scale(spark):
    rows = [(1, [1e300, 1e300]), (2, [1e300, 1e300]), (3, [2e-60, 2e-60]), (4, [1e-320, 0.0]), (5, [1.0, 1e-9]), (6, [-1.0, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in graph.grouped(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6)}


def test_low_recall_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(graph, "audited", lambda *a: 0.5)
    monkeypatch.setattr(graph, "WIDEST", 1)
    with pytest.raises(RuntimeError, match="0.5"):
        graph.grouped(spark.createDataFrame([(i, v, 0, "") for i, v in corpus(5, 20)], SCHEMA))


def test_audit_sees_small_groups(spark):
    rows = corpus(6, 60)
    every, classes = graph.classed(graph.vectors(spark.createDataFrame([(i, v, 0, "") for i, v in rows], SCHEMA)))
    counts, _ = graph.linked(classes, classes.count(), "<f4")
    assert graph.audited(classes, counts, "<f4") >= 0.98
    assert graph.audited(classes, counts.filter("n_links > 100"), "<f4") < 0.98  # the small groups' links are missing
