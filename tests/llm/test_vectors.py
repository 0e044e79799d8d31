import numpy as np
import pytest

from tracewell.llm import vectors as V


def clustered(n, dim, seed):
    r = np.random.default_rng(seed)
    c = r.normal(size=(n // 8 + 1, dim))
    return c[r.integers(0, len(c), n)] + 0.35 * r.normal(size=(n, dim))


def brute(x, k, least):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i], kind="stable")[:k] if s[i, j] >= least}


@pytest.mark.parametrize("part,answers", [(15_000, 60_000), (150, 100)])
def test_recall(spark, monkeypatch, part, answers):
    monkeypatch.setattr(V, "SHARD_MOST", part)
    monkeypatch.setattr(V, "ANSWERS", answers)
    x = clustered(1500, 24, 3)
    df = spark.createDataFrame([(f"k{i:05}", [float(a) for a in v], 1) for i, v in enumerate(x)], "name string, v array<float>, cls int")
    got = {(int(r.a[1:]), int(r.b[1:])) for r in V.similar_pairs(df, "name", "v", 24, 8, 0.8).collect()}
    want = brute(x.astype(np.float32), 8, 0.8)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [("a", v), ("b", v), ("b", v), ("c", [2.0, 4.0, 6.0, 8.0]), ("d", None), ("e", []), ("f", [0.0] * 4), ("g", [1.0]), ("h", [1.0, None, 1.0, 1.0]), ("i", [float("nan")] * 4), (None, v), ("j", [-1.0, -2.0, -3.0, -4.0])]
    got = {(r.a, r.b) for r in V.similar_pairs(spark.createDataFrame(rows, "key string, part array<double>"), "key", "part", 4, 8, 0.8).collect()}
    assert got == {(x, y) for x in "abc" for y in "abc" if x != y}


def test_many_equal(spark):
    rows = [(f"k{i:03}", [1.0, 2.0]) for i in range(60)] + [("z", [1.0, 2.05])]
    got = V.similar_pairs(spark.createDataFrame(rows, "name string, v array<double>"), "name", "v", 2, 8, 0.8).collect()
    per = {}
    for r in got:
        per.setdefault(r.a, []).append(r)
    assert set(per) == {k for k, _ in rows} and all(len(x) == 8 for x in per.values())
    assert {r.b for r in per["k000"]} == {f"k{i:03}" for i in range(1, 9)}


def test_empty(spark):
    assert V.similar_pairs(spark.createDataFrame([], "name string, v array<float>"), "name", "v", 4, 8, 0.8).count() == 0


@pytest.mark.parametrize("n", [1, 2, 17])
def test_small_graphs(n):
    x = V.unit(np.random.default_rng(n).normal(size=(n, 8)))
    ids, cos = V.Graph(x).search(x, np.arange(n), 40)
    assert (ids[:, 0] == np.arange(n)).all() and np.allclose(cos[:, 0], 1, atol=1e-5)
    assert all(set(r[r >= 0]) == set(range(n)) for r in ids)
