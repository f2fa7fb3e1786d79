"""Exact top-k against a full sort."""

import math

import numpy as np

from scriptsift.llm.topk import choose_pivots, pivot_table, search_block, top_k


def brute(rows, k=20, asks=lambda i: i % 20 == 0):
    good = [
        (n, i, [math.floor(64 * float(x)) for x in v]) for n, (i, v) in enumerate(rows)
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in good:
        if asks(i):
            found = sorted(((-sum(a * b for a, b in zip(q, v)), j) for m, j, v in good if m != n and len(v) == len(q)))[:k]
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(found)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    assert found(top_k(table)) == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, None), (40, [1.0, None]), (60, [nan, 1.0]), (80, [inf, 0.0]), (100, []),
            (120, [1.0, 2.0, 3.0]), (140, [0.5]), (None, [1.0, 1.0]), (3, [1.0, 2.0]), (2, [1.0, 2.0]), (5, [-0.001, 0.0]),
            (160, [-3.0, 1e6]), (-20, [2.0, 2.0])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, id string, v int")
    assert found(top_k(table)) == brute(rows)
    assert found(top_k(table.filter("false"))) == []
    assert found(top_k(table.filter("vec_id = 3"))) == []


def test_many_blocks_ties_and_groups(spark, monkeypatch):
    from scriptsift.llm import topk
    for name, value in (("BLOCK", 40), ("QUERY_BLOCK", 7), ("FAN", 3)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(4)
    vectors = rng.integers(-2, 3, (600, 6)) / 64
    vectors[:200] = vectors[0]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(top_k(table)) == brute(rows)


def test_bounds_hold_and_the_search_is_exact():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 40, (12, 16))
    x = np.floor(centres[rng.integers(0, 12, 900)] + rng.normal(0, 4, (900, 16))).astype(np.int64)
    q = x[:50]
    pivots = choose_pivots(x[:300].astype(np.float64), 24)
    table, own = pivot_table(x, pivots), pivot_table(q, pivots)
    distance = np.sqrt(((q[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    lower = np.abs(own[:, :, None] - table[:, None, :]).max(axis=0)
    assert (lower <= distance + 1e-2).all()
    best = search_block(q, np.arange(50), own, x, np.arange(900), np.arange(900), table, 10)
    for n, (scores, ids) in enumerate(best):
        want = sorted(((-int(q[n] @ x[m]), m) for m in range(900) if m != n))[:10]
        assert list(zip((-scores).tolist(), ids.tolist())) == want


def test_pivots_of_equal_vectors():
    assert len(choose_pivots(np.ones((5, 3)), 4)) == 1
    assert len(choose_pivots(np.ones((0, 3)), 4)) == 0
