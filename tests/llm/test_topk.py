"""Exact top-k against brute force: many shards and blocks, ties, wide numbers, odd rows; and how much of the trees is read."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverlake.llm import topk


def brute_top(queries_, rows, k):
    out = []
    for q, v in queries_:
        ranked = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q and len(w) == len(v))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(ranked)]
    return sorted(out)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", (300, 300))
    monkeypatch.setattr(topk, "QUERY_BLOCK", (20, 20))
    monkeypatch.setattr(topk, "LEAF_ROWS", 32)


def test_top_k(spark, small):
    rng = np.random.default_rng(7)
    rows = [(int(i), [int(x) for x in v]) for i, v in enumerate(rng.integers(-64, 64, (2000, 8)))]
    rows += [(5000 + i, rows[3][1]) for i in range(900)] + [(9000 + i, [1, 2]) for i in range(3)] + [(9999, []), (9998, [])]
    asked = [r for r in rows if r[0] % 50 == 0] + [(9000, [1, 2]), (9999, [])]
    table = lambda r, c: spark.createDataFrame(r, f"{c} long, vector array<long>")
    got = topk.top_k(table(asked + [asked[0], (None, [1] * 8), (4, None), (5, [None] * 8)], "query_id"), table(rows + [(None, [1] * 8), (1, None), (2, [None] * 8)], "vec_id"), 20)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(dict(asked).items(), rows, 20)


def test_repeated_rows_and_large_numbers(spark):
    for big in ((1 << 28) - 1, (1 << 30) + 1):
        rows = [(1, [big, big])] * 3 + [(2, [-big, big]), (3, [0, 1])]
        table = lambda r, c: spark.createDataFrame(r, f"{c} long, vector array<long>")
        got = topk.top_k(table([(1, [big, big]), (2, [-big, big])], "query_id"), table(rows, "vec_id"), 4)
        assert sorted(tuple(r) for r in got.collect()) == brute_top([(1, rows[0][1]), (2, rows[3][1])], rows, 4)
    assert topk.top_k(table([], "query_id"), table(rows, "vec_id"), 4).count() == 0
    assert topk.top_k(table(rows, "query_id"), table([], "vec_id"), 4).count() == 0


def test_finite_vectors_of_any_size(spark, small):
    rng = np.random.default_rng(1)
    v = [rng.normal(size=4) * 10.0 ** rng.integers(-2, 12) for _ in range(900)] + [np.array([5e6, 1.0, 0, 0]), np.array([1e17, -1e17, 1, 0]), np.array([1e300, 0, 0, 0]), np.array([-1.7e308, 0, 0, 0])]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<double>").select("vec_id", topk.whole_components("v").alias("vector"))
    largest, most, top = 1.7976931348623157e308, 10**38 - 1, 2**63 - 1
    whole = lambda x: math.floor(64 * x) if abs(64 * x) <= largest else int(math.copysign(largest, x))
    exact = [[whole(float(c)) for c in x] for x in v]
    asked = [i for i in range(len(v)) if i % 9 == 0 or i >= 900]
    got = topk.top_k(rows.filter("vec_id % 9 = 0 or vec_id >= 900").withColumnRenamed("vec_id", "query_id"), rows, 20)
    want = []
    for q in asked:
        ranked = sorted((-max(-most, min(most, sum(a * b for a, b in zip(exact[q], w, strict=True)))), i) for i, w in enumerate(exact) if i != q)[:20]
        want += [(q, n + 1, i, max(-top - 1, min(top, -s))) for n, (s, i) in enumerate(ranked)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_whole_components(spark):
    rows = [([0.5, -0.01],), ([float("nan")],), ([float("inf")],), ([None],), (None,), ([],), ([5e6, 1.0],), ([1e300],), ([-1.7e308],)]
    got = spark.createDataFrame(rows, "v array<double>").select(topk.whole_components("v").alias("w")).collect()
    assert [r.w for r in got] == [[32.0, -1.0], None, None, None, None, [], [320000000.0, 64.0], [6.4e301], [-1.7976931348623157e308]]


def test_other_columns_with_clashing_names(spark, small):
    rng = np.random.default_rng(3)
    rows = [(i, [int(x) for x in v]) for i, v in enumerate(rng.integers(-9, 9, (700, 3)))]
    table = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    for name in ("query", "query_id", "dim", "cell", "sub", "block", "score", "rank", "count", "copy"):
        table = table.withColumn(name, F.lit("mine"))
    asked = table.filter("vec_id < 30").drop("query_id").withColumn("query_id", F.col("vec_id"))
    assert sorted(tuple(r) for r in topk.top_k(asked, table, 5).collect()) == brute_top(rows[:30], rows, 5)


def clustered(n, dim=16, centres=40):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(centres, dim)) * 400
    return np.floor(base[rng.integers(0, centres, n)] + rng.normal(size=(n, dim)) * 20)


def test_leaves_read(spark, monkeypatch):
    """On clustered vectors most leaves are passed over, in whole shards and within shards."""
    monkeypatch.setattr(topk, "SHARD_ROWS", (200, 200))
    monkeypatch.setattr(topk, "QUERY_BLOCK", (60, 60))
    x = clustered(12_000)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vector array<double>")
    read, offered = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    asked = rows.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    got = sorted(tuple(r) for r in topk.top_k(asked, rows, 20, (read, offered)).collect())
    scores = x[::20] @ x.T
    for i, q in enumerate(range(0, 12_000, 20)):
        s = scores[i].copy()
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(s)), -s))[:20]
        assert got[20 * i : 20 * i + 20] == [(q, n + 1, int(j), int(s[j])) for n, j in enumerate(best)]
    every = 600 * (12_000 / topk.LEAF_ROWS)  # at least
    assert offered.value < 0.5 * every and read.value < 0.25 * every


def test_a_tree_is_opened_best_first():
    """With a k-th score known, no leaf is read whose bound is below it."""
    x = clustered(4_096)
    tree = topk.build(np.arange(len(x)), x)
    s = topk.Search(np.full(1, -1), x[:1], 5, [None], [None])
    s.add(tree)
    assert s.read < s.offered / 4
    again = topk.Search(np.full(1, -1), x[:1], 5, [int(s.scores.min())], [int(s.ids[np.argmin(s.scores)])])
    again.add(tree)
    assert again.read <= s.read and len(again.ids) == 4
    assert sorted(s.scores.tolist(), reverse=True) == sorted((x @ x[0]).tolist(), reverse=True)[:5]
