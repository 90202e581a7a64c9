"""Walks through graphs in segments: one pass over rows and queries, the nearest of all segments."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quiverlake.functions.vector import METRICS
from quiverlake.operators import graph, knn, walk
from quiverlake.sources.scratch import stored

ROWS = "vec_id long, embedding array<double>"


def test_a_walk_stores_its_nodes_once_however_many_steps_it_takes(spark):
    rows = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(30)], ROWS)
    chain = spark.createDataFrame([(i, i + 1) for i in range(29)], "src long, dst long")
    asked = spark.createDataFrame([(7, [29.2, 0.0]), (8, [3.9, 0.0])], "qid long, qv array<double>")
    calls = []

    def store(df):
        calls.append(df)
        return stored(df)

    got = {r.qid: r for r in walk.search(rows, walk.undirected(chain), asked, 0, 1, 2, store).collect()}
    assert len(calls) == 1
    assert (got[7].vec_id, got[7].distance, got[7].visited) == (29, pytest.approx(0.2), 30)
    assert (got[8].vec_id, got[8].rk) == (4, 1) and got[8].visited < 10
    layers = chain.select(F.lit(0).alias("layer"), "src", "dst").union(spark.createDataFrame([(1, 0, 20), (1, 20, 0)], "layer int, src long, dst long"))
    layers = layers.union(layers.select("layer", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    calls.clear()
    down = {r.qid: r for r in walk.descend(rows, layers, asked, 1, store, walk.GraphParameters(ef_search=2)).collect()}
    assert len(calls) == 1 and down[7].vec_id == 29 and down[8].vec_id == 4
    assert down[7].visited < 15  # from 20, not from 0


def nearest_of(x, near, q, start, ef):
    """A plain walk that opens all of the ef nearest at once."""
    dist = lambda i: float(np.sqrt(((x[i] - q) ** 2).sum()))
    seen, opened = {start: dist(start)}, set()
    while front := [i for i in sorted(seen, key=lambda i: (seen[i], i))[:ef] if i not in opened]:
        opened |= set(front)
        seen |= {j: dist(j) for i in front for j in near.get(i, ()) if j not in seen}
    return seen


@pytest.mark.parametrize("tasks", [1, 7])
def test_segments_give_the_nearest_of_each(spark, sf, monkeypatch, tasks):
    monkeypatch.setattr(walk, "WALKS", 1)
    monkeypatch.setattr(walk, "tasks_wanted", lambda spark: tasks)
    monkeypatch.setattr(walk, "REACHED", 16)
    monkeypatch.setattr(walk, "CELLS", 200)
    e, segment = graph.segments(spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id < 200"), size=50)
    edges = stored(walk.undirected(graph.edges(e, 5, key=segment)))
    asked = e.filter("vec_id in (3, 8, 40, 150)").selectExpr("vec_id as qid", "embedding as qv")
    got = sorted(walk.search(e, edges, asked, None, 6, 9, stored, segment=segment).collect(), key=lambda r: (r.qid, r.rk))
    rows, near = e.collect(), {}
    x, part = {r.vec_id: np.array(r.embedding, float) for r in rows}, {r.vec_id: r.segment for r in rows}
    for r in edges.collect():
        near.setdefault(r.src, []).append(r.dst)
        assert part[r.src] == part[r.dst]
    assert segment == ("segment", 4) and set(part.values()) == {0, 1, 2, 3}
    for q in (3, 8, 40, 150):
        seen = {}
        for s in range(4):
            seen |= nearest_of(x, near, x[q], min(i for i in part if part[i] == s), 9)
        want = sorted(seen, key=lambda i: (seen[i], i))[:6]
        mine = [r for r in got if r.qid == q]
        assert [r.vec_id for r in mine] == want and [r.rk for r in mine] == [1, 2, 3, 4, 5, 6]
        assert {r.visited for r in mine} == {len(seen)} and mine[0].vec_id == q


def test_layers_of_each_segment(spark, sf):
    e, segment = graph.segments(spark.read.parquet(f"{sf}/embeddings.parquet"), size=60)
    g = stored(graph.build_layers(e, 6, key=segment))
    part = {r.vec_id: r.segment for r in e.select("vec_id", "segment").collect()}
    edges = g.collect()
    assert all(part[r.src] == part[r.dst] for r in edges) and {r.src for r in edges} == set(part)
    for s in set(part.values()):
        own = [(r.layer, r.src) for r in edges if part[r.src] == s]
        top = max(layer for layer, _ in own)
        assert top > 0 and len({i for layer, i in own if layer == top}) <= 13
    one = spark.createDataFrame([(5, [1.0, 2.0])], ROWS)
    alone = walk.descend(one, graph.build_layers(one, 6), one.selectExpr("vec_id + 1 as qid", "embedding as qv"), 3, stored)
    assert [tuple(r) for r in alone.select("qid", "rk", "vec_id", "distance").collect()] == [(6, 1, 5, 0.0)]


@pytest.mark.parametrize(("name", "few"), [("graph_walk", 16), ("graph_descent", 16), ("graph_descent", 2)])
def test_recall_of_many_segments(spark, sf, monkeypatch, name, few):
    monkeypatch.setattr(graph.segments, "__defaults__", ("vec_id", 40, few))
    assert entry.queries()[name](spark, sf).first().good


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip", "cosine_any", "hamming", "jaccard"])
def test_metrics_of_a_walk(spark, sf, metric):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id < 60").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 5).alias("embedding"))
    asked = e.filter("vec_id in (3, 8)").selectExpr("vec_id as qid", "embedding as qv")
    edges = walk.undirected(graph.edges(e, 60))
    got = walk.search(e, edges, asked, 0, 8, 60, stored, metric)
    want = knn.knn_batch(e, asked, 8, metric)
    rows = lambda df: sorted((r.qid, r.rk, r.vec_id, round(r.distance, 9)) for r in df.collect())
    assert metric in METRICS and rows(got) == rows(want)
