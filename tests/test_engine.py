"""Catalogs, schemas, graph walks, hybrid search and rate limits."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverlake.functions.hashes import vector_hash
from quiverlake.operators import catalog, fusion, graph, knn, routing, text_search, walk
from quiverlake.operators.collection import EngineError
from quiverlake.operators.filters import Eq
from quiverlake.sources.scratch import stored
from quiverlake.streaming import ingest

ROWS = "vec_id long, embedding array<double>"


def test_catalog_scopes_tenants(spark):
    c = catalog.Catalog(spark)
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0])], ROWS)
    assert c.add("a", "docs", rows).count() == 2
    assert c.list("a") == ["docs"] and c.list("b") == []
    with pytest.raises(EngineError) as e:
        c.get("b", "docs")
    assert e.value.code == EngineError.MISSING
    with pytest.raises(EngineError) as e:
        c.create("a", "docs", rows, 2)
    assert e.value.code == EngineError.EXISTS
    c.drop("a", "docs")
    assert c.list("a") == []


def test_ids_are_stable(spark):
    rows = spark.createDataFrame([(None, "x"), ("mine", "y"), (None, "z")], "id string, v string")
    a, b = ([r.id for r in catalog.with_ids(rows).orderBy("v").collect()] for _ in range(2))
    assert a == b and a[1] == "mine" and len(set(a)) == 3


@pytest.mark.parametrize(("value", "want"), [("x", "x"), (None, "null"), ([1, 2], "[1,2]"), ({"a": 1}, '{"a":1}'), (True, "true"), (3, "3")])
def test_metadata_as_text(value, want):
    assert catalog.as_text(value) == want


def test_schema_checks():
    ok = catalog.Schema({"title": catalog.VectorField(dim=4), "terms": catalog.VectorField("sparse")}, {"n": "number"})
    assert ok.check() is ok
    for bad in (catalog.Schema({}), catalog.Schema({"a b": catalog.VectorField(dim=1)}), catalog.Schema({"a": catalog.VectorField()}), catalog.Schema({"a": catalog.VectorField("sparse")}, {"x": "date"})):
        with pytest.raises(EngineError):
            bad.check()


def test_migration_states():
    m = catalog.Migration("l2", "cosine", 15_000)
    m.advance()
    assert m.state == "running" and round(m.percent) == 67
    with pytest.raises(EngineError):
        m.roll_back()
    m.advance()
    assert m.state == "completed" and m.roll_back().target == "l2" and m.history == ["pending", "running", "completed"]
    with pytest.raises(EngineError):
        catalog.Migration("l2", "ip", 1).fail().advance()


def test_recovery_states(spark):
    snaps = lambda rows: spark.createDataFrame(rows, "ts long, valid boolean")
    feed = lambda *seqs: spark.createDataFrame([(s,) for s in seqs], "seq long")
    state = lambda s, f: catalog.recovery_plan(s, f).first().state
    assert state(snaps([]), feed()) == "empty" and state(snaps([(1, False)]), feed()) == "corrupted"
    assert state(snaps([(5, True), (9, False)]), feed(3, 6)) == "recovering" and state(snaps([(5, True)]), feed(3)) == "ready"


def test_walk_is_best_first(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id < 200")
    edges = stored(walk.undirected(graph.edges(e, 9)))
    asked = e.filter("vec_id in (150, 151, 152)").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    got = walk.search(e, edges, asked, 0, 10, 40, stored).collect()
    x = {r.vec_id: np.array(r.embedding, float) for r in e.collect()}
    near = {}
    for r in edges.collect():
        near.setdefault(r.src, []).append(r.dst)
    for q in (150, 151, 152):
        dist = lambda i, q=q: float(np.sqrt(((x[i] - x[q]) ** 2).sum()))
        heap, best, seen = [(dist(0), 0)], [(dist(0), 0)], {0}
        while heap:
            d, i = heapq.heappop(heap)
            if len(best) >= 40 and d > sorted(best)[39][0]:
                break
            for j in near.get(i, ()):
                if j not in seen:
                    seen.add(j)
                    heapq.heappush(heap, (dist(j), j))
                    best.append((dist(j), j))
        mine = [r for r in sorted(got, key=lambda r: r.rk) if r.qid == q]
        assert mine[0].vec_id == q and all(r.distance == pytest.approx(dist(r.vec_id)) for r in mine)
        # a step opens all of the ef nearest at once, so no place is further away than a plain walk's
        assert len(mine) == 10 and all(r.distance <= d + 1e-9 for r, (d, _) in zip(mine, sorted(best), strict=False))


def test_greedy_step_and_layers(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.9, 0.1])], ROWS)
    asked = spark.createDataFrame([(7, [0.8, 0.2])], "qid long, qv array<double>")
    entries = spark.createDataFrame([(7, 0), (7, 1), (7, 2)], "qid long, vec_id long")
    assert walk.greedy_step(rows, asked, entries).first().vec_id == 2
    edges = spark.createDataFrame([(0, 1), (0, 2)], "src long, dst long")
    levels = spark.createDataFrame([(0, 2), (1, 0), (2, 1)], "id long, level int")
    layered = walk.layered(edges, levels)
    assert sorted(map(tuple, layered.collect())) == [(0, 0, 1), (0, 0, 2), (1, 0, 2)]
    assert sorted(map(tuple, walk.from_adjacency(walk.adjacency(layered)).collect())) == sorted(map(tuple, layered.collect()))
    assert walk.GraphParameters().m0 == 32


def test_hybrid_search(spark):
    rows = [(1, [1.0, 0.0], "red fox", {0: 1.0}), (2, [0.0, 1.0], "red dog", {1: 2.0}), (3, None, "blue fox", None), (4, [0.6, 0.8], None, {0: 3.0})]
    docs = spark.createDataFrame(rows, "doc_id long, embedding array<double>, text string, sparse map<int,double>")
    got = fusion.search(fusion.HybridQuery([1.0, 0.0], "fox", {0: 1.0}), docs).collect()
    words = {r.doc_id: r.score for r in text_search.bm25(docs, "fox").collect()}
    dense, sparse = {1: 1.0, 2: 0.0, 4: 0.6}, {1: 1.0, 4: 3.0}
    for r in got:
        parts = [(w, s[r.doc_id]) for w, s in ((0.7, dense), (0.2, words), (0.1, sparse)) if r.doc_id in s]
        assert r.score == pytest.approx(sum(w * s for w, s in parts) / sum(w for w, _ in parts))
    assert {r.doc_id for r in got} == {1, 2, 3, 4}
    assert [r.doc_id for r in fusion.search(fusion.HybridQuery(text="fox", where=Eq("doc_id", 3)), docs).collect()] == [3]
    for bad in ({}, {"text": ""}, {"vector": []}, {"text": "x", "k": 0}):
        with pytest.raises(ValueError):
            fusion.HybridQuery(**bad)


def test_vector_hash(spark):
    def brute(v):
        h = 5381
        for b in np.array(v, "<f4").tobytes():
            h = (h * 33 + b) % 2**64
        return str(h)

    rows = [[1.0, -2.5], [], None, [0.1] * 64]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v array<float>").select("i", vector_hash("v").alias("h")).collect()
    assert [r.h for r in sorted(got, key=lambda r: r.i)] == [None if v is None else brute(v) for v in rows]


def test_shard_folders(spark, tmp_path):
    rows = spark.range(100).select("id", F.concat(F.lit("doc"), F.col("id").cast("string")).alias("key"))
    routing.write_by_shard(rows, routing.hash_shard(F.col("key"), 4), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 100 and back.filter("shard = 1").count() == rows.filter(routing.hash_shard(F.col("key"), 4) == 1).count()
    assert routing.shards_of("point", 3, 4, 2) == [3] and routing.shards_of("point", 3, 4, 2, True) == [3, 0] and len(routing.shards_of("search", 0, 4, 1)) == 4


def test_rate_limit_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, i) for i in range(10)] + [(2, 100)], "client long, s long").select("client", F.timestamp_seconds("s").alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "r"))
    stream = ingest.rate_limited(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "r")), rate=0.5, burst=2)
    q = stream.writeStream.format("memory").queryName("limited").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.client: (r.allowed, r.denied) for r in spark.table("limited").collect()} == {1: (6, 4), 2: (1, 0)}


def test_recall_counts_against_all(spark):
    truth = spark.createDataFrame([(0, 1), (0, 2), (1, 5)], "qid long, vec_id long")
    found = spark.createDataFrame([(0, 2), (0, 9)], "qid long, vec_id long")
    assert {r.qid: r.recall for r in knn.recall(found, truth, 2).collect()} == {0: 0.5, 1: 0.0}


def test_layered_graph(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    g = stored(graph.build_layers(e, 8))
    sizes = [r.n for r in g.groupBy("layer", "src").count().groupBy("layer").agg(F.max("count").alias("n")).orderBy("layer").collect()]
    assert sizes[0] <= 16 and max(sizes[1:]) <= 8 and g.filter("src = dst").count() == 0
    nodes = [r.n for r in g.groupBy("layer").agg(F.count_distinct("src").alias("n")).orderBy("layer").collect()]
    assert nodes == sorted(nodes, reverse=True) and nodes[-1] <= 8
    asked = e.filter("vec_id < 6").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    got = walk.descend(e, g, asked, 5, stored, walk.GraphParameters(8, ef_search=30))
    truth = knn.knn_batch(e, asked, 5)
    assert knn.recall(got, truth, 5).agg(F.avg("recall")).first()[0] >= 0.9
