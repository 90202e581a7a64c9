"""Operators on literal rows: order, ties, missing values and errors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverlake.functions import hashes, sparse, vector
from quiverlake.functions.text import tokens
from quiverlake.operators import collection as C
from quiverlake.operators import filters as flt
from quiverlake.operators import fusion, graph, knn, quantize, routing, stats, text_search
from quiverlake.sources.tables import ChangeFeed, KeyValueStore, Snapshots
from quiverlake.streaming import ingest


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def arr(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


# --- vectors --------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    ("metric", "a", "b", "want"),
    [("l2", (1, 0), (0, 1), math.sqrt(2)), ("cosine", (1, 0), (0, 1), 1.0), ("cosine_any", (2, 0), (3, 0), 0.0), ("cosine_any", (0, 0), (3, 0), 1.0), ("ip", (1, 2), (3, 4), -11.0),
     ("hamming", (1, 0, 1), (1, 1, 0), 2.0), ("jaccard", (1, 0, 1), (1, 1, 0), 1 - 1 / 3), ("jaccard", (0, 0), (0, 0), 0.0)],
)
def test_metrics(spark, metric, a, b, want):
    assert value(spark, vector.metric(metric)(arr(*a), arr(*b))) == pytest.approx(want)


def test_metric_registry():
    vector.register_metric("l1", lambda a, b: vector.total(F.zip_with(a, b, lambda x, y: F.abs(x - y))))
    assert "l1" in vector.METRICS
    with pytest.raises(KeyError):
        vector.metric("none")
    del vector.METRICS["l1"]


def test_vector_helpers(spark):
    assert value(spark, vector.normalize(arr(3, 4))) == [0.6, 0.8]
    assert value(spark, vector.normalize(arr(0, 0))) == [0.0, 0.0]
    assert not value(spark, vector.is_valid(F.array().cast("array<double>")))
    assert not value(spark, vector.is_valid(arr(1, float("nan"))))
    assert not value(spark, vector.is_valid(arr(1, float("-inf"))))
    assert value(spark, vector.near(arr(0, 0), arr(0, 0), 0.9)) and not value(spark, vector.near(arr(0, 0), arr(1, 0), 0.9))
    assert value(spark, vector.same(arr(1, 2), arr(1, 2 + 1e-7))) and not value(spark, vector.same(arr(1), arr(1, 2)))
    assert value(spark, vector.convert(F.lit(0.25), "cosine", "ip")) == 0.75
    assert value(spark, vector.convert(F.lit(1.5), "cosine", "ip")) is None
    assert value(spark, vector.convert(F.lit(0.5), "l2", "cosine")) is None


@pytest.mark.parametrize("text", ["", "doc1", "é中😀", "x" * 64])
def test_string_hashes(spark, text):
    h, low = 5381, 14695981039346656037
    for b in text.encode():
        h, low = (h * 33 + b) % 2**64, (low ^ b) * 1099511628211 % 2**64
    assert int(value(spark, hashes.djb2(F.lit(text)))) == h
    assert value(spark, hashes.fnv1a_low(F.lit(text))) == low % 2**32


def test_sparse(spark):
    m = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) if d else F.create_map().cast("map<int,double>")
    a, b = m({0: 1.0, 1: 2.0, 2: 3.0}), m({0: 2.0, 1: 1.0, 3: 5.0})
    assert value(spark, sparse.dot(a, b)) == 4.0
    assert value(spark, sparse.jaccard_similarity(a, b)) == 0.5
    assert value(spark, sparse.jaccard_similarity(m({}), m({}))) == 1.0
    assert value(spark, sparse.jaccard_similarity(a, m({}))) == 0.0
    assert value(spark, sparse.cosine_similarity(a, m({}))) == 0.0
    assert value(spark, sparse.magnitude(m({7: 3.0, 9: -4.0}))) == 5.0
    assert value(spark, sparse.get(a, 9)) == 0.0 and value(spark, sparse.insert(a, 1, 9.0))[1] == 9.0


# --- search ---------------------------------------------------------------------------------------------------------
def points(spark):
    return spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5])], "vec_id long, embedding array<double>")


def test_knn_order_and_ties(spark):
    got = knn.knn(points(spark), [1.0, 0.0], 3).collect()
    assert [r.vec_id for r in got] == [0, 2, 3]
    assert [r.distance for r in got] == pytest.approx([0, 0, math.sqrt(0.5)])
    assert [r.vec_id for r in knn.knn(points(spark), [1.0, 0.0], 9, where=F.col("vec_id") > 0).collect()] == [2, 3, 1]


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_blocks_agree_with_expressions(spark, sf, metric):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    asked = e.filter("vec_id % 9 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    a = knn.knn_batch(e, asked, 7, metric).select("qid", "rk", "vec_id")
    b = knn.knn_blocks(e, asked, 7, metric, block=64).select("qid", "rk", "vec_id")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_too_many_queries_are_not_broadcast(spark, monkeypatch):
    with pytest.raises(ValueError):
        knn._few(spark.range(5), most=4)
    with pytest.raises(ValueError):
        knn.knn_blocks(points(spark), points(spark), 1, "hamming")


def test_filters(spark):
    rows = spark.createDataFrame([(i, "electronics" if i % 2 else None, 10.0 * i) for i in range(1, 6)], "id long, category string, price double")
    ids = lambda f: sorted(r.id for r in f.of(rows).collect())
    assert ids(flt.Gt("price", 25)) == [3, 4, 5]
    assert ids(flt.Eq("category", "electronics") & flt.Gt("price", 20)) == [3, 5]
    assert ids(flt.Ne("category", "electronics")) == [2, 4]
    assert ids(~flt.Prefix("category", "el")) == [2, 4]
    assert ids(flt.And()) == [1, 2, 3, 4, 5] and ids(flt.Or()) == [] and ids(flt.In("category", [])) == []
    assert ids(flt.Exists("category") | flt.Between("price", (20, 20))) == [1, 2, 3, 5]
    assert flt.use_graph(51, 10) and not flt.use_graph(50, 10)


def test_pushdown(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    plan = knn.knn(e, [0.0] * 64, 3, where=flt.Lt("vec_id", 5).where())._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(vec_id,5)" in plan and "TakeOrderedAndProject" in plan
    plan = (flt.Lt("vec_id", 5) & flt.In("label", [1, 2])).of(e).select("vec_id")._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(vec_id,5)" in plan and "In(label" in plan and "embedding:" not in plan


def test_tokens(spark):
    assert value(spark, tokens(F.lit("Hello World! How are you?"))) == ["hello", "world", "how", "are", "you"]
    assert value(spark, tokens(F.lit(" .. "))) == [] and value(spark, tokens(F.lit(None).cast("string"))) == []


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, "hello there"), (3, "goodbye world"), (4, None)], "doc_id long, text string")
    ids = lambda q: {r.doc_id for r in text_search.bm25(docs, q, 10).collect()}
    assert ids("hello") == {1, 2} and ids("") == set() and ids("xyz") == set()
    one, two = (text_search.bm25(docs, q).filter("doc_id = 1").first().score for q in ("hello", "hello hello"))
    assert two == pytest.approx(2 * one)
    n, df, avg = 4, 2, 6 / 4
    assert one == pytest.approx(math.log((n - df + 0.5) / (df + 0.5) + 1) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / avg)))


def test_fusion(spark):
    dense = spark.createDataFrame([(1, 0.2), (2, 3.0)], "doc_id long, distance double")
    score = lambda s: spark.createDataFrame([(1, s)], "doc_id long, score double")
    got = fusion.fuse(dense, score(0.8), score(0.5), 10).collect()
    assert [(r.doc_id, round(r.score, 6)) for r in got] == [(1, 0.77), (2, 0.0)]
    with pytest.raises(ValueError):
        fusion.fuse(dense, None, None, 0)
    with pytest.raises(ValueError):
        fusion.fuse(None, None, None, 1)
    with pytest.raises(ValueError):
        fusion.Weights(0, 0, 0)
    assert fusion.candidates(0) == 1


@pytest.mark.parametrize(("how", "want"), [("minmax", [0.5, 0.5]), ("zscore", [0.0, 0.0]), ("softmax", [0.5, 0.5]), ("none", [2.0, 2.0])])
def test_flat_scores(spark, how, want):
    flat = spark.createDataFrame([(1, 2.0), (2, 2.0)], "doc_id long, score double")
    assert [r.score for r in fusion.normalized(flat, how).collect()] == pytest.approx(want)


# --- compression ----------------------------------------------------------------------------------------------------
def test_bits(spark):
    bits = F.array(*[F.lit(int(x)) for x in "1000000011"])
    assert value(spark, quantize.pack_bits(bits)) == [1, 3]


def test_scalar_codes(spark):
    rows = spark.createDataFrame([(0, [0.0, 5.0]), (1, [1.0, 5.0]), (2, [0.999, 5.0])], "vec_id long, embedding array<double>")
    ranges = quantize.scalar_train(rows)
    coded = quantize.scalar_encode(rows, ranges)
    assert {r.vec_id: r.code for r in coded.collect()} == {0: [0, 0], 1: [255, 0], 2: [254, 0]}
    back = {r.vec_id: r.decoded for r in quantize.scalar_decode(coded, ranges).collect()}
    assert all(abs(b - x) <= 1 / 255 for r in rows.collect() for b, x in zip(back[r.vec_id], r.embedding, strict=True))


def lloyd(x, k, iterations):
    c = x[:k].copy()
    for _ in range(iterations):
        near = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        for i in range(k):
            if (near == i).any():
                c[i] = x[near == i].mean(axis=0)
    return c


def test_pq_training_and_refinement(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id < 150")
    x = np.array([r.embedding for r in rows.orderBy("vec_id").collect()], float)
    keep = lambda df: spark.createDataFrame(df.collect(), df.schema)
    book = keep(quantize.pq_train(rows, 4, 5, 64, iterations=3, store=keep))
    start = quantize.first_codebook(rows, 4, 5, 64)
    moved = {(r.sub, r.code): r.centroid for r in quantize.refine(start, rows, 4, 64).collect()}
    for s in range(4):
        part = x[:, 16 * s : 16 * s + 16]
        want = lloyd(part, 5, 3)
        for r in book.filter(F.col("sub") == s).collect():
            assert r.centroid == pytest.approx(want[r.code].tolist(), abs=1e-9)
        c = part[:5].copy()
        for v in part:
            i = ((c - v) ** 2).sum(axis=1).argmin()
            c[i] = c[i] * 0.99 + v * 0.01
        for i in range(5):
            assert moved[s, i] == pytest.approx(c[i].tolist(), abs=1e-9)


def test_sizes():
    assert quantize.sizes(128, 8, 10)["binary"] == 16 and quantize.sizes(0, 8, 0)["pq_ratio"] == 1.0
    assert quantize.needs_rebuild(100_000) and not quantize.needs_rebuild(99_999)


# --- collections ----------------------------------------------------------------------------------------------------
def test_upsert_policies(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "vec_id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "vec_id long, v string")
    got = lambda p: sorted(map(tuple, C.upsert(old, new, p).collect()))
    assert got("overwrite") == [(1, "a"), (2, "c"), (3, "d")] and got("skip") == [(1, "a"), (2, "b"), (3, "d")]
    with pytest.raises(C.EngineError) as e:
        C.upsert(old, new, "reject")
    assert e.value.code == C.EngineError.DUPLICATE
    with pytest.raises(ValueError):
        C.upsert(old, new, "other")


def test_restore_and_replay(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "vec_id long, v string")
    deltas = spark.createDataFrame([(1, "delete", 1, None), (1, "upsert", 1, "new"), (2, "delete", 2, None), (3, "upsert", 2, "back"), (3, "delete", 3, None)], "delta_ts long, op string, vec_id long, v string")
    assert sorted(map(tuple, C.restore(base, deltas).collect())) == [(1, "new"), (2, "back")]
    feed = spark.createDataFrame([(0, "insert", 1, "a"), (1, "update", 1, "b"), (2, "insert", 2, "c"), (3, "delete", 2, None), (4, "insert", 2, "d")], "seq long, op string, id long, v string")
    assert [(r.id, r.v) for r in C.replay(feed).collect()] == [(1, "b")]
    assert {r.op: r.applied for r in C.replay_counts(feed).collect()} == {"insert": 2, "update": 1, "delete": 1}


def test_migrate_needs_defaults(spark):
    rows = spark.createDataFrame([(1,)], "id long")
    with pytest.raises(C.EngineError):
        C.migrate(rows, {"id": ("long", None, True), "name": ("string", None, True)})
    assert C.migrate(rows, {"name": ("string", "x", True)}).collect()[0].name == "x"


def test_collection_facade(spark):
    c = C.Collection("c", 2, points(spark))
    c.add(spark.createDataFrame([(3, [0.0, 0.0]), (9, [1.0]), (8, [float("nan"), 0.0])], "vec_id long, embedding array<double>"))
    assert c.count() == 4 and {r.error for r in c.errors[0].collect()} == {1001, 1702}
    assert c.get(3).first().embedding == [0.0, 0.0] and [r.vec_id for r in c.scroll(2, 1).collect()] == [1, 2]
    assert c.delete(0).count() == 3 and c.delete_by_filter(flt.Eq("vec_id", 1)).count() == 2
    with pytest.raises(C.EngineError):
        c.search([1.0], 1)


def test_checksum_ignores_order(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label")
    assert C.checksum(e).first() == C.checksum(e.repartition(7).orderBy(F.col("vec_id").desc())).first()


# --- routing, graphs, statistics ------------------------------------------------------------------------------------
def test_admission(spark):
    rows = spark.createDataFrame([(1, i, d) for i, d in enumerate([60, 60, -100, 100, 1])] + [(2, 0, 5)], "tenant long, seq long, delta long")
    assert sorted(map(tuple, routing.admission(rows, 100).collect())) == [(1, 3, 2, 100), (2, 1, 0, 5)]


def test_ring_moves_few_keys(spark):
    keys = spark.range(500).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    nodes = lambda n: spark.range(n).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("node"))
    a, b = ({r.key: r.node for r in routing.on_ring(keys, routing.ring(nodes(n))).collect()} for n in (5, 6))
    moved = [k for k in a if a[k] != b[k]]
    assert len(a) == 500 and all(b[k] == "n5" for k in moved) and len(moved) < 250


def test_graph_and_ivf(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    edges = graph.edges(e, 4)
    assert {r.degree for r in graph.degrees(edges).collect()} == {3}
    centres = graph.ivf_train(e, 8)
    index = graph.ivf_assign(e, centres)
    asked = e.filter("vec_id < 3").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    all_cells = graph.ivf_search(index, centres, asked, 5, 8).select("qid", "rk", "vec_id")
    assert sorted(map(tuple, all_cells.collect())) == sorted(map(tuple, knn.knn_batch(e, asked, 5).select("qid", "rk", "vec_id").collect()))
    x, c = np.array([r.embedding for r in index.collect()]), np.array([r.centre for r in centres.orderBy("cell").collect()])
    assert [r.cell for r in index.collect()] == ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1).tolist()


def test_percentile_places(spark):
    rows = spark.createDataFrame([("a", i) for i in range(100)] + [("b", 7)], "k string, v long")
    assert {r.k: (r.p50, r.p99) for r in stats.percentiles(rows, "k", "v").collect()} == {"a": (50, 99), "b": (7, 7)}


# --- sources and streams --------------------------------------------------------------------------------------------
def test_key_value_store(spark, tmp_path):
    kv = KeyValueStore(spark, str(tmp_path / "kv"))
    kv.put(spark.createDataFrame([("a/1", "x"), ("a/2", "y"), ("b/1", "z")], "key string, value string"), 1)
    kv.put(spark.createDataFrame([("a/1", "new")], "key string, value string"), 2)
    kv.delete(spark.createDataFrame([("a/2",)], "key string"), 3)
    assert [r.value for r in kv.get("a/1").collect()] == ["new"] and kv.scan("a/").count() == 1 and kv.scan().count() == 2


def test_snapshots(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "s"))
    s.write_base(spark.createDataFrame([(1, "a"), (2, "b")], "vec_id long, v string"), 10)
    s.write_delta(spark.createDataFrame([("delete", 1, None), ("upsert", 3, "c")], "op string, vec_id long, v string"), 10, 11)
    assert sorted(map(tuple, s.restore(10, [11]).collect())) == [(2, "b"), (3, "c")] and s.restore(10, []).count() == 2


def test_feed_and_ingest_streams(spark, sf, tmp_path):
    feed = ChangeFeed(spark, str(tmp_path / "feed"), "seq long, op string, id long")
    for k in range(3):
        feed.append(spark.createDataFrame([(k, "insert", 1), (k + 10, "insert", k)], "seq long, op string, id long"))
    assert feed.read(after=1).count() == 4
    ingest.ingest(feed.stream(1), str(tmp_path / "table"), str(tmp_path / "cp")).awaitTermination()
    last = C.latest(spark.read.parquet(str(tmp_path / "table")).drop("batch"), "id", "seq")
    assert {r.id: r.seq for r in last.collect()} == {0: 10, 1: 11, 2: 12}


def test_windows_as_a_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    folder = str(tmp_path / "events")
    events.orderBy("ts").coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(events.schema).parquet(folder)
    ingest.run_available(ingest.windowed_counts(stream), str(tmp_path / "cp"), str(tmp_path / "out"))
    got = {(r.start, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.start, r.event_type): r.n for r in ingest.windowed_counts(events).collect()}
    assert got and all(want[k] == n for k, n in got.items())  # windows that the watermark has closed
    ops = events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("op_key"))
    assert ingest.unique_ops(ops).columns == ["ts", "op_key"]
