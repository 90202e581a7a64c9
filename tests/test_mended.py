"""Cases that once gave wrong rows: payloads beside an order, ties, nulls, repeated ids, names as tenants."""

import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverlake.operators import collection as C
from quiverlake.operators import graph, knn, routing


def test_buffer_batches_with_a_payload(spark):
    rows = spark.range(2_000_000, numPartitions=9).select((F.col("id") * 7919 % 2_000_003).alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("payload"), F.lit("mine").alias("batch"))
    got = C.buffer_batches(rows, "id", 10_000).groupBy("batch").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).orderBy("batch").collect()
    assert [(r.batch, r.n) for r in got] == [(i, 10_000) for i in range(200)]
    assert all(a.high < b.low for a, b in zip(got, got[1:]))


def test_chunks_with_ties_and_nulls(spark):
    rows = spark.createDataFrame([(None if i % 9 == 0 else i % 4, i, {"k": str(i)}) for i in range(1000)], "vec_id long, v long, m map<string,string>")
    runs = [sorted(map(str, graph.chunks(rows, 100).select("vec_id", "v", "chunk").collect())) for _ in range(2)]
    assert runs[0] == runs[1]
    got = graph.chunks(rows, 100).collect()
    assert len(got) == 1000 and {r.v for r in got} == set(range(1000))
    order = sorted((r.chunk, r.vec_id is not None, r.vec_id or 0) for r in got)
    assert [x[1:] for x in order] == sorted(x[1:] for x in order)


def test_equal_vectors_in_blocks(spark):
    rows = spark.createDataFrame([(i * 13 % 400, [1.0, 2.0]) for i in range(200)], "vec_id long, embedding array<double>")
    asked = rows.limit(3).selectExpr("vec_id as qid", "embedding as qv")
    a, b = (sorted(map(tuple, f(rows, asked, 5).select("qid", "rk", "vec_id").collect())) for f in (knn.knn_batch, knn.knn_blocks))
    assert a == b


@pytest.mark.parametrize("block", [7, 1_024])
def test_nulls_and_lengths_in_blocks(spark, block):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(60)] + [(100, None), (101, [1.0, None, 2.0]), (102, [1.0]), (103, [2.0]), (104, []), (105, []), (None, [1.0, 1.0, 1.0]), (106, [float("nan"), 0.0, 0.0])]
    rows = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = rows.filter("vec_id < 9 or vec_id > 99").selectExpr("vec_id as qid", "embedding as qv")
    for metric in ("l2", "cosine", "ip"):
        good = rows.filter("vec_id is not null")
        want = sorted(map(str, knn.knn_batch(good, asked, 70, metric).select("qid", "rk", "vec_id").collect()))
        assert sorted(map(str, knn.knn_blocks(rows, asked, 70, metric, block=block).select("qid", "rk", "vec_id").collect())) == want
    assert knn.knn(rows, [0.0, 0.0, 0.0], 99).filter("vec_id in (100, 101, 102)").count() == 0
    assert knn.knn_blocks(rows.limit(0), asked, 3).count() == 0 and knn.knn_blocks(rows, asked.limit(0), 3).count() == 0


def test_every_one_of_equal_rows_has_its_edges(spark):
    rows = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(60)] + [(99, [5.0, 5.0])], "vec_id long, embedding array<double>")
    got = {}
    for r in graph.edges(rows, 5).collect():
        got.setdefault(r.src, []).append(r.dst)
    assert set(got) == {*range(60), 99} and all(sorted(v) == [i for i in range(6) if i != k][:4] for k, v in got.items())


def test_upserts_that_repeat_an_id(spark):
    old = spark.createDataFrame([(1, "a")], "vec_id long, v string")
    new = spark.createDataFrame([(1, "b", 2), (1, "c", 1), (2, "d", 4), (2, "e", 3)], "vec_id long, v string, at long")
    got = lambda p: sorted(map(tuple, C.upsert(old, new, p, order="at").collect()))
    assert got("overwrite") == [(1, "b"), (2, "d")] and got("skip") == [(1, "a"), (2, "e")]
    assert len(C.upsert(old, new.drop("at")).collect()) == 2
    with pytest.raises(C.EngineError):
        C.upsert(old, new.filter("vec_id = 2"), "reject", order="at")


def test_tenants_are_names(spark):
    rows = spark.createDataFrame([("a", 0, 5), ("b", 0, 5), ("a", 1, 9), (None, 0, 1)], "tenant string, seq long, delta long")
    assert sorted(map(str, routing.admission(rows, 10).collect())) == sorted(map(str, [routing_row("a", 1, 1, 5), routing_row("b", 1, 0, 5), routing_row(None, 1, 0, 1)]))


def routing_row(tenant, accepted, rejected, used):
    from pyspark.sql import Row

    return Row(tenant=tenant, accepted=accepted, rejected=rejected, used=used)


def test_flushes(spark):
    rows = [("a", i, i) for i in range(5)] + [("a", 5, 100), ("a", 6, 101), ("b", 0, 0)]
    feed = spark.createDataFrame(rows, "w string, seq long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = sorted(map(tuple, C.flushes(feed, "w", batch=3, seconds=60).collect()))
    assert got == [("a", 0, 3, 0, 2, "size"), ("a", 1, 2, 3, 4, "time"), ("a", 2, 2, 5, 6, "open"), ("b", 0, 1, 0, 0, "open")]
    assert C.flushes(feed.limit(0), "w").count() == 0


def test_a_cluster_needs_a_shared_folder():
    code = """
from quiverlake.sources import scratch
class Context:
    def __init__(self, master, folder): self.master, self.folder = master, folder
    def getCheckpointDir(self): return self.folder
    def setCheckpointDir(self, folder): self.folder = folder
class Session:
    def __init__(self, master, folder=None): self.conf, self.sparkContext = {}, Context(master, folder)
assert scratch.shared_folder(Session("spark://x:1", "hdfs://y/z")) == "hdfs://y/z"
assert scratch.shared_folder(Session("local[3]")).startswith("file://")
for master in ("spark://x:1", "local-cluster[2,1,512]", "yarn"):
    try: scratch.shared_folder(Session(master))
    except RuntimeError: continue
    raise AssertionError(master)
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/", 2)[0])


def test_ids_of_equal_rows(spark):
    from quiverlake.operators.catalog import with_ids

    got = with_ids(spark.createDataFrame([(None, "x")] * 50 + [("mine", "x")], "id string, v string").repartition(3))
    ids = [r.id for r in got.collect()]
    assert len(set(ids)) == 51 and sorted(ids) == sorted(r.id for r in got.collect())


def test_updates_patches_and_snapshots_of_a_collection(spark, tmp_path):
    from quiverlake.sources.tables import Snapshots

    rows = spark.createDataFrame([(1, [1.0, 0.0], {"a": "x"}), (2, [0.0, 1.0], {"b": "y"})], "vec_id long, embedding array<double>, metadata map<string,string>")
    c = C.Collection("c", 2, rows)
    c.patch(spark.createDataFrame([(1, {"a": "z", "c": "w"})], "vec_id long, patch map<string,string>"))
    assert c.get(1).first().metadata == {"a": "z", "c": "w"}
    c.update(spark.createDataFrame([(2, [5.0, 5.0])], "vec_id long, embedding array<double>"))
    assert c.get(2).first().embedding == [5.0, 5.0] and c.get(2).first().metadata is None and c.info().first()["rows"] == 2
    with pytest.raises(C.EngineError) as e:
        c.update(spark.createDataFrame([(9, [5.0, 5.0])], "vec_id long, embedding array<double>"))
    assert e.value.code == 1401
    small = C.Collection("s", 2, rows.drop("metadata"))
    assert small.snapshot(Snapshots(spark, str(tmp_path / "s")), 5).first().n == 2
    assert Snapshots(spark, str(tmp_path / "s")).restore(5, []).count() == 2


def test_slots(spark):
    from quiverlake.operators import fusion, quantize

    schema = "doc_id long, slot string, dense array<double>, sparse map<int,double>"
    slots = spark.createDataFrame([(1, "title", [1.0], None), (2, "title", [2.0], None)], schema)
    new = spark.createDataFrame([(1, "title", [9.0], None), (1, "terms", None, {3: 1.0}), (3, "bad name", [1.0], None), (4, "both", [1.0], {1: 1.0})], schema)
    got = fusion.set_slot(slots, new)
    assert sorted((r.doc_id, r.slot) for r in got.collect()) == [(1, "terms"), (1, "title"), (2, "title")]
    assert fusion.get_slot(got, 1, "title").first().dense == [9.0] and fusion.get_slot(got, 2, "terms").isEmpty()
    assert sorted(r.doc_id for r in fusion.documents_with(got, "title").collect()) == [1, 2]
    assert fusion.remove_slot(got, new.filter("slot = 'title'")).count() == 2
    assert quantize.lookup_table_bytes(8, 256) == 8192 and C.needs_compaction(50_000) and not C.needs_compaction(49_999)


def test_comparisons_need_numbers():
    from quiverlake.operators import filters as flt

    for bad in ("3", None, True):
        with pytest.raises(C.EngineError) as e:
            flt.Lt("price", bad)
        assert e.value.code == 1702
