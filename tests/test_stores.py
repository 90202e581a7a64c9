"""Stores, batches with statuses, checksums by snapshot, tiers and joined streams."""

import pytest
from pyspark.sql import functions as F

from quiverlake.operators import collection as C
from quiverlake.operators import routing as R
from quiverlake.operators import text_search
from quiverlake.sources.tables import ChangeFeed, GraphSnapshots, KeyValueStore
from quiverlake.streaming import ingest


def test_store_contains(spark, tmp_path):
    store = KeyValueStore(spark, f"{tmp_path}/kv")
    rows = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    store.put(rows, 1)
    store.delete(rows.filter("key = 'b'"), 2)
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "key string")
    assert {tuple(r) for r in store.contains(asked).collect()} == {("a", True), ("b", False), ("c", False)}


def test_cleared_log(spark, tmp_path):
    feed = ChangeFeed(spark, f"{tmp_path}/log", "seq long, op string")
    feed.append(spark.createDataFrame([(1, "a")], "seq long, op string"))
    feed.clear()
    assert feed.read().count() == 0
    feed.append(spark.createDataFrame([(2, "b")], "seq long, op string"))
    assert [tuple(r) for r in feed.read().collect()] == [(2, "b")]


def test_graph_snapshots(spark, tmp_path):
    shots = GraphSnapshots(spark, f"{tmp_path}/graphs")
    assert shots.list() == [] and shots.cleanup(1) == []
    with pytest.raises(C.EngineError):
        shots.load()
    for v in (1, 2, 10):
        shots.save(spark.createDataFrame([(0, v)], "src long, dst long"), v)
    (tmp_path / "graphs" / "version=11").mkdir()  # a writer that has not committed
    assert shots.list() == [1, 2, 10] and shots.load().first().dst == 10 and shots.load(2).first().dst == 2
    assert shots.cleanup(2) == [1] and shots.list() == [2, 10]
    with pytest.raises(C.EngineError):
        shots.load(1)
    assert shots.cleanup(0) == [2, 10] and shots.list() == []


@pytest.mark.parametrize("policy", ["overwrite", "reject"])
def test_statuses_follow_the_order_of_a_batch(spark, policy):
    v, short = [1.0, 2.0], [1.0]
    ops = [
        (1, "delete", 7, None), (2, "insert", 7, v), (3, "insert", 7, short), (4, "insert", 7, v), (5, "delete", 7, None), (6, "delete", 7, None),
        (7, "insert", 1, v), (8, "delete", 1, None), (9, "insert", 1, v), (10, "insert", None, v), (11, None, 1, v), (12, "insert", 8, None),
        (13, "insert", 8, [1.0, None]), (14, "delete", 8, None),
    ]
    table = spark.createDataFrame([(1,), (1,), (2,)], "vec_id long")
    got = C.statuses(table, spark.createDataFrame(ops, "seq long, op string, vec_id long, embedding array<double>"), 2, policy)
    again = 1503 if policy == "reject" else None
    want = {1: 1401, 2: None, 3: 1001, 4: again, 5: None, 6: 1401, 7: again, 8: None, 9: None, 10: 1702, 11: 1702, 12: 1702, 13: 1702, 14: 1401}
    rows = got.collect()
    assert {r.seq: r.error for r in rows} == want and len(rows) == len(ops) and got.columns == ["seq", "op", "vec_id", "embedding", "error"]


def test_checksums(spark):
    df = spark.createDataFrame([(1, 5, None), (1, 6, "x"), (2, 5, None)], "ts long, n long, s string")
    sums = C.checksum(df, "ts")
    assert C.checksum(df.limit(0)).first() == (0, "0")
    changed = df.withColumn("s", F.coalesce("s", F.lit("null")))
    assert {tuple(r) for r in C.verified(df.repartition(3), sums).collect()} == {(1, True), (2, True)}
    assert {tuple(r) for r in C.verified(changed, sums).collect()} == {(1, False), (2, False)}
    assert {tuple(r) for r in C.verified(df.filter("ts = 1"), sums).collect()} == {(1, True), (2, False)}
    assert {tuple(r) for r in C.verified(df.union(df.filter("ts = 2")), sums).collect()} == {(1, True), (2, False)}


def test_tombstones_have_a_reason(spark):
    rows = spark.createDataFrame([(1, 5), (1, 9), (2, 5)], "id long, ts long")
    buried = C.bury(rows, "ttl_expired", F.col("ts"))
    assert {tuple(r) for r in buried.collect()} == {(1, "ttl_expired", 9), (2, "ttl_expired", 5)}
    assert [tuple(r) for r in C.tombstone_stats(buried, 5).collect()] == [("ttl_expired", 2, 1)]
    with pytest.raises(C.EngineError):
        C.bury(rows, "mood", 1)


def test_tiers(spark):
    rows = [("a", "free", 100, 1 << 30, 1, 10), ("b", "free", 101, 0, 1, 1), ("c", "pro", 1, 101 << 30, 1, 1), ("d", "enterprise", 1 << 40, 1 << 60, 1 << 60, 1 << 40), ("e", "gold", 0, 1, 0, 0), ("f", None, 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, "tenant string, tier string, qps long, bytes long, vectors long, collections long")
    got = {r.tenant: (r.within, r.remaining) for r in R.tier_use(df).collect()}
    assert got == {"a": (True, 0), "b": (False, 100), "c": (False, 0), "d": (True, 100), "e": (False, 0), "f": (True, 0)}


def test_even_ranges_wrap():
    bounds = R.even_ranges(300)
    assert bounds[0] == ("0" * 32, "01" + "0" * 30) and bounds[255][1] == "0" * 32 and bounds[256] == bounds[0]


def test_joined_stream(spark, tmp_path):
    """A stream joins as a table does."""
    def side(name, rows):
        spark.createDataFrame(rows, "user long, id long, ts string").selectExpr("user", "id", "ts::timestamp as ts").write.parquet(f"{tmp_path}/{name}")
        return spark.readStream.schema("user long, id long, ts timestamp").parquet(f"{tmp_path}/{name}"), spark.read.parquet(f"{tmp_path}/{name}")

    a, at = side("a", [(1, 10, "2024-01-01 10:00:00"), (2, 11, "2024-01-01 10:00:00"), (None, 12, "2024-01-01 10:00:00")])
    b, bt = side("b", [(1, 20, "2024-01-01 10:30:00"), (1, 21, "2024-01-01 11:00:00"), (1, 22, "2024-01-01 11:00:01"), (2, 23, "2024-01-01 09:59:59"), (None, 24, "2024-01-01 10:30:00")])
    ingest.run_available(ingest.joined(a, b, "user"), f"{tmp_path}/check", f"{tmp_path}/out")
    got = {(r.user, r.a, r.b) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(r.user, r.a, r.b) for r in ingest.joined(at, bt, "user").collect()} == {(1, 10, 20), (1, 10, 21)}


def test_idf_counts_rows(spark):
    docs = spark.createDataFrame([(1, "a a b"), (1, "A"), (2, None), (3, "")], "doc_id long, text string")
    assert {(r.term, r.df) for r in text_search.idf(docs).collect()} == {("a", 2), ("b", 1)}
