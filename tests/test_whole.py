"""Queries over whole tables: what their SQL, or an earlier form of them, left out."""

import duckdb
import numpy as np
import pytest
from test_entry import rows_of

from quiverlake.operators import duplicates, knn
from quiverlake.plans import all_queries

QUERIES = all_queries()[0]


# --- copies of vectors ----------------------------------------------------------------------------------------------
def brute_classes(vectors, tolerance=1e-6):
    root = {}
    for i, a in vectors:
        linked = {root[j] for j, b in vectors if j in root and len(a) == len(b) and all(abs(x - y) < tolerance for x, y in zip(a, b, strict=True))}
        root[i] = min([i, *linked])
        root |= {j: root[i] for j, r in root.items() if r in linked}
    return {(i, r) for i, r in root.items() if i != r}


def test_duplicates(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(150, 8)).round(3)
    base[:20] = 0
    base[20:40] = base[20] * 1e7
    base[60:90] = base[60] + rng.uniform(-2e-6, 2e-6, size=(30, 8))  # some within the tolerance, some through others
    base[90:100] = base[90] + np.arange(10)[:, None] * 9e-7  # a chain
    base[100:110] = base[100] + np.arange(10)[:, None] * 1.1e-6
    base[[140, 130]] = base[[50, 51]]
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    odd = [(200, None), (201, [float("nan")] * 8), (202, [float("nan")] * 8), (203, [None] * 8), (204, [None] * 8), (205, [float("inf")] * 8), (206, [float("inf")] * 8), (207, [0.0] * 7)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(5)
    got = [tuple(r) for r in duplicates.duplicates(df).collect()]
    want = brute_classes(rows)
    assert len(got) == len(set(got)) and set(got) == want
    assert {(140, 50), (130, 51), (99, 90)} <= want and not any(100 < a < 110 for a, _ in want)


def test_exact_duplicates_meets_every_pair_of_ids(spark, tmp_path):
    v = [[float(i), 1.0] for i in range(300)]
    v[250], v[7] = v[150], v[3]
    spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {tuple(r) for r in QUERIES["exact_duplicates"](spark, str(tmp_path)).collect()} == {(250, 150), (7, 3)}


# --- queries that give a row for every row of a table ------------------------------------------------------------------
ROWS_OF = {"normalize": "embeddings", "sparse_similarities": "embeddings", "binary_decode": "embeddings", "scalar_decode": "embeddings", "metadata_coercion": "events"}


@pytest.mark.parametrize("name", [*ROWS_OF, "metric_convert", "idf"])
def test_every_row_is_given(spark, name):
    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    for table in ("documents", "embeddings", "events"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = db.sql(all_queries()[1][name])
    df = QUERIES[name](spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got == rows_of(want.columns, want.fetchall())
    if name in ROWS_OF and name != "sparse_similarities":
        assert len(got) == db.sql(f"SELECT count(*) FROM {ROWS_OF[name]}").fetchall()[0][0]


# --- ties in block products -------------------------------------------------------------------------------------------
@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_blocks_break_ties_by_id_however_many_tie(spark, metric):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(900, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[rng.permutation(900)[:400]] = v[5]  # one vector 400 times
    v[::9] = np.roll(np.eye(16)[0], 1)
    v[1::18] = np.eye(16)[2]  # others at one distance from it
    v[4::18] = np.eye(16)[7]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    asked = rows.filter("vec_id % 10 = 0 or vec_id < 30").selectExpr("vec_id as qid", "embedding as qv")
    want = sorted(map(tuple, knn.knn_batch(rows, asked, 10, metric).select("qid", "rk", "vec_id", "distance").collect()))
    for block in (4_096, 200):
        assert sorted(map(tuple, knn.knn_blocks(rows, asked, 10, metric, block=block).select("qid", "rk", "vec_id", "distance").collect())) == want


def test_blocks_with_distances_that_rounding_makes_equal(spark):
    v = [[1e8 + i * 1e-9, 0.0] for i in range(60)] + [[float(i), 1e-9 * i] for i in range(60)] + [[1e-30 * i, 0.0] for i in range(60)]
    rows = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")
    asked = rows.filter("vec_id % 7 = 0").selectExpr("vec_id as qid", "embedding as qv")
    for metric in ("l2", "cosine", "ip"):
        a, b = (sorted(map(tuple, f(rows, asked, 5, metric).select("qid", "rk", "vec_id", "distance").collect())) for f in (knn.knn_batch, knn.knn_blocks))
        assert a == b


# --- near pairs -----------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("group", [4_096, 16])
def test_near_pairs(spark, group):
    from pyspark.sql import functions as F

    from quiverlake.functions.vector import near

    rng = np.random.default_rng(3)
    v = rng.normal(size=(160, 6))
    v[150:] = 0
    v[40:60] = v[40] * np.arange(1, 21)[:, None]  # one direction
    rows = [(i, 1 if i % 3 else i % 2, x.tolist()) for i, x in enumerate(v)]
    odd = [(200, 1, None), (201, 1, [None] * 6), (202, 1, [float("nan")] * 6), (203, None, [1.0] * 6), (None, 1, [1.0] * 6), (204, 1, [1.0] * 5), (205, 1, [2.0] * 5), (205, 1, [2.0] * 5), (206, 1, []), (207, 1, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, label int, embedding array<double>").repartition(5)
    got = [tuple(r) for r in duplicates.near_pairs(df.withColumn("own", F.lit(1)), "label", 0.6, group=group).select("a", "b").collect()]
    good = df.filter("vec_id != 202 and label is not null")
    pairs = good.alias("x").join(good.alias("y"), F.expr("x.label = y.label and x.vec_id < y.vec_id and size(x.embedding) = size(y.embedding)"))
    want = [tuple(r) for r in pairs.filter(near("x.embedding", "y.embedding", 0.6)).select("x.vec_id", "y.vec_id").collect()]
    assert sorted(got) == sorted(want) and {(40, 41), (204, 205), (206, 207)} <= set(got) and (205, 205) not in got
    assert duplicates.near_pairs(df.limit(0), "label", 0.6).count() == 0
