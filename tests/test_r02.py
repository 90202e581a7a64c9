"""Cases of the second review: rows that differed from the SQL of a query."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quiverlake.operators import knn, quantize
from quiverlake.sources.scratch import stored


def both(spark, folder, name, **tables):
    """The rows of a query and of its SQL on tables of the test's own, floats with the sign of a zero."""
    db = duckdb.connect()
    for table, rows in tables.items():
        pq.write_table(rows, f"{folder}/{table}.parquet")
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df, want = entry.queries()[name](spark, str(folder)), db.sql(entry.oracle_sql()[name])
    shown = lambda columns, rows: sorted(repr([list(x) if isinstance(x, (list, tuple)) else x for _, x in sorted(zip(columns, r))]) for r in rows)
    return shown(df.columns, [tuple(r) for r in df.collect()]), shown(want.columns, want.fetchall())


def vectors(*rows):
    return pa.table({"vec_id": pa.array(range(len(rows)), pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32())), "label": pa.array([0] * len(rows), pa.int32())})


def test_crash_after_the_newest_snapshot(spark, tmp_path):
    events = pa.table({"event_id": pa.array([1, 2, 4], pa.int64()), "user_id": pa.array([1, 2, 3], pa.int64()), "event_type": ["view", "error", "signup"]})
    got, want = both(spark, tmp_path, "crash_recovery", events=events)
    assert got == want == ["[4, 0, 'recovering']"]


@pytest.mark.parametrize("name", ["sparse_stats", "multivector_dims", "multivector_stats"])
def test_components_at_the_limit(spark, tmp_path, name):
    rows = vectors(*[[0.15, -0.15, 0.2, 0.1500001] + [0.0] * 60 for _ in range(6)])
    got, want = both(spark, tmp_path, name, embeddings=rows)
    assert got == want


def test_normalize_keeps_the_sign_of_a_zero(spark, tmp_path):
    got, want = both(spark, tmp_path, "normalize", embeddings=vectors([1.0, -1e-6, 1e-6, -0.0] + [0.0] * 60))
    assert got == want and "-0.0" in got[0]


def shuffled(spark):
    """Bytes that the session's stages have shuffled so far."""
    context = spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_a_graph_of_all_rows_shuffles_in_proportion(spark):
    v = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.sin(F.col("id") * 7.7 + i * (F.col("id") % 97)).cast("float"))
    per_row = []
    for n in (2_000, 8_000):
        rows = spark.range(n).select(F.col("id").alias("vec_id"), v.alias("embedding"))
        before = shuffled(spark)
        asked = rows.selectExpr("vec_id as qid", "embedding as qv")
        assert knn.knn_blocks(rows, asked, 8, block=100, skip_own=True).count() == 8 * n
        per_row.append((shuffled(spark) - before) / n)
    assert per_row[1] < 1.2 * per_row[0]
    tasks = knn.tasks_wanted(spark)
    for n in (10**5, 10**7, 10**9):
        groups, salts = knn._shares(n, n, 264, 456, tasks)
        assert tasks <= groups * salts and groups + salts <= 2 * tasks


@pytest.mark.parametrize("name", ["ann_ivf", "pq_recall"])
def test_recall_with_more_queries_than_are_broadcast(spark, sf, monkeypatch, name):
    monkeypatch.setattr(knn._few, "__defaults__", (5,))
    assert entry.queries()[name](spark, sf).first().good


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_looked_up_distances_in_blocks(spark, sf, metric):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    book = quantize.first_codebook(e, 5, 7, 64)  # parts of 13, the last one shorter
    coded = stored(quantize.pq_encode(e, book, 5, 64))
    asked = e.filter("vec_id in (3, 8, 40)").selectExpr("vec_id as qid", "embedding as qv")
    got = {(r.qid, r.rk): (r.vec_id, r.distance) for r in quantize.adc_batch(coded, book, asked, 9, metric).collect()}
    for q in asked.collect():
        want = quantize.adc_search(coded, book, list(q.qv), 9, 5, metric).collect()
        assert [got[q.qid, i + 1] for i in range(9)] == [(r.vec_id, r.distance) for r in want]
