"""Every registered query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = sorted(n for n in entry.queries() if not (n.startswith("op") and n[2].isdigit()) and n != "pipeline")


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for name in NAMES:
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return c


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return ("null",) if v is None or (isinstance(v, float) and math.isnan(v)) else (str(round(v, 4) + 0.0) if isinstance(v, float) else str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", [n for n in OWN if n in entry.oracle_sql()])
def test_against_sql(spark, sf, db, name):
    df, want = entry.queries()[name](spark, sf), db.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(want.columns, want.fetchall())


@pytest.mark.parametrize("name", [n for n in OWN if n not in entry.oracle_sql()])
def test_without_sql(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["qid", "rk", "vec_id", "distance"] and df.count() == 25


def test_names_without_a_session_or_the_training_operators():
    import os
    import subprocess
    import sys

    code = "import sys; sys.modules['quiverlake.llm'] = {0}; import __spark_entry__ as e; print(*e.queries())"
    run = lambda block: subprocess.run([sys.executable, "-c", code.format(block)], cwd=os.path.dirname(entry.__file__), capture_output=True, text=True, check=True).stdout.split()
    without = run("None")
    assert set(without) == set(OWN) and "knn_l2_batch" in without
