"""List entries of any length in op6."""

import datetime

import pytest

from quiverlake.llm import urls


@pytest.mark.parametrize("most", [urls.BROADCAST_BYTES, 10])
def test_long_patterns_block(spark, monkeypatch, most):
    monkeypatch.setattr(urls, "BROADCAST_BYTES", most)
    day, long = datetime.date(2024, 5, 1), "a.example/" + "x" * 600
    events = spark.createDataFrame([(long, "add", day)], "pattern string, action string, day date")
    captures = spark.createDataFrame([(f"http://{long}/y", day), ("http://a.example/z", day)], "url string, fetched_on date")
    got = {r.url: (r.n_active, r.blocked, r.rule) for r in urls.judge(captures, events).collect()}
    assert got == {f"http://{long}/y": (1, True, long), "http://a.example/z": (0, False, None)}
