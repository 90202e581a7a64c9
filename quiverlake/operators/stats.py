"""Query-trace and index statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trace_stats(traces: DataFrame, by: str | None = None) -> DataFrame:
    """Of traces (duration_us, calcs, nodes): count, mean, least and largest time and mean work; means are whole numbers."""
    group = traces.groupBy(by) if by else traces.groupBy()
    whole = lambda c: F.expr(f"sum({c}) div count(*)")
    return group.agg(F.count("*").alias("total"), whole("duration_us").alias("avg_us"), F.min("duration_us").alias("min_us"), F.max("duration_us").alias("max_us"), whole("calcs").alias("avg_calcs"), whole("nodes").alias("avg_nodes"))


def percentiles(traces: DataFrame, by: str, value: str) -> DataFrame:
    """p50 and p99 of each group by rank: the places n / 2 and ceil(0.99 n), from 0, at most n - 1.

    Values are counted first, so what is ordered within a group is its distinct values, not its rows; nulls are no values."""
    counts = traces.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(by)
    ranked = counts.select(by, value, F.sum("c").over(w.orderBy(value)).alias("upto"), F.sum("c").over(w).alias("n"))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col(value)))
    return ranked.groupBy(by).agg(at(F.floor(F.col("n") / 2)).alias("p50"), at(F.least(F.ceil(F.col("n") * 0.99), F.col("n") - 1)).alias("p99"))


def recent(history: DataFrame, n: int, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    return history.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n)


def field_values(rows: DataFrame, *fields: str) -> DataFrame:
    """field, values and rows of each metadata field."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select("x.*")
    return long.groupBy("field").agg(F.count_distinct("value").alias("n_values"), F.count("value").alias("n_rows"))


def index_stats(n: int, dim: int) -> dict[str, int]:
    """The formula of an index's size: bytes of vectors and graph, edges and layers."""
    return {"memory_bytes": n * dim * 4 + n * 16, "edges": n * 16, "layers": 3}


def health(reports: DataFrame) -> DataFrame:
    """index and advice for each rule that a report (index, vectors, completeness, top_share, failures, new_edges, pruned)
    meets."""
    rules = [
        (F.col("top_share") > 0.9, "rebalance layers", True),
        (F.col("completeness") < 0.8, "rebuild connectivity", True),
        (F.col("failures") > 2, "inspect merges", False),
        (F.col("pruned") > F.col("new_edges") / 2, "raise the edge cap", False),
    ]
    many = F.col("vectors") > 10
    advice = F.filter(F.array(*[F.when((rule & many) if big else rule, say) for rule, say, big in rules]), lambda x: x.isNotNull())
    return reports.select("index", F.explode(advice).alias("advice"))
