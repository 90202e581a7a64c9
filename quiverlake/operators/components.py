"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import drop_stored, stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node that it reaches) of each node on an edge ``(u long, v long)``.

    Alternates the large-star and small-star steps of Kiveris et al. (2014): each node's neighbours are tied to the
    smallest of them, the larger ones first, until nothing changes; rounds grow with the logarithm of the longest path.
    Minima combine before the shuffle, the edges stay in tables, and nothing but a count and a checksum reaches the
    driver. Edges may repeat; loops and edges with a null are left out, so a table of only such gives no row.
    """
    now = stored(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u != v")
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(least, "u").filter("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        small = stored(small.union(least.select("u", F.col("low").alias("v"))).distinct(), "edges")
        after = _state(small)
        drop_stored(now)
        now, same = small, after == state
        state = after
        if same:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
