"""k-NN graphs as edge tables, their statistics, and inverted-file search."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vector import l2
from .knn import knn_blocks, top


#: Rows of a segment (64 dimensions in double: 2 megabytes). A walk with a list of 50 finds fewer of the ten nearest in larger
#: ones: of vectors spread evenly in 64 dimensions 0.95 of 4,000, 0.91 of 8,000, 0.86 of 14,700.
SEGMENT = 4_096


def segments(rows: DataFrame, id_col: str = "vec_id", size: int = SEGMENT, few: int = 16) -> tuple[DataFrame, tuple[str, int]]:
    """Adds ``segment``, dealing rows by the hash of their ids into segments of about ``size``; and that column with their number.
    Beyond ``few`` segments they are up to twice as large: of each only the nearest one or two rows count then, which are found more
    often. A graph of each segment takes work in proportion to the rows, one of all rows to their square."""
    n = rows.count()
    n = max(1, min(few, -(-n // size)), -(-n // (2 * size)))
    return rows.withColumn("segment", F.pmod(F.xxhash64(id_col, F.lit(2)), F.lit(n)).cast("int")), ("segment", n)


def edges(rows: DataFrame, m: int, id_col: str = "vec_id", vector: str = "embedding", n: int | None = None, key: tuple[str, int] | None = None) -> DataFrame:
    """src, dst and distance: each row's m nearest less itself, so the m - 1 nearest others, however many are equal to it.
    Block products, not pairs of rows, and only what is kept is shuffled. ``n``, the number of rows, saves counting them. With
    ``key``, a column and the number of its values (0 and up), only rows of one value are tied."""
    asked = rows.select(F.col(id_col).alias("qid"), F.col(vector).alias("qv"), *([key[0]] if key else []))
    near = knn_blocks(rows, asked, m - 1, "l2", id_col, vector, skip_own=True, key=key, counts=n and (n, n))
    return near.select(F.col("qid").alias("src"), F.col(id_col).alias("dst"), "distance")


def degrees(graph: DataFrame) -> DataFrame:
    return graph.groupBy("src").agg(F.count("*").alias("degree"))


def connectivity(graph: DataFrame, nodes: DataFrame, target: int, id_col: str = "vec_id") -> DataFrame:
    """min, max, median and population deviation of degrees, and the share of the target degree that nodes have."""
    d = nodes.select(F.col(id_col).alias("src")).join(degrees(graph), "src", "left").select(F.coalesce("degree", F.lit(0)).alias("d"))
    return d.agg(F.min("d").alias("min_degree"), F.max("d").alias("max_degree"), F.percentile("d", F.lit(0.5)).alias("median_degree"), F.stddev_pop("d").alias("std_degree"), F.avg(F.least(F.col("d") / target, F.lit(1.0))).alias("completeness"))


def statistics(graph: DataFrame, n: int) -> DataFrame:
    """nodes, edges, mean and largest degree, density and mean length of an edge."""
    per = graph.groupBy("src").agg(F.count("*").alias("d"), F.sum("distance").alias("s"))
    sums = per.agg(F.sum("d").alias("edges"), F.max("d").alias("max_degree"), F.sum("s").alias("s"))
    return sums.select(F.lit(n).cast("long").alias("nodes"), "edges", (F.col("edges") / n).alias("avg_degree"), "max_degree", (F.col("edges") / float(n * n)).alias("density"), (F.col("s") / F.col("edges")).alias("mean_length"))


def merge(main: DataFrame, new: DataFrame, cap: int) -> DataFrame:
    """The edges of two graphs: of each source the ``cap`` nearest."""
    both = main.unionByName(new).groupBy("src", "dst").agg(F.min("distance").alias("distance"))
    return top(both, cap, "src", F.col("distance"), "dst").drop("rk")


def level(u: Column) -> Column:
    """The level of a node from a number in (0, 1]."""
    return F.floor(-F.ln(u) / F.ln(F.lit(2.0))).cast("int")


def hashed_level(id_col: str = "vec_id") -> Column:
    """Levels that a node's id fixes."""
    u = (F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 8), 16, 10).cast("long") + 1) / F.lit(float(1 << 32))
    return level(u)


def layers(rows: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """layer and nodes: a node is in all layers up to its own."""
    return rows.select(F.explode(F.sequence(F.lit(0), hashed_level(id_col))).alias("layer")).groupBy("layer").agg(F.count("*").alias("nodes"))


def chunks(rows: DataFrame, size: int, id_col: str = "vec_id") -> DataFrame:
    """Adds ``chunk``: rows in order of id, ``size`` at a time."""
    from .collection import buffer_batches

    return buffer_batches(rows, id_col, size).withColumnRenamed("batch", "chunk")


# --- inverted file --------------------------------------------------------------------------------------------------
def ivf_train(rows: DataFrame, cells: int, id_col: str = "vec_id", vector: str = "embedding", sample: int = 256, iterations: int = 10) -> DataFrame:
    """cell and centre: k-means of a bounded sample, about ``sample`` rows for each cell, chosen by the hash of their ids. An
    empty cell keeps its centre. With fewer rows than cells each row is a centre."""
    good = rows.select(id_col, F.col(vector).cast("array<double>").alias("v")).filter("v is not null and not exists(v, x -> x is null)")
    share = max(1, -(-cells * sample * (1 << 40) // max(good.count(), 1)))
    place = F.xxhash64(id_col)
    chosen = good.filter(F.pmod(place, F.lit(1 << 40)) < share).select("v", place.alias("h")).limit(2 * cells * sample).toArrow()
    x = np.array([chosen.column("v")[i].as_py() for i in np.argsort(chosen.column("h").to_numpy(), kind="stable").tolist()], float)
    centres = x[:cells].copy()
    for _ in range(iterations if len(x) else 0):
        near = ((centres * centres).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        for c in np.unique(near).tolist():
            centres[c] = x[near == c].mean(axis=0)
    return rows.sparkSession.createDataFrame([(i, c) for i, c in enumerate(centres.tolist())], "cell int, centre array<double>")


def _cells(rows: DataFrame, centres: DataFrame, n: int, vector: str, out: str) -> DataFrame:
    packed = centres.agg(F.collect_list(F.struct("cell", "centre")).alias("__c"))
    ranked = F.array_sort(F.transform("__c", lambda c: F.struct(l2(F.col(vector), c["centre"]).alias("d"), c["cell"].alias("cell"))))
    return rows.crossJoin(F.broadcast(packed)).withColumn(out, F.transform(F.slice(ranked, 1, n), lambda c: c["cell"])).drop("__c")


def ivf_assign(rows: DataFrame, centres: DataFrame, vector: str = "embedding") -> DataFrame:
    """Adds ``cell``, the nearest centre's: a partition column for the index table."""
    return _cells(rows, centres, 1, vector, "__cells").withColumn("cell", F.element_at("__cells", 1)).drop("__cells")


def ivf_search(index: DataFrame, centres: DataFrame, queries: DataFrame, k: int, probes: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """As knn_blocks, but only over the ``probes`` cells nearest to each query: queries are dealt to their cells, where block
    products meet the cell's rows."""
    asked = _cells(queries.select("qid", "qv"), centres, probes, "qv", "__cells").select("qid", "qv", F.explode("__cells").alias("cell"))
    counts = index.count(), queries.count() * probes
    return knn_blocks(index, asked, k, "l2", id_col, vector, key=("cell", (centres.agg(F.max("cell")).first()[0] or 0) + 1), counts=counts)


def choose_probes(index: DataFrame, centres: DataFrame, k: int, target: float = 0.95, asked: int = 64, id_col: str = "vec_id", vector: str = "embedding") -> int:
    """The fewest cells to read so that, over ``asked`` rows of the index as queries (chosen by the hash of their ids),
    ``target`` of their true k neighbours lie in them. The truth is brute force; k numbers a query reach the driver."""
    share = max(1, -(-asked * (1 << 40) // max(index.count(), 1)))
    queries = index.filter(F.pmod(F.xxhash64(id_col, F.lit(1)), F.lit(1 << 40)) < share).select(F.col(id_col).alias("qid"), F.col(vector).alias("qv")).limit(2 * asked)
    n = centres.count()
    order = _cells(queries, centres, n, "qv", "__cells").select("qid", F.posexplode("__cells").alias("rank", "cell"))
    truth = knn_blocks(index, queries, k, "l2", id_col, vector).select("qid", id_col)
    ranks = sorted(r["rank"] for r in truth.join(index.select(id_col, "cell"), id_col).join(order, ["qid", "cell"]).select("rank").collect())
    return ranks[min(len(ranks) - 1, math.ceil(target * len(ranks)) - 1)] + 1 if ranks else n


# --- layered graphs -------------------------------------------------------------------------------------------------
def build_layers(rows: DataFrame, m: int, id_col: str = "vec_id", vector: str = "embedding", key: tuple[str, int] | None = None) -> DataFrame:
    """layer, src, dst and distance of a layered graph: a node is in all layers up to its hashed level; in each layer it is
    tied to its m nearest there, in both directions, and keeps the nearest 2 m of its edges in layer 0, m above. The
    highest layer is the first with m nodes or fewer, whose nodes are a search's entries; its edges tie all of them. With
    ``key``, as in edges(), the rows of each value have a graph of their own, and layers go on until that holds for each."""
    part = F.lit(0) if key is None else F.col(key[0])
    levelled, out = rows.select(id_col, vector, hashed_level(id_col).alias("level"), part.alias("part")), None
    each = levelled.select(F.explode(F.sequence(F.lit(0), "level")).alias("layer"), "part").groupBy("layer", "part").agg(F.count("*").alias("n"))
    sizes = {r["layer"]: (r["n"], r["most"]) for r in each.groupBy("layer").agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()}
    layer = 0
    while True:
        own, (n, most) = levelled.filter(F.col("level") >= layer), sizes.get(layer, (0, 0))
        turned = F.array(F.struct("src", "dst", "distance"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "distance"))
        both = edges(own, m + 1, id_col, vector, n, key and ("part", key[1])).select(F.explode(turned).alias("e")).select("e.*").distinct()
        capped = top(both, 2 * m if layer == 0 else m, "src", F.col("distance"), "dst").drop("rk").select(F.lit(layer).alias("layer"), "src", "dst", "distance")
        out = capped if out is None else out.unionByName(capped)
        if most <= m:
            return out
        layer += 1
