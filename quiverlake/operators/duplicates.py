"""Vectors that are the same within a tolerance, or near by their cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vector import same, total
from ..sources.scratch import stored
from .components import connected_components

#: Projections that a cell has, and its width in bounds of the projections of two same vectors.
PROJECTIONS, WIDTH = 4, 256
#: Components are cut at this for projections only, so that rounding stays far below the tolerance.
MOST = 1e4


def _projection(j: int) -> Column:
    sign = lambda i: F.lit(1.0) - 2 * F.pmod(F.xxhash64(i, F.lit(j)), F.lit(2))
    return total(F.transform("v", lambda x, i: F.least(F.greatest(x.cast("double"), F.lit(-MOST)), F.lit(MOST)) * sign(i)))


def duplicates(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", tolerance: float = 1e-6) -> DataFrame:
    """a and b: each vector that is a copy of one with a smaller id, and the smallest id of its class.

    Vectors are copies where every component differs by less than the tolerance, and so are copies of copies; a vector with
    a null, a NaN or an infinity is no copy of any. Equal vectors are counted once, by an aggregation. Of the others, sums
    with fixed random signs differ by at most the tolerance for each component: cells of a few such sums hold a
    vector's own cell and those within the bound of it, so no pair is lost, and each pair in a cell is compared exactly.
    """
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    good = rows.filter(finite).select(F.col(id_col).cast("long").alias("a"), F.col(vector).alias("v"))
    distinct = stored(good.groupBy("v").agg(F.min("a").alias("b"), F.count("*").alias("n")), "vectors")
    size = F.size("v")
    bound = size * (F.lit(tolerance) + size * (4e-15 * MOST))
    placed = distinct.select("b", "v", bound.alias("bound"), size.alias("size"), *[_projection(j).alias(f"p{j}") for j in range(PROJECTIONS)])
    cell = lambda p: F.floor(p / F.greatest(F.col("bound") * WIDTH, F.lit(1e-300)))
    keys = ["size", *[f"c{j}" for j in range(PROJECTIONS)]]
    own = placed.select(F.col("b").alias("u"), F.col("v").alias("vu"), "size", *[cell(F.col(f"p{j}")).alias(f"c{j}") for j in range(PROJECTIONS)])
    near = placed
    for j in range(PROJECTIONS):
        p = F.col(f"p{j}")
        near = near.withColumn(f"c{j}", F.explode(F.array_distinct(F.array(cell(p - F.col("bound")), cell(p + F.col("bound"))))))
    near = near.select(F.col("b").alias("w"), F.col("v").alias("vw"), *keys)
    links = own.join(near, keys).filter("u < w").filter(same("vu", "vw", tolerance)).select("u", F.col("w").alias("v"))
    roots = connected_components(links).select(F.col("node").alias("b"), "root")
    # a table, so that both sides of the next join are dealt out for it, and Spark can split the rows of a common vector
    classes = stored(distinct.join(roots, "b", "left").select("v", "n", F.coalesce("root", "b").alias("b"), F.col("root").isNotNull().alias("linked")), "classes")
    return good.join(classes.filter("n > 1 or linked").select("v", "b"), "v").filter("a != b").select("a", "b")


#: Rows of a group of :func:`near_pairs`, pairs of them that one product compares, and pairs that are computed again at a time.
GROUP, TILE, AGAIN = 4_096, 1_024, 1 << 16


def near_pairs(rows: DataFrame, by: str, threshold: float, id_col: str = "vec_id", vector: str = "embedding", group: int = GROUP) -> DataFrame:
    """a, b (a < b) and dot of the rows with one value of ``by`` whose vectors have a cosine of ``threshold`` or more. Two
    zero vectors are near, a zero vector and another are not.

    The rows of a value are dealt by their ids into groups of about ``group``, and each pair of groups is a task's tile: a
    value with most of the rows is many tiles. A tile holds two groups and compares them by matrix products; no pair of rows
    exists outside it but those that are near. What may be near but for rounding is computed again as ``vector.near`` does.
    The work is quadratic in a value's rows, as any pair may be near; each row goes to as many tiles as its value has groups.

    Rows with a null id or ``by``, and vectors that are null or hold a null, a NaN or an infinity, take no part; only vectors
    of one length meet. Rows that repeat an id are no pair of one another. An empty table gives no row.
    """
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    good = rows.filter(finite).select(F.col(by).alias("by"), F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("by is not null and id is not null")
    # values of more than one group: fewer than one for each ``group`` rows
    large = good.groupBy("by").count().filter(F.col("count") > group).select("by", F.ceil(F.col("count") / group).cast("int").alias("groups"))
    dealt = good.join(F.broadcast(large), "by", "left").withColumn("groups", F.coalesce("groups", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    name = F.to_json(F.struct("by", F.size("v").alias("n"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))
    side = F.signum(F.col("own") - F.col("other")).cast("int")  # 0: the two groups are one
    tiles = dealt.select(name.alias("tile"), side.alias("side"), "id", "v").repartition("tile").sortWithinPartitions("tile")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, []
        for batch in batches:
            tile = batch.column(0).dictionary_encode()
            places, names = tile.indices.to_numpy(), tile.dictionary.to_pylist()
            starts = np.flatnonzero(np.r_[True, places[1:] != places[:-1]]).tolist() if len(places) else []
            for a, b in zip(starts, [*starts[1:], len(places)], strict=True):
                if names[places[a]] != own:
                    yield from _near(held, threshold)
                    own, held = names[places[a]], []
                held.append(batch.slice(a, b - a))
        yield from _near(held, threshold)

    return tiles.mapInArrow(compare, "a long, b long, dot double")


def _near(held: list[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """The near pairs of one tile."""
    if not held:
        return
    ids, side = (np.concatenate([part.column(c).to_numpy() for part in held]) for c in (2, 1))
    flat = np.concatenate([part.column(3).flatten().to_numpy() for part in held])
    x = flat.reshape(len(ids), len(flat) // len(ids))
    added = lambda terms: np.cumsum(terms, axis=1)[:, -1] if terms.shape[1] else np.zeros(len(terms))  # noqa: E731  one by one, as an aggregate does
    norm = np.concatenate([np.sqrt(added(x[k : k + AGAIN] ** 2)) for k in range(0, len(x), AGAIN)])
    unit = x / np.where(norm == 0, 1, norm)[:, None]
    slack = 8 * (x.shape[1] + 4) * np.finfo(float).eps
    left, right = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)
    for p in range(0, len(left), TILE):
        for q in range(0, len(right), TILE):
            m, n = left[p : p + TILE], right[q : q + TILE]
            may = ~(unit[m] @ unit[n].T < threshold - slack) | ((norm[m] == 0)[:, None] & (norm[n] == 0))
            i, j = np.nonzero(may)
            i, j = m[i], n[j]
            # in a tile of one group each pair comes up twice
            once = ids[i] < ids[j] if not side.any() else ids[i] != ids[j]
            i, j = i[once], j[once]
            for k in range(0, len(i), AGAIN):
                a, b = i[k : k + AGAIN], j[k : k + AGAIN]
                dot, size = added(x[a] * x[b]), norm[a] * norm[b]
                with np.errstate(divide="ignore", invalid="ignore"):
                    near = np.where((norm[a] == 0) | (norm[b] == 0), (norm[a] == 0) & (norm[b] == 0), dot / size >= threshold)
                a, b, dot = a[near], b[near], dot[near]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[a], ids[b])), pa.array(np.maximum(ids[a], ids[b])), pa.array(dot)], ["a", "b", "dot"])
