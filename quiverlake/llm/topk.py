"""Exact top-k by integer inner product: ball trees and branch and bound, shard by shard.

Cuts through space, fitted on a bounded sample, deal rows into cells, so that the rows of a shard lie together; a cell with
many rows makes several shards. Each shard is one row of a table and holds a ball tree. A query's inner product with any row
of a ball is at most its product with the centre plus its norm times the radius, and no more than that of the ball around
it. A tree's nodes are opened best bound first: the leaves are read in order of their bounds, and a node none of whose
leaves reaches the query's current k-th score is never opened.

Queries are dealt into blocks by the same cuts. First each block searches a shard of each of its own cells, which gives its
queries good k-th scores. Then a task holds a block, with its results, while the other shards stream past it, best bound
first; the current k-th scores pass from shard to shard, and shards that no query of the block can gain from are left
out before they are moved. Ties go to the smaller vec_id, so what only equals the k-th score is also passed over where
all its ids are larger.

Arithmetic is exact: in doubles where no sum can reach 2**53, else in 64-bit integers, else in Python's.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from .runtime import stored

LEAF_ROWS = 128
#: Rows of a shard and queries of a block: as many as give every core a few pairs of them, within these limits.
SHARD_ROWS, QUERY_BLOCK = (4_096, 65_536), (1_024, 32_768)
#: Rows of the sample that the cuts are fitted on, and the most cuts on a row's way to its cell.
SAMPLE_ROWS, MOST_CUTS = 4_096, 9
#: Scores beyond 38 digits count as the largest number of 38 digits.
MOST_SCORE = 10**38 - 1


def whole_components(vector: str, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component, as whole doubles; null for vectors that are null or hold null or a number that is
    not finite. A component whose multiple no double holds counts as the largest double."""
    v, most = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double")), F.lit(1.7976931348623157e308)
    fine = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # NaN is larger than any number
    floor = lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(F.greatest(F.least(x, most), -most))  # noqa: E731  large doubles are whole
    return F.when(fine, F.transform(v, lambda x: floor(x * scale)))


# --- cuts -----------------------------------------------------------------------------------------------------------
def fit_cuts(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, float]:
    """A complete binary tree of cuts (directions, thresholds): each node's sample is parted along its widest
    direction. With them the scale that vectors are divided by first."""
    scale = float(np.abs(x).max(initial=0)) or 1.0
    x, n = x / scale, (1 << depth) - 1
    direction, threshold, members = np.zeros((n, x.shape[1])), np.zeros(n), [np.arange(len(x))]
    for node in range(n):
        own = members[node]
        if len(own) > 1 and x.shape[1]:
            spread = x[own] - x[own].mean(axis=0)
            way = spread[np.argmax((spread**2).sum(axis=1))]
            for _ in range(8):  # towards the direction of the largest variance
                way = spread.T @ (spread @ way)
                way = way / (np.linalg.norm(way) or 1.0)
            along = x[own] @ way
            cut = np.median(along)
            for _ in range(8):  # to the middle between the means of both sides, so that groups are parted, not halved
                right = along > cut
                if not 0 < right.sum() < len(own):
                    break
                cut = (along[right].mean() + along[~right].mean()) / 2
            direction[node], threshold[node] = way, cut
        right = x[own] @ direction[node] > threshold[node]
        members += [own[~right], own[right]]
    return direction, threshold, scale


def route(x: np.ndarray, cuts: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
    """The cell of each vector."""
    direction, threshold, scale = cuts
    x, node = x / scale, np.zeros(len(x), np.int64)
    with np.errstate(all="ignore"):
        while len(direction) and len(x) and node[0] < len(direction):
            node = 2 * node + 1 + (np.einsum("ij,ij->i", x, direction[node]) > threshold[node])
    return node - len(direction)


# --- trees ----------------------------------------------------------------------------------------------------------
def build(ids: np.ndarray, x: np.ndarray) -> dict:
    """A ball tree as arrays over its nodes; node i has the rows begin[i] to end[i] and the children left[i], left[i] + 1."""
    order, f = np.lexsort((ids,)), x.astype(float)
    centres, radii, begin, end, left, todo = [], [], [], [], [], [(0, len(ids))]
    with np.errstate(all="ignore"):
        while len(begin) < len(todo):
            a, b = todo[len(begin)]
            own = f[order[a:b]]
            centre = own.mean(axis=0)
            centres.append(centre)
            radii.append(float(np.sqrt(((own - centre) ** 2).sum(axis=1).max(initial=0))))
            begin.append(a)
            end.append(b)
            if b - a <= LEAF_ROWS:
                left.append(-1)
                continue
            spread = own.var(axis=0)
            if len(spread) and spread.max() > 0:  # equal rows stay in order of their ids
                order[a:b] = order[a:b][np.argsort(own[:, int(spread.argmax())], kind="stable")]
            left.append(len(todo))
            todo += [(a, (a + b) // 2), ((a + b) // 2, b)]
    begin, end, ids = np.array(begin), np.array(end), ids[order]
    low = np.array([ids[a:b].min() for a, b in zip(begin, end, strict=True)])
    small = np.abs(x).max(initial=0) < 1 << 15
    return {"ids": ids, "x": x[order].astype(np.int16) if small else x[order], "centre": np.array(centres), "radius": np.array(radii), "begin": begin, "end": end, "left": np.array(left), "low": low}


def _whole(x: np.ndarray, exact: type) -> np.ndarray:
    """Whole numbers as float, np.int64 or object (Python's integers)."""
    if exact is not object or x.dtype != np.float64:
        return x.astype(exact)
    out = np.empty(x.shape, object)
    out.ravel()[:] = [int(v) for v in x.ravel().tolist()]
    return out


class Search:
    """The k best so far of a block of queries, and how many of the leaves offered to its queries were read.

    ``floor`` and ``floor_id`` are a score and id that results have to come before, for queries that have one."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, floor: list[int | None], floor_id: list[int | None]):
        self.q_ids, self.q, self.qf, self.k = ids, q, q.astype(float), k
        with np.errstate(all="ignore"):
            self.norm = np.sqrt((self.qf**2).sum(axis=1))
        self.largest = int(np.abs(self.qf).max(initial=0)) if len(q) else 0
        self.kth = np.array([-np.inf if f is None else f for f in floor], object if any(f is not None and abs(f) >= 1 << 53 for f in floor) else float)
        self.kth_id = np.array([np.iinfo(np.int64).max if i is None else i for i in floor_id], np.int64)
        self.who, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.kth.dtype)
        self.read = self.offered = 0

    def add(self, tree: dict) -> None:
        most = self.largest * int(np.abs(tree["x"].astype(float)).max(initial=0)) * max(self.q.shape[1], 1)
        exact = float if most < 1 << 53 else np.int64 if most < 1 << 63 else object
        rows, own = _whole(tree["x"], exact), _whole(self.q, exact)
        leaf = np.flatnonzero(tree["left"] < 0)
        with np.errstate(all="ignore"):
            reach = np.sqrt((tree["centre"] ** 2).sum(axis=1)) + tree["radius"]
            bound = self.qf @ tree["centre"].T + self.norm[:, None] * (tree["radius"] + 1e-9 * reach) + 1e-6
        bound[np.isnan(bound)] = np.inf
        bound = np.maximum(bound, -float(MOST_SCORE))
        for node in np.flatnonzero(tree["left"] >= 0):
            below = slice(tree["left"][node], tree["left"][node] + 2)
            bound[:, below] = np.minimum(bound[:, below], bound[:, node, None])
        bound, low, every = bound[:, leaf], tree["low"][leaf], np.arange(len(self.q))
        order, going = np.argsort(-bound, axis=1, kind="stable"), every
        self.offered += bound.size
        for turn in range(len(leaf)):  # each query's best leaf that is left
            at = order[going, turn]
            b, kth = bound[going, at], self.kth[going].astype(float)
            kth = kth - 1e-12 * np.where(np.isinf(kth), 0, np.abs(kth))
            still = b >= kth
            # Scores are whole: a bound under the k-th and 1 allows no more than a tie.
            go = still & ((b >= kth + 1) | (low[at] < self.kth_id[going]))
            now, at, going = going[go], at[go], going[still]
            if not len(going):
                break
            by = np.argsort(at, kind="stable")
            now, at = now[by], at[by]
            self.read += len(now)
            found = []
            for part in np.split(np.arange(len(now)), np.flatnonzero(np.diff(at)) + 1) if len(now) else ():
                who, node = now[part], leaf[at[part[0]]]
                a, e = tree["begin"][node], tree["end"][node]
                ids, score, kth = tree["ids"][a:e], own[who] @ rows[a:e].T, self.kth[who][:, None]
                score = np.clip(score, -MOST_SCORE, MOST_SCORE) if exact is object else score
                fits = ((score > kth) | ((score == kth) & (ids < self.kth_id[who][:, None]))) & (ids != self.q_ids[who][:, None])
                i, j = np.nonzero(fits)
                found.append((who[i], ids[j], score[i, j]))
            if found and (hits := [np.concatenate(c) for c in zip(*found, strict=True)]) and len(hits[0]):
                self._merge(*hits)

    def _merge(self, who: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if scores.dtype == np.int64:
            scores = scores.astype(float if np.abs(scores.astype(float)).max() < 1 << 53 else object)
        if scores.dtype != self.scores.dtype:  # once wide, always wide
            self.scores, self.kth, scores = (_whole(self.scores, object), self.kth.astype(object), _whole(scores, object))
        touched = np.zeros(len(self.q), bool)
        touched[who] = True
        old = touched[self.who]
        who, ids, scores = np.r_[self.who[old], who], np.r_[self.ids[old], ids], np.concatenate([self.scores[old], scores])
        key = -scores if scores.dtype != object else -np.unique(scores, return_inverse=True)[1]
        order = np.lexsort((ids, key, who))
        who, ids, scores = who[order], ids[order], scores[order]
        turn = np.arange(len(who)) - np.searchsorted(who, who)
        top, last = turn < self.k, turn == self.k - 1
        self.kth[who[last]], self.kth_id[who[last]] = scores[last], ids[last]
        self.who, self.ids = np.r_[self.who[~old], who[top]], np.r_[self.ids[~old], ids[top]]
        self.scores = np.concatenate([self.scores[~old], scores[top]])


# --- tables ---------------------------------------------------------------------------------------------------------
RESULT = "dim int, query long, query_id long, vec_id long, score decimal(38,0)"
PACKED = "dim int, block int, balls array<struct<cell:int,q_centre:array<double>,q_radius:double,least:double>>, payload binary"


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    return vectors.flatten().to_numpy().reshape(-1, dim) if dim else np.zeros((len(vectors), 0))


def _with_cells(df: DataFrame, cuts: dict) -> DataFrame:
    """Adds ``cell``, 0 for lengths without cuts; ``df`` ends with dim and vector."""
    if not cuts:
        return df.withColumn("cell", F.lit(0))
    schema = StructType([*df.schema, StructField("cell", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, vectors = batch.column(batch.num_columns - 2).to_numpy(), batch.column(batch.num_columns - 1)
            cell = np.zeros(len(dims), np.int32)
            for dim in np.unique(dims).tolist():
                if dim in cuts:
                    own = np.flatnonzero(dims == dim)
                    cell[own] = route(_matrix(vectors.take(pa.array(own)), dim).astype(float), cuts[dim])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    return df.mapInArrow(run, schema)


def _searched(records: DataFrame, k: int, tasks: int, counts: tuple | None) -> DataFrame:
    """The results of records (dim, block, salt, kind, bound, payload): of each dim, block and salt one block of queries
    (kind 0) and the trees that it searches, best bound first."""
    dealt = records.repartition(tasks, "dim", "block", "salt").sortWithinPartitions("dim", "block", "salt", "kind", F.col("bound").desc())

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = now = block = None

        def results() -> pa.RecordBatch:
            if counts:
                counts[0].add(now.read)
                counts[1].add(now.offered)
            if now.scores.dtype == object:
                scores = pa.array([Decimal(int(s)) for s in now.scores], pa.decimal128(38, 0))
            else:
                scores = pa.array(now.scores.astype(np.int64)).cast(pa.decimal128(38, 0))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(now.who), key[0], np.int32)), pa.array(block["query"][now.who]), pa.array(block["query_id"][now.who]), pa.array(now.ids), scores], ["dim", "query", "query_id", "vec_id", "score"])

        for batch in batches:
            for r in range(batch.num_rows):
                at, kind, payload = tuple(batch.column(c)[r].as_py() for c in range(3)), batch.column(3)[r].as_py(), batch.column(5)[r].as_buffer()
                if not kind:
                    if now is not None:
                        yield results()
                    key, block = at, pickle.loads(payload)
                    now = Search(block["query_id"], block["vector"], k, block["floor"], block["floor_id"])
                elif at == key:
                    now.add(pickle.loads(payload))
        if now is not None:
            yield results()

    return dealt.mapInArrow(visit, RESULT)


def top_k(queries: DataFrame, rows: DataFrame, k: int = 20, counts: tuple | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the k highest inner products of each query (query_id, vector) among ``rows``
    (vec_id, vector) of other ids; ties to the smaller vec_id. Vectors are arrays of whole numbers, longs or doubles of any
    size. Scores are compared exactly up to 38 digits, and a score that no long holds is given as the nearest long.

    Null ids and vectors, and vectors that hold a null, take no part, and only vectors of one length meet. Equal rows count
    as often as they occur (no more than k of them can be among the first k, so more are not kept); equal queries are
    answered once; queries that share an id but not a vector are answered each by themselves. With fewer candidates than
    k all are returned; a query without any has no row, and empty tables give none. Other columns are not read. ``counts``,
    two accumulators, get the leaves read and the leaves there were, over all queries.
    """
    spark = rows.sparkSession
    cores = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    whole = all("bigint" in t or "int" in t for df in (rows, queries) for c, t in df.dtypes if c == "vector")
    kind = "array<bigint>" if whole else "array<double>"
    size_of = lambda n, limits: min(max(-(-n // (2 * cores)), limits[0]), limits[1])
    fine = lambda df, i: df.select(F.col(i).cast("long"), F.col("vector").cast(kind)).dropna().filter("not exists(vector, x -> x is null)")

    # Rows, cells and trees.
    rows = fine(rows, "vec_id").select("vec_id", F.size("vector").alias("dim"), "vector")
    n = {r.dim: r["count"] for r in rows.groupBy("dim").count().collect()}  # one number for each length
    total = sum(n.values())
    shard_rows = size_of(total, SHARD_ROWS)
    depths = {dim: min(MOST_CUTS, max(0, -(-n[dim] // shard_rows) - 1).bit_length()) for dim in n if dim}
    cuts = {}
    if any(depths.values()):
        share = max(1, -(-SAMPLE_ROWS * (1 << 40) // total))
        sample = rows.filter(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(1 << 40)) < share).limit(2 * SAMPLE_ROWS).select("dim", "vector").toArrow()
        dims, vectors = sample.column("dim").to_numpy(), sample.column("vector").combine_chunks()
        for dim, depth in depths.items():
            own = np.flatnonzero(dims == dim)
            if (depth := min(depth, len(own).bit_length() - 3)) > 0:
                cuts[dim] = fit_cuts(_matrix(vectors.take(pa.array(own)), dim).astype(float), depth)
    rows = rows.groupBy("vec_id", "dim", "vector").count().withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("count"), F.lit(k).cast("long")))))
    rows = _with_cells(rows.select("vec_id", "dim", "vector"), cuts)
    one_shard = all(count <= shard_rows for count in n.values())  # of each length
    if one_shard:
        rows = rows.withColumn("subs", F.lit(1))
    else:
        rows = stored(rows, "cells")
        held = rows.groupBy("dim", "cell").count().withColumn("subs", F.ceil(F.col("count") / shard_rows)).select("dim", "cell", "subs")
        rows = rows.join(F.broadcast(held), ["dim", "cell"])  # at most 2**MOST_CUTS rows for each length
    rows = rows.select("dim", "cell", F.pmod(F.xxhash64("vec_id", "vector"), F.col("subs")).cast("int").alias("sub"), "vec_id", "vector")

    def trees(key: tuple, table: pa.Table) -> pa.Table:
        tree = build(table.column("vec_id").to_numpy(), _matrix(table.column("vector").combine_chunks(), key[0].as_py()))
        one = {"dim": key[0].as_py(), "cell": key[1].as_py(), "sub": key[2].as_py(), "centre": tree["centre"][0].tolist(), "radius": float(tree["radius"][0]), "tree": pickle.dumps(tree)}
        return pa.Table.from_pylist([one], pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("sub", pa.int32()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("tree", pa.binary())]))

    built = stored(rows.groupBy("dim", "cell", "sub").applyInArrow(trees, "dim int, cell int, sub int, centre array<double>, radius double, tree binary"), "trees")

    # Queries in blocks: cells in their order, together up to a block's size; a cell with more queries makes several.
    asked = fine(queries, "query_id").distinct().select(F.xxhash64("query_id", "vector").alias("query"), "query_id", F.size("vector").alias("dim"), "vector")
    asked = stored(_with_cells(asked, cuts), "queries")
    crowd = asked.groupBy("dim", "cell").count().orderBy("dim", "cell").collect()  # at most 2**MOST_CUTS rows for each length
    if not crowd or not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    block_size, plan, block, room, before = size_of(sum(r["count"] for r in crowd), QUERY_BLOCK), [], -1, 0, None
    for r in crowd:
        parts = -(-r["count"] // block_size)
        if r.dim != before or parts > 1 or r["count"] > room:
            block, room, before = block + 1, block_size, r.dim
        plan.append((r.dim, r.cell, block, parts))
        room -= r["count"]
        if parts > 1:
            block, room = block + parts - 1, 0
    blocks = block + 1
    places = spark.createDataFrame(plan, "dim int, cell int, first int, parts int")
    asked = asked.join(F.broadcast(places), ["dim", "cell"]).withColumn("block", (F.col("first") + F.pmod("query", F.col("parts"))).cast("int")).drop("first", "parts")

    packed_schema = to_arrow_schema(StructType.fromDDL(PACKED))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        q, floor = _matrix(table.column("vector").combine_chunks(), key[0].as_py()), table.column("floor").to_pylist()
        small = np.abs(q).max(initial=0) < 1 << 15
        payload = {"query": table.column("query").to_numpy(), "query_id": table.column("query_id").to_numpy(), "vector": q.astype(np.int16) if small else q, "floor": [None if f is None else int(f) for f in floor], "floor_id": table.column("floor_id").to_pylist()}
        balls, cells = [], table.column("cell").to_numpy()
        with np.errstate(all="ignore"):
            for cell in np.unique(cells).tolist():  # a ball around the queries of each cell, and the least of their k-th scores
                own = np.flatnonzero(cells == cell)
                centre = q[own].astype(float).mean(axis=0)
                least = [floor[i] for i in own]
                balls.append({"cell": cell, "q_centre": centre.tolist(), "q_radius": float(np.sqrt(((q[own] - centre) ** 2).sum(axis=1).max(initial=0))), "least": -np.inf if None in least else float(min(least))})
        one = {"dim": key[0].as_py(), "block": key[1].as_py(), "balls": balls, "payload": pickle.dumps(payload)}
        return pa.Table.from_pylist([one], packed_schema)

    def packed(state: DataFrame) -> DataFrame:
        columns = state.select("dim", "block", "cell", "query", "query_id", "vector", "floor", "floor_id")
        return stored(columns.groupBy("dim", "block").applyInArrow(pack, PACKED), "packed")

    def records(state: DataFrame, pairs: DataFrame, salts: int) -> DataFrame:
        salt = F.pmod(F.xxhash64("cell", "sub"), F.lit(salts)).cast("int")
        pairs = pairs.join(built.select("dim", "cell", "sub", "tree"), ["dim", "cell", "sub"]).select("dim", "block", salt.alias("salt"), F.lit(1).alias("kind"), "bound", F.col("tree").alias("payload"))
        own = state.select("dim", "block", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), F.lit(0.0).alias("bound"), "payload")
        return own.union(pairs)

    def others(best: DataFrame) -> DataFrame:
        last = best.groupBy("dim", "query", "query_id").agg(F.count("*").alias("n"), F.min(F.struct("score", (-F.col("vec_id")).alias("minus"))).alias("last")).filter(F.col("n") >= k)
        last = last.select("dim", "query", "query_id", F.col("last.score").alias("floor"), (-F.col("last.minus")).alias("floor_id"))
        state = packed(asked.join(last, ["dim", "query", "query_id"], "left"))
        salts = max(1, -(-2 * cores // blocks))
        dot = F.aggregate(F.zip_with("centre", "q_centre", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        reach, q_reach = size("centre") + F.col("radius"), size("q_centre") + F.col("q_radius")
        bound = dot + size("q_centre") * F.col("radius") + F.col("q_radius") * reach + 1e-9 * reach * q_reach + 1e-6
        bound = F.when(F.isnan(bound), float("inf")).otherwise(F.greatest(bound, F.lit(-float(MOST_SCORE))))
        pairs = built.select("dim", "cell", "sub", "centre", "radius", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        balls = state.select("dim", "block", F.col("balls.cell").alias("cells"), F.explode("balls").alias("ball")).select("dim", "block", "cells", "ball.q_centre", "ball.q_radius", "ball.least")
        pairs = pairs.join(balls, ["dim", "block"]).filter((F.col("sub") > 0) | ~F.array_contains("cells", F.col("cell"))).withColumn("bound", bound)
        pairs = pairs.filter(F.col("bound") >= F.col("least") - 1e-12 * F.when(F.col("least") > float("-inf"), F.abs("least")).otherwise(0.0))
        pairs = pairs.groupBy("dim", "block", "cell", "sub").agg(F.max("bound").alias("bound"))
        return _searched(records(state, pairs, salts), k, min(blocks * salts, 4 * cores), counts)

    # Each block and the first shard of each of its cells, then each block and all other shards that it may gain from.
    n_by = Window.partitionBy("dim", "query", "query_id")
    order = n_by.orderBy(F.col("score").desc(), "vec_id")
    state = packed(asked.withColumn("floor", F.lit(None).cast("decimal(38,0)")).withColumn("floor_id", F.lit(None).cast("long")))
    home = state.select("dim", "block", F.explode("balls.cell").alias("cell")).withColumns({"sub": F.lit(0), "bound": F.lit(0.0)})
    best = _searched(records(state, home, 1), k, min(blocks, 4 * cores), counts)
    if not one_shard:
        best = stored(best, "best")
        best = best.union(others(best))
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    longest = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    return ranked.select("query_id", "rank", "vec_id", F.greatest(F.least("score", longest), -longest - 1).cast("long").alias("score"))
