"""Nearest neighbours."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vector import metric as metric_of

#: The most queries that are broadcast or sent to tasks (64 dimensions in double: half a megabyte for 1,000).
MAX_QUERIES = 20_000
#: Queries that a task holds while rows go by (64 dimensions in double: 32 megabytes).
GROUP = 65_536
#: Pairs for which another task is worth its start.
PAIRS = 262_144


def knn(rows: DataFrame, query: list[float], k: int, metric: str = "l2", id_col: str = "vec_id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """id and distance of the k nearest rows to one vector, ties by id. ``where`` is applied before anything is computed,
    so it reaches the scan. A row without a distance (a null vector, one that holds a null, or of another length) is none."""
    rows = rows if where is None else rows.filter(where)
    distance = metric_of(metric)(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))
    return rows.select(id_col, distance.alias("distance")).filter("distance is not null").orderBy("distance", id_col).limit(k)


def _few(queries: DataFrame, most: int = MAX_QUERIES) -> DataFrame:
    """Queries for a broadcast, after a check of their number."""
    n = queries.count()
    if n > most:
        raise ValueError(f"{n} queries; at most {most} are broadcast: use knn_blocks for more")
    return F.broadcast(queries)


def knn_batch(rows: DataFrame, queries: DataFrame, k: int, metric: str = "l2", id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """qid, rk (from 1), id and distance of the k nearest rows to each of a few queries (qid, qv).

    The queries are counted, then broadcast; each task keeps its k best of a query before the shuffle. Rows without a
    distance to a query are no neighbours of it.
    """
    distance = metric_of(metric)(F.col(vector), F.col("qv"))
    pairs = rows.select(id_col, vector).crossJoin(_few(queries.select("qid", "qv"))).select("qid", id_col, distance.alias("distance")).filter("distance is not null")
    return top(pairs, k, "qid", F.col("distance"), id_col)


def top(scored: DataFrame, k: int, by: str, order: Column, tie: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(order, tie))
    return scored.withColumn("rk", rank).filter(F.col("rk") <= k)


def in_range(rows: DataFrame, queries: DataFrame, radius: float, metric: str = "l2", id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """All rows within the radius of each of a few queries."""
    distance = metric_of(metric)(F.col(vector), F.col("qv"))
    return rows.select(id_col, vector).crossJoin(_few(queries.select("qid", "qv"))).select("qid", id_col, distance.alias("distance")).filter(F.col("distance") <= radius)


def _blocks(rows: DataFrame, size: int, copies: int | None = None) -> DataFrame:
    """part, key, dim, ids and vs (one vector after the other): rows (part, key, id, v) as they are read, ``size`` of one part,
    key and length together. Of equal vectors of a block only the ``copies`` smallest ids can be
    among as many nearest, so the others are left out."""
    number = rows.schema["v"].dataType.elementType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = {"float": pa.float32(), "double": pa.float64()}[number]
        for batch in batches:
            parts, keys, ids, v = *(batch.column(c).to_numpy() for c in range(3)), batch.column(3)
            lengths, flat = np.diff(v.offsets.to_numpy()), v.flatten().to_numpy()
            ends = np.cumsum(lengths)
            for part, key, dim in sorted(set(zip(parts.tolist(), keys.tolist(), lengths.tolist(), strict=True))):
                alike = np.flatnonzero((parts == part) & (keys == key) & (lengths == dim))
                for at in range(0, len(alike), size):
                    mine = alike[at : at + size]
                    x = flat[(ends[mine] - dim)[:, None] + np.arange(dim)] if dim else np.zeros((len(mine), 0), flat.dtype)
                    kept = np.arange(len(mine))
                    if copies is not None:
                        often, kept = Counter(), []
                        for i in np.argsort(ids[mine], kind="stable"):
                            often[row := x[i].tobytes()] += 1
                            if often[row] <= copies:
                                kept.append(i)
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([key], pa.int32()), pa.array([dim], pa.int32()), pa.array([ids[mine[kept]]], pa.list_(pa.int64())), pa.array([x[kept].ravel()], pa.list_(kind))], ["part", "key", "dim", "ids", "vs"])

    return rows.mapInArrow(pack, f"part int, key int, dim int, ids array<long>, vs array<{number}>")


class Best:
    """The k nearest so far of a block of queries, while blocks of rows go by."""

    def __init__(self, qids: np.ndarray, q: np.ndarray, k: int, metric: str, skip_own: bool):
        self.qids, self.q, self.k, self.metric, self.skip_own = qids, q, k, metric, skip_own
        self.norm = np.linalg.norm(q, axis=1)
        self.who, self.ids, self.d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.last = np.full(len(q), np.inf)

    def _exact(self, i: np.ndarray, v: np.ndarray) -> np.ndarray:
        return exact(self.metric, self.q[i], v)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        guess = self.q @ x.T
        guess = (x * x).sum(axis=1) - 2 * guess if self.metric == "l2" else -guess
        nx, own = np.linalg.norm(x, axis=1).max(initial=0.0), self.norm**2
        # what can have moved the guess or the distance by rounding
        size = {"l2": lambda: (nx + self.norm) ** 2, "cosine": lambda: nx * self.norm + 1, "ip": lambda: nx * self.norm}[self.metric]()
        slack = 8 * (x.shape[1] + 2) * np.finfo(float).eps * size
        bound = {"l2": lambda: self.last**2 - own, "cosine": lambda: self.last - 1, "ip": lambda: self.last}[self.metric]()
        self._take(ids, guess, bound, slack, lambda i, j: self._exact(i, x[j]))

    def _take(self, ids: np.ndarray, guess: np.ndarray, bound: np.ndarray, slack: np.ndarray | float, distance) -> None:
        """Keeps what is nearest of a block, by a guess of each distance that may be off by ``slack``."""
        need = self.k + self.skip_own
        if len(ids) >= need and not np.isfinite(self.last).all():
            bound = np.fmin(bound, np.partition(guess, need - 1, axis=1)[:, need - 1])
        bound = np.where(np.isnan(bound), np.inf, bound) + 2 * slack
        i, j = np.nonzero(~(guess > bound[:, None]))  # what is no number goes on, too
        if self.skip_own:
            other = ids[j] != self.qids[i]
            i, j = i[other], j[other]
        for a in range(0, len(i), 65_536):
            own = slice(a, a + 65_536)
            self._merge(i[own], ids[j[own]], distance(i[own], j[own]))

    def _merge(self, i: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
        touched = np.zeros(len(self.q), bool)
        touched[i] = True
        old = touched[self.who]
        who, ids, d = np.r_[self.who[old], i], np.r_[self.ids[old], ids], np.r_[self.d[old], d]
        order = np.lexsort((ids, d, who))
        who, ids, d = who[order], ids[order], d[order]
        turn = np.arange(len(who)) - np.searchsorted(who, who)
        top = turn < self.k
        full = turn == self.k - 1
        self.last[who[full]] = d[full]
        self.who, self.ids, self.d = np.r_[self.who[~old], who[top]], np.r_[self.ids[~old], ids[top]], np.r_[self.d[~old], d[top]]


def exact(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distances of rows of doubles, their terms added one by one, as the metrics do: equal to the last bit."""
    added = lambda terms: np.cumsum(terms, axis=1)[:, -1] if terms.shape[1] else np.zeros(len(terms))
    return {"l2": lambda: np.sqrt(added((b - a) ** 2)), "cosine": lambda: 1 - added(b * a), "ip": lambda: -added(b * a)}[metric]()


def tasks_wanted(spark: SparkSession) -> int:
    return 2 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _shares(n: int, queries: int, row_bytes: int, query_bytes: int, tasks: int, most: int | None = None) -> tuple[int, int]:
    """Groups of queries and shares of rows (``most`` at most), ``tasks`` or more together, so that the least is shuffled: each
    group meets all shares. A group has GROUP queries at most, but there are no more than ``tasks`` groups, so what is
    shuffled grows as the input."""
    first = min(max(1, -(-queries // GROUP), -(-tasks // (most or tasks))), tasks)
    choices = [(g, -(-tasks // g)) for g in range(first, max(first, min(tasks, queries)) + 1)]
    return min(choices, key=lambda c: c[0] * n * row_bytes + c[1] * queries * query_bytes)


def nearest_blocks(
    rows: DataFrame, asked: DataFrame, counts: tuple[int, int], k: int, best, width: tuple[int, int], keys: int = 1, id_col: str = "vec_id", block: int = 1_024,
    copies: int | None = None, of: Callable[[int], int] | None = None,
) -> DataFrame:
    """qid, rk, id and distance of the k best rows (key, id, v) for each query (key, id, v) of the same key (0 to ``keys`` - 1).

    Queries are dealt into groups, rows into shares, by the hash of their ids. Each group meets each share in a task of its own,
    which holds the queries in blocks, each with its k best (``best`` makes that of ids and vectors), while row blocks stream
    past. ``counts`` and ``width`` are numbers of rows and queries and the bytes that each takes; only shares depend on them.
    Rows meet queries of their own length, or, with ``of``, of any length that it gives the same number.
    """
    n, m = counts
    tasks = min(tasks_wanted(rows.sparkSession), n * m // PAIRS + 1)
    groups, salts = _shares(n, m, width[0], width[1] + 24 * k, -(-tasks // keys))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def packed(df: DataFrame, shares: int, count: int, copies: int | None = None) -> DataFrame:
        parts = shares * max(1, min(-(-tasks // shares), count // (shares * block)))  # several tasks pack a large share
        part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part")
        return _blocks(df.select(part, "key", "id", "v").repartitionById(parts, F.col("part")), block, copies)

    asked = packed(asked, groups, m).select("key", "dim", (F.col("part") % groups).alias("grp"), each(salts).alias("salt"), F.lit(0).alias("kind"), "ids", "vs")
    dealt = packed(rows, salts, n, copies).select("key", "dim", each(groups).alias("grp"), (F.col("part") % salts).alias("salt"), F.lit(1).alias("kind"), "ids", "vs")
    unit = ((F.col("key") * groups + F.col("grp")) * salts + F.col("salt")).cast("int")
    dealt = asked.union(dealt).repartitionById(keys * groups * salts, unit)
    dealt = (dealt.sortWithinPartitions("kind") if of else dealt.sortWithinPartitions("dim", "kind")).select("dim", "kind", "ids", "vs")
    alike = of or (lambda dim: dim)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        done = lambda b: pa.RecordBatch.from_arrays([pa.array(b.qids[b.who]), pa.array(b.ids), pa.array(b.d)], ["qid", id_col, "distance"])
        for batch in batches:
            for r in range(batch.num_rows):
                dim, kind = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
                ids, x = batch.column(2)[r].values.to_numpy(), batch.column(3)[r].values.to_numpy()
                x = x.reshape(len(ids), dim).astype(float)
                if alike(dim) != now:
                    yield from map(done, held)
                    now, held = alike(dim), []
                if not kind:
                    held.append(best(ids, x))
                else:
                    for b in held:  # none if no query has this length
                        b.add(ids, x)
        yield from map(done, held)

    return top(dealt.mapInArrow(nearest, f"qid long, `{id_col}` long, distance double"), k, "qid", F.col("distance"), id_col)


def _vectors(rows: DataFrame, id_col: str, vector: str, kind: str, key: Column | None = None) -> DataFrame:
    rows = rows.select((F.lit(0) if key is None else key.cast("int")).alias("key"), F.col(id_col).cast("long").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("v"))
    return rows.filter("key is not null and id is not null and v is not null and not exists(v, x -> x is null)")


def _kind(*vectors: tuple[DataFrame, str]) -> str:
    """Vectors of floats are shuffled as such."""
    return "float" if all(df.select(v).schema[0].dataType.simpleString() == "array<float>" for df, v in vectors) else "double"


def knn_blocks(
    rows: DataFrame, queries: DataFrame, k: int, metric: str = "l2", id_col: str = "vec_id", vector: str = "embedding",
    block: int = 1_024, skip_own: bool = False, key: tuple[str, int] | None = None, counts: tuple[int, int] | None = None,
) -> DataFrame:
    """As knn_batch for l2, cosine and ip and any number of queries, by matrix products.

    Rows and queries are packed into blocks, queries into groups of up to ``GROUP``. A task keeps the k best of one group
    while row blocks stream past it, one product for each block of queries, so what it holds and returns does not grow with the
    rows. Each of few groups is dealt to several tasks, each with a share of the rows. What may be among the k best but for
    rounding is computed again as knn_batch does, then ordered with ties by id.

    Null ids, and vectors that are null or hold a null, take no part; only vectors of one length meet. Query ids are unique.
    With ``skip_own`` a row with the query's own id is no neighbour of it. With ``key``, a column of both and the number of
    its values (0 and up), only rows of the query's own key are neighbours, and a query may have several keys. ``counts`` of rows and queries, where
    known, save counting them.
    """
    if metric not in ("l2", "cosine", "ip"):
        raise ValueError(f"no matrix form of {metric}")
    kind = _kind((rows, vector), (queries, "qv"))
    name, keys = key or (None, 1)
    of = None if name is None else F.col(name)
    rows, asked = _vectors(rows, id_col, vector, kind, of), _vectors(queries, "qid", "qv", kind, of)
    width = 8 + 64 * (4 if kind == "float" else 8)
    return nearest_blocks(rows, asked, counts or (rows.count(), asked.count()), k, lambda ids, x: Best(ids, x, k, metric, skip_own), (width, width), keys, id_col, block, k + skip_own)


def merge_layers(layers: list[DataFrame], k: int, id_col: str = "vec_id") -> DataFrame:
    """The k nearest of several results (id, distance); of an id in more than one layer the first layer's counts."""
    tagged = [layer.select(id_col, "distance").withColumn("layer", F.lit(i)) for i, layer in enumerate(layers)]
    both = tagged[0]
    for more in tagged[1:]:
        both = both.unionByName(more)
    first = both.groupBy(id_col).agg(F.min_by("distance", "layer").alias("distance"), F.min("layer").alias("layer"))
    return first.orderBy("distance", id_col).limit(k)


def recall(found: DataFrame, truth: DataFrame, k: int, id_col: str = "vec_id") -> DataFrame:
    """qid and recall@k: how many of each query's k true neighbours (or all, if fewer) were found."""
    hits = truth.select("qid", id_col).join(found.select("qid", id_col).distinct().withColumn("hit", F.lit(1)), ["qid", id_col], "left")
    return hits.groupBy("qid").agg((F.count("hit") / F.least(F.count("*"), F.lit(k))).alias("recall"))


def rerank(rows: DataFrame, candidates: DataFrame, query: list[float], k: int, metric: str = "l2", id_col: str = "vec_id") -> DataFrame:
    """The candidates (ids) in order of their distance to another query."""
    return knn(rows.join(candidates.select(id_col).distinct(), id_col, "left_semi"), query, k, metric, id_col)
