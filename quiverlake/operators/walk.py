"""Search by walking a k-NN graph: best-first with a bounded list, for many queries at once.

The graph is an edge table (layer, src, dst) over rows that lie in segments of bounded size (``graph.segments``), whose edges
stay inside. A task holds a group of queries and one segment after the other, as vectors and neighbours by position, and
walks it for blocks of queries: a step opens what is open among each query's ``ef`` nearest, and computes the distances of
what was not seen yet. A query is done when nothing is open among them. The nearest of all segments are the result, so
rows and queries are shuffled once, however many steps there are.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import metric as metric_of
from .knn import _kind, _shares, exact, tasks_wanted

#: Walks (of a query through a segment) for which another task is worth its start.
WALKS = 256
#: Queries times nodes that a block of walks marks as seen (five bytes each).
CELLS = 1 << 19
#: Neighbours that a step looks at together, and pairs whose vectors are side by side.
REACHED, PAIRS = 1 << 20, 1 << 11


@dataclass(frozen=True)
class GraphParameters:
    m: int = 16
    ef_construction: int = 100
    ef_search: int = 50
    seed: int = 42

    @property
    def m0(self) -> int:
        """Edges of a node in the lowest layer."""
        return 2 * self.m


def undirected(edges: DataFrame) -> DataFrame:
    turned = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))  # no union: the edges are found once
    return edges.select(F.explode(turned).alias("e")).select("e.src", "e.dst").distinct()


def layered(edges: DataFrame, levels: DataFrame) -> DataFrame:
    """layer, src and dst: an edge is in all layers that both its nodes (id, level) reach."""
    a, b = levels.select(F.col("id").alias("src"), F.col("level").alias("la")), levels.select(F.col("id").alias("dst"), F.col("level").alias("lb"))
    both = edges.select("src", "dst").join(a, "src").join(b, "dst")
    return both.select(F.explode(F.sequence(F.lit(0), F.least("la", "lb"))).alias("layer"), "src", "dst")


def greedy_step(rows: DataFrame, queries: DataFrame, entries: DataFrame, metric: str = "l2", id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """qid, id and distance of the nearest of each query's entry points (qid, id)."""
    near = entries.join(rows.select(id_col, vector), id_col).join(F.broadcast(queries), "qid").select("qid", id_col, metric_of(metric)(F.col(vector), F.col("qv")).alias("distance"))
    best = near.groupBy("qid").agg(F.min(F.struct("distance", id_col)).alias("b"))
    return best.select("qid", F.col(f"b.{id_col}").alias(id_col), "b.distance")


def _distances(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of doubles, as the metric of that name gives them."""
    if metric in ("l2", "cosine", "ip"):
        return exact(metric, a, b)
    if metric == "cosine_any":
        norms = np.sqrt(-exact("ip", a, a)) * np.sqrt(-exact("ip", b, b))
        return np.where(norms == 0, 1.0, 1 + exact("ip", a, b) / np.where(norms == 0, 1.0, norms))
    a, b = a > 0.5, b > 0.5
    if metric == "hamming":
        return (a != b).sum(axis=1).astype(float)
    either = (a | b).sum(axis=1)
    return np.where(either == 0, 0.0, 1 - (a & b).sum(axis=1) / np.maximum(either, 1))


def _measure(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What orders as the distance but for rounding, and is computed faster. Equal rows have equal values."""
    if metric in ("cosine", "ip"):
        return -np.einsum("ij,ij->i", a, b)
    return np.einsum("ij,ij->i", d := a - b, d) if metric == "l2" else _distances(metric, a, b)


class Segment:
    """The nodes of a segment by ascending id, and the neighbours of each by layer."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, counts: np.ndarray, layer: np.ndarray, dst: np.ndarray, metric: str):
        self.ids, self.x, self.metric, self.layers = ids, x, metric, []
        at = np.minimum(np.searchsorted(ids, dst), len(ids) - 1)
        src, here = np.repeat(np.arange(len(ids)), counts), ids[at] == dst
        for i in range(layer[here].max(initial=0) + 1):
            own = here & (layer == i)
            self.layers.append((np.r_[0, np.cumsum(np.bincount(src[own], minlength=len(ids)))], at[own]))

    def walk(self, q: np.ndarray, who: np.ndarray, at: np.ndarray, layer: int, k: int, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """who, at and distance, in order, of the k nearest nodes that the walks of queries ``who`` from nodes ``at`` find in a
        layer; and how many nodes each query has seen."""
        (ends, near), n, keep = self.layers[layer], len(self.ids), max(k, ef)
        seen, turn, last = np.zeros(len(q) * n, bool), np.empty(len(q) * n, np.int32), np.full(len(q), np.inf)
        best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)
        rank = np.zeros(0, np.int64)

        def meet(cells: np.ndarray) -> None:
            nonlocal best, rank
            cells = cells[~seen[cells]]
            turn[cells] = np.arange(len(cells))
            cells = cells[turn[cells] == np.arange(len(cells))]
            seen[cells] = True
            w, a = np.divmod(cells, n)
            d = np.concatenate([np.zeros(0), *(_measure(self.metric, q[w[i : i + PAIRS]], self.x[a[i : i + PAIRS]]) for i in range(0, len(w), PAIRS))])
            good = ~(d > last[w])  # what is no number stays, as the furthest
            w, a, d, fresh = (np.r_[old, new] for old, new in zip(best, (w[good], a[good], d[good], np.ones(good.sum(), bool)), strict=True))
            order = np.lexsort((a, d, w))
            rank = np.arange(len(w)) - np.searchsorted(w[order], w[order])
            order, rank = order[rank < keep], rank[rank < keep]
            best = w[order], a[order], d[order], fresh[order]
            last[best[0][rank == keep - 1]] = best[2][rank == keep - 1]

        for i in range(0, len(who), REACHED):
            meet(who[i : i + REACHED] * n + at[i : i + REACHED])
        while (front := best[3] & (rank < ef)).any():
            w, a = best[0][front], best[1][front]
            best[3][front] = False
            sums = np.cumsum(ends[a + 1] - ends[a])
            for cut in np.split(np.arange(len(w)), np.flatnonzero(np.diff(sums // REACHED)) + 1):
                many = ends[a[cut] + 1] - ends[a[cut]]
                place = np.arange(many.sum()) + np.repeat(ends[a[cut]] - np.cumsum(many) + many, many)
                meet(np.repeat(w[cut], many) * n + near[place])
        w, a, *_ = best
        d = np.concatenate([np.zeros(0), *(_distances(self.metric, q[w[i : i + PAIRS]], self.x[a[i : i + PAIRS]]) for i in range(0, len(w), PAIRS))])
        order = np.lexsort((a, d, w))[rank < k]
        return w[order], a[order], d[order], seen.reshape(len(q), n).sum(axis=1)

    def descend(self, q: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """From the nearest node of the highest layer, in each layer down to the first to the nearest node by a walk of width 1,
        and in layer 0 with a list of ``ef``."""
        high = len(self.layers) - 1
        top = np.flatnonzero(np.diff(self.layers[high][0]))
        top = top if len(top) else np.arange(len(self.ids))  # no edges at all
        far = np.concatenate([_distances(self.metric, q, np.broadcast_to(self.x[t], q.shape))[:, None] for t in top], axis=1)
        who, at = np.arange(len(q)), top[far.argmin(axis=1)]
        for layer in range(high - 1, 0, -1):
            who, at, *_ = self.walk(q, who, at, layer, 1, 1)
        return self.walk(q, who, at, 0, k, ef)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], pa.Table]]:
    """(kind, key, dim) and the rows that follow each other with it."""

    def cut() -> Iterator[tuple[tuple[int, int, int], pa.RecordBatch]]:
        for batch in batches:
            tags = np.stack([batch.column(c).to_numpy() for c in range(3)])
            ends = [*(np.flatnonzero((np.diff(tags) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip([0, *ends], ends, strict=False):
                if b > a:
                    yield tuple(tags[:, a].tolist()), batch.slice(a, b - a)

    for tag, pieces in itertools.groupby(cut(), lambda piece: piece[0]):
        yield tag, pa.Table.from_batches([piece for _, piece in pieces])


def _walks(
    rows: DataFrame, edges: DataFrame, queries: DataFrame, k: int, store: Callable[[DataFrame], DataFrame],
    of: Callable[[Segment, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], metric: str, id_col: str, vector: str, segment: tuple[str, int] | None,
) -> DataFrame:
    """What ``of`` finds for each query in the graphs (layer, src, dst) of all segments: the k nearest.

    Queries are dealt into groups, segments into shares; each group meets each share in a task of its own, as in
    ``nearest_blocks``, so what a task holds is a group of queries, their k best, and one segment.
    """
    if metric not in ("l2", "cosine", "ip", "cosine_any", "hamming", "jaccard"):
        raise ValueError(f"no walk by {metric}")
    kind, (name, segments) = _kind((rows, vector), (queries, "qv")), segment or (None, 1)
    whole = lambda df, i, v: df.filter(F.col(i).isNotNull() & F.col(v).isNotNull() & ~F.exists(v, lambda x: x.isNull()))
    key = F.lit(0) if name is None else F.col(name).cast("int")
    lists = edges.groupBy(F.col("src").alias("id")).agg(F.collect_list(F.struct(F.col("layer").cast("int").alias("layer"), F.col("dst").cast("long").alias("dst"))).alias("near"))
    nodes = whole(rows, id_col, vector).select(key.alias("key"), F.col(id_col).cast("long").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("v"))
    nodes = store(nodes.join(lists, "id", "left").select("key", F.size("v").alias("dim"), "id", "v", "near"))
    asked = whole(queries, "qid", "qv").select(F.size("qv").alias("dim"), F.col("qid").cast("long").alias("id"), F.col("qv").cast(f"array<{kind}>").alias("v"))
    n, m = nodes.count(), asked.count()
    width = 8 + 64 * (4 if kind == "float" else 8)
    groups, shares = _shares(n, m, width + 512, width + 24 * k, min(tasks_wanted(rows.sparkSession), m * segments // WALKS + 1), segments)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.select(F.lit(0).alias("kind"), F.lit(0).alias("key"), "dim", "id", "v", F.lit(None).cast(nodes.schema["near"].dataType).alias("near"), F.pmod(F.xxhash64("id"), F.lit(groups)).alias("grp"), each(shares).alias("share"))
    dealt = asked.union(nodes.select(F.lit(1), "key", "dim", "id", "v", "near", each(groups), F.col("key") % shares))
    dealt = dealt.repartitionById(groups * shares, (F.col("grp") * shares + F.col("share")).cast("int")).sortWithinPartitions("kind", "key", "dim", "id").drop("grp", "share")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}  # of each length of vectors: query ids, vectors, nodes visited, and (query, id, distance) of the k best
        for (is_node, _, dim), run in _runs(batches):
            flat = lambda c: np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in run.column(c).chunks])  # noqa: B023, E731
            ids, x = run.column("id").to_numpy(), flat("v").astype(float).reshape(run.num_rows, dim)
            if not is_node:
                held[dim] = ids, x, np.zeros(len(ids), np.int64), (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            elif dim in held:
                near = pa.concat_arrays([c.flatten() for c in run.column("near").chunks])
                counts = np.concatenate([c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for c in run.column("near").chunks])
                here = Segment(ids, x, counts, *(f.to_numpy(zero_copy_only=False) for f in near.flatten()), metric)
                qids, q, visited, best = held[dim]
                parts, size = [best], max(1, CELLS // len(ids))
                for i in range(0, len(qids), size):
                    w, a, d, saw = of(here, q[i : i + size])
                    parts.append((w + i, ids[a], d))
                    visited[i : i + size] += saw
                w, i, d = (np.concatenate(c) for c in zip(*parts, strict=True))
                order = np.lexsort((i, d, w))
                order = order[np.arange(len(w)) - np.searchsorted(w[order], w[order]) < k]
                held[dim] = qids, q, visited, (w[order], i[order], d[order])
        for qids, _, visited, (w, i, d) in held.values():
            first = np.r_[True, w[1:] != w[:-1]][: len(w)]  # a query's count stands once
            yield pa.RecordBatch.from_arrays([pa.array(qids[w]), pa.array(i), pa.array(d), pa.array(np.where(first, visited[w], 0))], ["qid", id_col, "distance", "visited"])

    best = dealt.mapInArrow(found, f"qid long, `{id_col}` long, distance double, visited long")
    rank, seen = F.row_number().over(Window.partitionBy("qid").orderBy("distance", id_col)), F.sum("visited").over(Window.partitionBy("qid"))
    return best.select("qid", rank.alias("rk"), id_col, "distance", seen.alias("visited")).filter(F.col("rk") <= k)


def search(
    rows: DataFrame, edges: DataFrame, queries: DataFrame, entry: int | None, k: int, ef: int, store: Callable[[DataFrame], DataFrame],
    metric: str = "l2", id_col: str = "vec_id", vector: str = "embedding", segment: tuple[str, int] | None = None,
) -> DataFrame:
    """qid, rk, id, distance and visited of the k nearest that the walk of each query (qid, qv) finds.

    ``store`` writes a DataFrame (each node with its neighbours) and returns it as read again. All queries start at ``entry``,
    or, without one, at the smallest id of each segment. ``segment`` is a column of the rows and the number of its values (0
    and up); a task holds all rows of a segment, and without it all rows are one. A walk goes on until nothing is
    open among its ef nearest; as a node is opened once, it ends.
    """

    def walk(here: Segment, q: np.ndarray):
        at = np.zeros(1, np.int64) if entry is None else np.flatnonzero(here.ids == entry)
        return here.walk(q, np.repeat(np.arange(len(q)), len(at)), np.tile(at, len(q)), 0, k, ef)

    return _walks(rows, edges.select(F.lit(0).alias("layer"), "src", "dst"), queries, k, store, walk, metric, id_col, vector, segment)


def descend(
    rows: DataFrame, graph: DataFrame, queries: DataFrame, k: int, store: Callable[[DataFrame], DataFrame], parameters: GraphParameters = GraphParameters(),
    metric: str = "l2", id_col: str = "vec_id", vector: str = "embedding", segment: tuple[str, int] | None = None,
) -> DataFrame:
    """As search(), in a layered graph (layer, src, dst): each segment from its highest layer down (``Segment.descend``), in
    layer 0 with a list of ``ef_search``."""
    return _walks(rows, graph, queries, k, store, lambda here, q: here.descend(q, k, max(k, parameters.ef_search)), metric, id_col, vector, segment)


# --- graph snapshots ------------------------------------------------------------------------------------------------
def adjacency(edges: DataFrame) -> DataFrame:
    """layer, node and its sorted neighbours."""
    return edges.groupBy("layer", F.col("src").alias("node")).agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))


def from_adjacency(lists: DataFrame) -> DataFrame:
    return lists.select("layer", F.col("node").alias("src"), F.explode("neighbours").alias("dst"))


def node_count(edges: DataFrame) -> DataFrame:
    """Nodes of the largest layer."""
    return edges.groupBy("layer").agg(F.count_distinct("src").alias("n")).agg(F.max("n").alias("num_nodes"))
