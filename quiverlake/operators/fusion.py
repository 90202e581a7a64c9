"""Score fusion of dense, text and sparse results, and score normalization."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Weights:
    dense: float = 0.7
    bm25: float = 0.2
    sparse: float = 0.1

    def __post_init__(self):
        if min(self.dense, self.bm25, self.sparse) < 0 or self.dense + self.bm25 + self.sparse == 0:
            raise ValueError("weights are not negative, and not all zero")

    def normalized(self) -> Weights:
        s = self.dense + self.bm25 + self.sparse
        return Weights(self.dense / s, self.bm25 / s, self.sparse / s)


#: The named weight settings.
PRESETS = {"default": Weights(), "dense": Weights(0.8, 0.15, 0.05), "balanced": Weights(0.5, 0.3, 0.2), "bm25": Weights(0.4, 0.5, 0.1)}
#: Candidates that each signal hands to the fusion, times k.
CANDIDATES = 3


def fuse(dense: DataFrame | None, bm25: DataFrame | None, sparse: DataFrame | None, k: int, weights: Weights = PRESETS["default"], id_col: str = "doc_id") -> DataFrame:
    """id, the signals' scores and their weighted mean over the signals that a document has, best first.

    ``dense`` has distances, which become 1 less the distance (cut to 0 to 1); the others have scores. Signals that are
    None are left out.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    w = weights.normalized()
    signals = []
    if dense is not None:
        signals.append(("dense", w.dense, dense.select(id_col, (1 - F.least(F.greatest("distance", F.lit(0.0)), F.lit(1.0))).alias("dense"))))
    for name, weight, df in (("bm25", w.bm25, bm25), ("sparse", w.sparse, sparse)):
        if df is not None:
            signals.append((name, weight, df.select(id_col, F.col("score").cast("double").alias(name))))
    if not signals:
        raise ValueError("a hybrid search has at least one signal")
    out = signals[0][2]
    for _, _, df in signals[1:]:
        out = out.join(df, id_col, "full_outer")
    names = [n for n, _, _ in signals]
    out = out.select(id_col, *[F.col(n) if n in names else F.lit(None).cast("double").alias(n) for n in ("dense", "bm25", "sparse")])
    part = lambda n, x, y: F.when(F.col(n).isNotNull(), x * y).otherwise(F.lit(0.0))
    top = sum((part(n, F.lit(x), F.col(n)) for n, x, _ in signals), F.lit(0.0))
    low = sum((part(n, F.lit(x), F.lit(1.0)) for n, x, _ in signals), F.lit(0.0))
    return out.withColumn("score", F.when(low == 0, F.lit(0.0)).otherwise(top / low)).orderBy(F.col("score").desc(), id_col).limit(k)


def candidates(k: int, times: int = CANDIDATES) -> int:
    return max(1, times * k)


def normalized(df: DataFrame, how: str, score: str = "score", by: str | None = None) -> DataFrame:
    """``df`` with ``score`` replaced: minmax (flat: 0.5), zscore (population deviation; flat: 0), softmax or none. The
    statistics are one aggregation, joined back; with ``by`` they are of each group."""
    s = F.col(score).cast("double")
    if how == "none":
        return df
    stats = (df.groupBy(by) if by else df.groupBy()).agg(F.min(s).alias("__min"), F.max(s).alias("__max"), F.avg(s).alias("__avg"), F.stddev_pop(s).alias("__std"))
    both = df.join(stats, by) if by else df.crossJoin(F.broadcast(stats))  # one row
    if how == "softmax":
        e = both.withColumn("__e", F.exp(s - F.col("__max")))
        sums = (e.groupBy(by) if by else e.groupBy()).agg(F.sum("__e").alias("__sum"))
        e = e.join(sums, by) if by else e.crossJoin(F.broadcast(sums))
        return e.withColumn(score, F.col("__e") / F.col("__sum")).select(*df.columns)
    width = F.col("__max") - F.col("__min")
    new: dict[str, Column] = {
        "minmax": F.when(width < 1e-9, F.lit(0.5)).otherwise((s - F.col("__min")) / width),
        "zscore": F.when(F.col("__std") < 1e-9, F.lit(0.0)).otherwise((s - F.col("__avg")) / F.col("__std")),
    }
    return both.withColumn(score, new[how]).select(*df.columns)


# --- documents with several vectors ---------------------------------------------------------------------------------
SLOT_NAME = r"^[A-Za-z0-9_]{1,128}$"


def slot_stats(slots: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of each document (rows id, slot, dense, sparse): n_dense, n_sparse, whether all dense slots have one length, and an
    estimate of its bytes: 64, and for each slot its name and 4 a dimension or 8 an entry."""
    size = F.octet_length("slot") + F.coalesce(4 * F.array_size("dense"), F.lit(0)) + F.coalesce(8 * F.array_size(F.map_keys("sparse")), F.lit(0))
    return slots.filter(F.col("slot").rlike(SLOT_NAME)).groupBy(id_col).agg(
        F.count("dense").alias("n_dense"), F.count("sparse").alias("n_sparse"),
        (F.count_distinct(F.array_size("dense")) <= 1).alias("consistent"), (64 + F.sum(size)).cast("long").alias("bytes"),
    )


def set_slot(slots: DataFrame, new: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``slots`` with those of ``new`` (id, slot, dense, sparse; one row for a document and slot) set. A slot whose name is no
    name, or that has not one of dense and sparse, is not taken."""
    good = new.filter(F.col("slot").rlike(SLOT_NAME) & (F.col("dense").isNull() != F.col("sparse").isNull())).select(*slots.columns)
    return slots.join(good.select(id_col, "slot"), [id_col, "slot"], "left_anti").select(*slots.columns).unionByName(good)


def remove_slot(slots: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return slots.join(gone.select(id_col, "slot"), [id_col, "slot"], "left_anti").select(*slots.columns)


def get_slot(slots: DataFrame, doc_id: object, slot: str, id_col: str = "doc_id") -> DataFrame:
    return slots.filter((F.col(id_col) == doc_id) & (F.col("slot") == slot))


def documents_with(slots: DataFrame, slot: str, id_col: str = "doc_id") -> DataFrame:
    """The documents that have the slot."""
    return slots.filter(F.col("slot") == slot).select(id_col).distinct()


def store_stats(per_document: DataFrame) -> DataFrame:
    """Documents by kind: with dense slots only, sparse slots only, or both."""
    kind = F.when((F.col("n_dense") > 0) & (F.col("n_sparse") > 0), "hybrid").when(F.col("n_dense") > 0, "dense").otherwise("sparse")
    return per_document.groupBy(kind.alias("kind")).agg(F.count("*").alias("documents"), F.sum("bytes").alias("bytes"))




# --- hybrid queries -------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class HybridQuery:
    """Any of a vector, words and a sparse vector, with weights and a filter."""

    vector: list[float] | None = None
    text: str | None = None
    sparse: dict[int, float] | None = None
    k: int = 10
    weights: Weights = PRESETS["default"]
    where: object | None = None
    metric: str = "cosine"

    def __post_init__(self):
        if self.vector is None and self.text is None and self.sparse is None:
            raise ValueError("a hybrid query has at least one signal")
        if self.vector == [] or self.text == "" or self.sparse == {} or self.k < 1:
            raise ValueError("signals are not empty, and k is at least 1")


def search(query: HybridQuery, docs: DataFrame, id_col: str = "doc_id", vector: str = "embedding", text: str = "text", sparse: str = "sparse") -> DataFrame:
    """Filters, gathers ``CANDIDATES`` * k candidates of each signal, fuses them, and attaches the documents."""
    from .knn import knn
    from .text_search import bm25, sparse_scores

    n = candidates(query.k)
    rows = docs if query.where is None else query.where.of(docs)
    dense = None if query.vector is None else knn(rows.filter(F.col(vector).isNotNull()), query.vector, n, query.metric, id_col, vector)
    words = None if query.text is None else bm25(rows, query.text, n, id_col, text)
    entries = None if query.sparse is None else sparse_scores(rows.filter(F.col(sparse).isNotNull()), query.sparse, n, id_col, sparse)
    fused = fuse(dense, words, entries, query.k, query.weights, id_col)
    return fused.join(docs.drop("score", "dense", "bm25"), id_col).orderBy(F.col("score").desc(), id_col)
