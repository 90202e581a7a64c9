"""Vector compression: binary, scalar and product quantization."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vector import total
from ..sources.scratch import stored
from .knn import MAX_QUERIES, Best, nearest_blocks, top


def per_dimension(rows: DataFrame, vector: str = "embedding", **aggregates) -> DataFrame:
    """dim (from 0) and the given aggregates of its values: combined before the shuffle, one row for each dimension."""
    values = rows.select(F.posexplode(F.col(vector)).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return values.groupBy("dim").agg(*[f("x").alias(name) for name, f in aggregates.items()])


def as_arrays(stats: DataFrame, *names: str) -> DataFrame:
    """One row: each statistic as an array in order of dim. It has as many numbers as a vector, so it may be broadcast."""
    ordered = F.sort_array(F.collect_list(F.struct("dim", *names)))
    return stats.agg(ordered.alias("s")).select(*[F.col(f"s.{n}").alias(n) for n in names])


def center(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Vectors less the mean of each dimension; adds ``centered``."""
    mean = as_arrays(per_dimension(rows, vector, mean=F.avg), "mean")
    return rows.crossJoin(F.broadcast(mean)).withColumn("centered", F.zip_with(vector, "mean", lambda x, m: x.cast("double") - m)).drop("mean")


# --- binary ---------------------------------------------------------------------------------------------------------
def binary_train(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    return per_dimension(rows, vector, threshold=F.avg)


def binary_bits(vector: Column, thresholds: Column) -> Column:
    return F.zip_with(vector, thresholds, lambda x, t: F.when(x.cast("double") >= t, 1).otherwise(0))


def pack_bits(bits: Column) -> Column:
    """Bytes of eight bits, the first bit lowest."""
    byte = lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0), lambda s, k: s + F.coalesce(F.get(bits, i * 8 + k), F.lit(0)) * F.element_at(F.array(*[F.lit(1 << j) for j in range(8)]), k + 1))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(bits) - 1) / 8).cast("int")), byte)


def binary_encode(rows: DataFrame, thresholds: DataFrame, vector: str = "embedding") -> DataFrame:
    """Adds ``code``, an array of bytes as numbers. ``thresholds`` is what binary_train() returns."""
    t = as_arrays(thresholds, "threshold")
    bits = rows.crossJoin(F.broadcast(t)).withColumn("__bits", binary_bits(F.col(vector), F.col("threshold")))
    return bits.withColumn("code", pack_bits(F.col("__bits"))).drop("__bits", "threshold")


def binary_decode(rows: DataFrame, thresholds: DataFrame, dim: int, code: str = "code") -> DataFrame:
    """Adds ``decoded``: half above or below each threshold."""
    t = as_arrays(thresholds, "threshold")
    bit = lambda th, i: th + F.when(F.get(F.col(code), F.floor(i / 8).cast("int")).bitwiseAND(F.element_at(F.array(*[F.lit(1 << j) for j in range(8)]), F.pmod(i, F.lit(8)) + 1)) > 0, 0.5).otherwise(-0.5)
    return rows.crossJoin(F.broadcast(t)).withColumn("decoded", F.transform(F.slice("threshold", 1, dim), bit)).drop("threshold")


def code_hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


# --- scalar ---------------------------------------------------------------------------------------------------------
def scalar_train(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    return per_dimension(rows, vector, low=F.min, high=F.max)


def scalar_encode(rows: DataFrame, ranges: DataFrame, vector: str = "embedding") -> DataFrame:
    """Adds ``code``: 0 to 255 of each dimension's range, cut off, not rounded; a dimension without a range is 0."""
    r = as_arrays(ranges, "low", "high")
    width = F.zip_with("low", "high", lambda a, b: F.struct(a.alias("low"), (b - a).alias("width")))
    share = lambda x, w: F.when(w["width"] == 0, F.lit(0.0)).otherwise((x.cast("double") - w["low"]) / w["width"])
    code = F.zip_with(vector, "__w", lambda x, w: F.floor(F.least(F.greatest(share(x, w), F.lit(0.0)), F.lit(1.0)) * 255).cast("int"))
    return rows.crossJoin(F.broadcast(r.withColumn("__w", width))).withColumn("code", code).drop("__w", "low", "high")


def scalar_decode(rows: DataFrame, ranges: DataFrame, code: str = "code") -> DataFrame:
    r = as_arrays(ranges, "low", "high")
    width = F.zip_with("low", "high", lambda a, b: F.struct(a.alias("low"), (b - a).alias("width")))
    return rows.crossJoin(F.broadcast(r.withColumn("__w", width))).withColumn("decoded", F.zip_with(code, "__w", lambda c, w: w["low"] + c / 255.0 * w["width"])).drop("__w", "low", "high")


def code_distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: ((x - y) * (x - y)).cast("double"))))


# --- product --------------------------------------------------------------------------------------------------------
def split(vector: Column, m: int, dim: int) -> Column:
    """The vector's m parts, the last ones shorter if m does not divide it."""
    width = -(-dim // m)
    return F.array(*[F.slice(vector, i * width + 1, min(width, dim - i * width)) for i in range(m)])


def first_codebook(rows: DataFrame, m: int, k: int, dim: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """sub, code and centroid: the parts of the k rows with the smallest ids."""
    seeds = rows.select(id_col, vector).orderBy(id_col).limit(k)
    parts = seeds.select(F.col(id_col), F.posexplode(split(F.col(vector).cast("array<double>"), m, dim)).alias("sub", "centroid"))
    order = F.sort_array(F.collect_list(F.struct(id_col, "centroid")))
    return parts.groupBy("sub").agg(order.alias("c")).select("sub", F.posexplode("c.centroid").alias("code", "centroid"))


def books(codebook: DataFrame) -> DataFrame:
    """One row: the codebook as an array of arrays of centroids. Its size is k vectors."""
    per = codebook.groupBy("sub").agg(F.sort_array(F.collect_list(F.struct("code", "centroid"))).alias("c")).select("sub", F.col("c.centroid").alias("c"))
    return per.agg(F.sort_array(F.collect_list(F.struct("sub", "c"))).alias("b")).select(F.col("b.c").alias("book"))


def squared(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def nearest_code(part: Column, centroids: Column) -> Column:
    """Of equals the first."""
    return F.transform(F.array(F.transform(centroids, lambda c: squared(part, c))), lambda d: F.array_position(d, F.array_min(d)) - 1)[0].cast("int")


def pq_encode(rows: DataFrame, codebook: DataFrame, m: int, dim: int, vector: str = "embedding") -> DataFrame:
    """Adds ``code``: the nearest centroid of each part."""
    parts = rows.crossJoin(F.broadcast(books(codebook))).withColumn("__parts", split(F.col(vector).cast("array<double>"), m, dim))
    return parts.withColumn("code", F.zip_with("__parts", "book", nearest_code)).drop("__parts", "book")


def pq_decode(rows: DataFrame, codebook: DataFrame, code: str = "code") -> DataFrame:
    """Adds ``decoded``: the centroids of the code, one after the other."""
    both = rows.crossJoin(F.broadcast(books(codebook)))
    return both.withColumn("decoded", F.flatten(F.zip_with(code, "book", lambda c, b: F.get(b, c)))).drop("book")


def pq_train(rows: DataFrame, m: int, k: int, dim: int, iterations: int = 10, id_col: str = "vec_id", vector: str = "embedding", store=None) -> DataFrame:
    """A codebook by Lloyd's iterations from the first k rows: means are combined before the shuffle, an empty centroid
    stays, and of equal distances the first centroid wins. ``store`` cuts the lineage of each codebook (m * k rows): it
    writes a DataFrame and returns it as read again."""
    store = store or stored
    book = store(first_codebook(rows, m, k, dim, id_col, vector))
    for _ in range(iterations):
        parts = pq_encode(rows.select(id_col, vector), book, m, dim, vector).select("code", split(F.col(vector).cast("array<double>"), m, dim).alias("p"))
        cells = parts.select(F.posexplode(F.zip_with("code", "p", lambda c, p: F.struct(c.alias("code"), p.alias("p")))).alias("sub", "x")).select("sub", "x.code", F.posexplode("x.p").alias("d", "v"))
        means = cells.groupBy("sub", "code", "d").agg(F.avg("v").alias("v")).groupBy("sub", "code").agg(F.sort_array(F.collect_list(F.struct("d", "v"))).alias("c"))
        book = store(book.join(means.select("sub", "code", F.col("c.v").alias("new")), ["sub", "code"], "left").select("sub", "code", F.coalesce("new", "centroid").alias("centroid")))
    return book


def lookup_table(query: Column, book: Column, m: int, dim: int, metric: str = "l2") -> Column:
    """What each code of each part adds to the distance of a query: squared L2, 1 - product, or the product negated."""
    dot = lambda a, b: total(F.zip_with(a, b, lambda x, y: x * y))
    one = {"l2": squared, "cosine": lambda a, b: 1 - dot(a, b), "ip": lambda a, b: -dot(a, b)}[metric]
    return F.zip_with(split(query.cast("array<double>"), m, dim), book, lambda q, centroids: F.transform(centroids, lambda c: one(q, c)))


def adc_distance(code: Column, table: Column, metric: str = "l2") -> Column:
    """The sum of the looked-up parts (an unknown code adds 0), its root for L2."""
    out = total(F.zip_with(code, table, lambda c, t: F.coalesce(F.get(t, c), F.lit(0.0))))
    return F.sqrt(out) if metric == "l2" else out


def adc_search(encoded: DataFrame, codebook: DataFrame, query: list[float], k: int, m: int, metric: str = "l2", id_col: str = "vec_id", exact: str | None = None, over: int = 4) -> DataFrame:
    """id and distance of the k best by looked-up distances. With ``exact`` (a vector column), the ``over`` * k best are
    ranked again by their real distances."""
    from ..functions.vector import metric as metric_of

    q = F.array(*[F.lit(float(x)) for x in query])
    table = books(codebook).select(lookup_table(q, F.col("book"), m, len(query), metric).alias("lut"))
    keep = [id_col] + ([exact] if exact else [])
    scored = encoded.crossJoin(F.broadcast(table)).select(*keep, adc_distance(F.col("code"), F.col("lut"), metric).alias("distance"))
    if exact is None:
        return scored.orderBy("distance", id_col).limit(k)
    best = scored.orderBy("distance", id_col).limit(over * k)
    return best.select(id_col, metric_of(metric)(F.col(exact), q).alias("distance")).orderBy("distance", id_col).limit(k)


class _LookedUp(Best):
    """The k nearest so far of a block of queries by looked-up distances, while blocks of codes go by."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, book: list[np.ndarray], metric: str):
        super().__init__(ids, q, k, metric, False)
        ends = np.cumsum([0] + [centroids.shape[1] for centroids in book])
        added = lambda a, b: np.cumsum({"l2": (a - b) ** 2}.get(metric, a * b), axis=1)[:, -1]  # noqa: E731  in the order of lookup_table
        one = {"l2": added, "cosine": lambda a, b: 1 - added(a, b), "ip": lambda a, b: -added(a, b)}[metric]
        self.table = [np.stack([one(q[:, a:b], c) for c in centroids]) for centroids, a, b in zip(book, ends, ends[1:], strict=False)]

    def add(self, ids: np.ndarray, codes: np.ndarray) -> None:
        sums = np.zeros((len(ids), len(self.q)))
        for table, code in zip(self.table, codes.T.astype(int), strict=True):
            sums += table[code]
        sums, bound = np.ascontiguousarray(sums.T), self.last**2 if self.metric == "l2" else self.last
        slack = 4 * np.finfo(float).eps * np.where(np.isfinite(bound), np.abs(bound), 0)
        self._take(ids, sums, bound, slack, (lambda i, j: np.sqrt(sums[i, j])) if self.metric == "l2" else (lambda i, j: sums[i, j]))


def adc_batch(encoded: DataFrame, codebook: DataFrame, queries: DataFrame, k: int, metric: str = "l2", id_col: str = "vec_id", exact: str | None = None, over: int = 4) -> DataFrame:
    """As adc_search, for any number of queries (qid, qv): qid, rk, id and distance. Blocks of codes stream past groups of
    queries, whose tables are made where they are used; only the best are shuffled."""
    from ..functions.vector import metric as metric_of

    book = [np.array(b, float) for b in books(codebook).first()["book"]]
    rows = encoded.select(F.lit(0).alias("key"), F.col(id_col).cast("long").alias("id"), F.col("code").cast("array<float>").alias("v")).filter("v is not null and not exists(v, c -> c is null)")
    asked = queries.select(F.lit(0).alias("key"), F.col("qid").cast("long").alias("id"), F.col("qv").cast("array<double>").alias("v")).filter("v is not null and not exists(v, x -> x is null)")
    n, dim = over * k if exact else k, sum(b.shape[1] for b in book)
    asked = asked.filter(F.size("v") == dim)
    counts, width = (encoded.select(id_col).count(), queries.count()), (8 + 4 * len(book), 8 + 8 * dim)
    best = nearest_blocks(rows, asked, counts, n, lambda ids, x: _LookedUp(ids, x, n, book, metric), width, id_col=id_col, of=lambda dim: 0)
    if exact is None:
        return best
    qv = queries.select("qid", "qv")
    pairs = best.select("qid", id_col).join(encoded.select(id_col, exact), id_col).join(F.broadcast(qv) if counts[1] <= MAX_QUERIES else qv, "qid")
    return top(pairs.select("qid", id_col, metric_of(metric)(F.col(exact), F.col("qv")).alias("distance")), k, "qid", F.col("distance"), id_col)


def refine(codebook: DataFrame, rows: DataFrame, m: int, dim: int, rate: float = 0.01, seq: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Moves the nearest centroid of each part towards each vector, in order of ``seq``. Each step depends on the one
    before, so each part is one ordered fold; it holds the codebook and one vector at a time."""
    import numpy as np
    import pyarrow as pa

    parts = rows.select(seq, F.posexplode(split(F.col(vector).cast("array<double>"), m, dim)).alias("sub", "p"))
    start = codebook.groupBy("sub").agg(F.sort_array(F.collect_list(F.struct("code", "centroid"))).alias("c"))
    stream = parts.select("sub", F.col(seq).cast("long").alias("seq"), "p", F.lit(None).cast("array<array<double>>").alias("book"))
    stream = stream.union(start.select("sub", F.lit(-(1 << 62)).cast("long"), F.array().cast("array<double>"), F.col("c.centroid")))
    dealt = stream.repartition("sub").sortWithinPartitions("sub", "seq")

    def fold(batches):
        sub = book = None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([sub] * len(book), pa.int32()), pa.array(range(len(book)), pa.int32()), pa.array(book.tolist(), pa.list_(pa.float64()))], ["sub", "code", "centroid"])
        for batch in batches:
            for s, p, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if b is not None:
                    if book is not None:
                        yield done()
                    sub, book = s, np.array(b)
                else:
                    v = np.array(p)
                    i = int(((book - v) ** 2).sum(axis=1).argmin())
                    book[i] = book[i] * (1 - rate) + v * rate
        if book is not None:
            yield done()

    return dealt.mapInArrow(fold, "sub int, code int, centroid array<double>")


def needs_rebuild(since: int, limit: int = 100_000) -> bool:
    return since >= limit


def lookup_table_bytes(m: int, k: int) -> int:
    """Of one query's table: a number for each code of each part."""
    return m * k * 4


def sizes(dim: int, m: int, n: int) -> dict[str, float]:
    """Bytes of one vector by encoding, and the share of memory that product codes save."""
    raw = dim * 4
    return {"raw": raw, "binary": (dim + 7) // 8, "scalar": dim, "pq": m, "pq_ratio": raw / m if raw else 1.0, "pq_saved_percent": 100.0 * (1 - (n * m) / (n * raw)) if n * raw else 0.0}
