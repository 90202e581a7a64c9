"""Binary, scalar and product quantization."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import knn as K
from ..operators import quantize as Z
from ..sources.scratch import stored
from .registry import many, query
from .vectors import VECTOR, VECTOR_SQL, embeddings, five

M, CODES, DIM = 8, 16, 64
LONG = "(SELECT vec_id, i AS dim, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i))"
#: Decimal places that hide the order of a sum, so that a comparison with a mean comes out alike.
T = f"(SELECT dim, round(avg(x), 9) AS t, min(x) AS low, max(x) AS high FROM {LONG} l GROUP BY dim)"


def thresholds(spark, sf):
    return Z.binary_train(embeddings(spark, sf)).withColumn("threshold", F.round("threshold", 9))


@query(f"SELECT (dim - 1)::INTEGER AS dim, round(t, 6) AS threshold FROM {T} t")
def binary_train(spark, sf):
    return thresholds(spark, sf).withColumn("threshold", F.round("threshold", 6))


BITS = f"(SELECT vec_id, l.dim, CASE WHEN x >= t THEN 1 ELSE 0 END AS bit, t FROM {LONG} l JOIN {T} t USING (dim))"
BYTES = f"(SELECT vec_id, list(b ORDER BY byte) AS code FROM (SELECT vec_id, (dim - 1) // 8 AS byte, sum(bit * (1 << ((dim - 1) % 8)))::INTEGER AS b FROM {BITS} x GROUP BY ALL) GROUP BY vec_id)"


@query(f"SELECT vec_id, code FROM {BYTES} x")
def binary_encode(spark, sf):
    return Z.binary_encode(embeddings(spark, sf), thresholds(spark, sf)).select("vec_id", "code")


@query(f"SELECT vec_id, list(round(t + bit - 0.5, 5) ORDER BY dim) AS decoded FROM {BITS} x GROUP BY vec_id")
def binary_decode(spark, sf):
    e, t = embeddings(spark, sf), thresholds(spark, sf)
    out = Z.binary_decode(Z.binary_encode(e, t), t, DIM)
    return out.select("vec_id", F.transform("decoded", lambda x: F.round(x, 5)).alias("decoded"))


@query(f"""WITH b AS {BITS}, d AS (SELECT q.vec_id AS qid, e.vec_id, sum(CASE WHEN q.bit <> e.bit THEN 1 ELSE 0 END)::INTEGER AS distance FROM b q JOIN b e USING (dim) WHERE q.vec_id < 5 GROUP BY ALL)
SELECT qid, rk, vec_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, vec_id)::INTEGER AS rk FROM d) WHERE rk <= 5""")
def binary_hamming_knn(spark, sf):
    coded = Z.binary_encode(embeddings(spark, sf), thresholds(spark, sf)).select("vec_id", "code")
    asked = coded.filter("vec_id < 5").select(F.col("vec_id").alias("qid"), F.col("code").alias("qc"))
    pairs = coded.crossJoin(F.broadcast(asked)).select("qid", "vec_id", Z.code_hamming(F.col("code"), F.col("qc")).alias("distance"))
    return K.top(pairs, 5, "qid", F.col("distance"), "vec_id").select("qid", "rk", "vec_id", "distance")


@query(f"SELECT (dim - 1)::INTEGER AS dim, low, high FROM {T} t")
def scalar_train(spark, sf):
    return Z.scalar_train(embeddings(spark, sf))


CODED = f"(SELECT vec_id, dim, low, high, CASE WHEN high = low THEN 0 ELSE floor(greatest(least((x - low) / (high - low), 1), 0) * 255) END::INTEGER AS c FROM {LONG} l JOIN {T} t USING (dim))"


@query(f"SELECT vec_id, list(c ORDER BY dim) AS code FROM {CODED} x GROUP BY vec_id")
def scalar_encode(spark, sf):
    e = embeddings(spark, sf)
    return Z.scalar_encode(e, Z.scalar_train(e)).select("vec_id", "code")


@query(f"SELECT vec_id, list(round(low + c / 255.0::DOUBLE * (high - low), 5) + 0 ORDER BY dim) AS decoded FROM {CODED} x GROUP BY vec_id")
def scalar_decode(spark, sf):
    e = embeddings(spark, sf)
    r = Z.scalar_train(e)
    return Z.scalar_decode(Z.scalar_encode(e, r), r).select("vec_id", F.transform("decoded", lambda x: F.round(x, 5) + F.lit(0.0)).alias("decoded"))


@query(f"""WITH c AS {CODED}, d AS (SELECT q.vec_id AS qid, e.vec_id, sqrt(sum((q.c - e.c) * (q.c - e.c))) AS d FROM c q JOIN c e USING (dim) WHERE q.vec_id < 5 GROUP BY ALL)
SELECT qid, rk, vec_id, round(d, 5) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id)::INTEGER AS rk FROM d) WHERE rk <= 5""")
def scalar_knn(spark, sf):
    e = embeddings(spark, sf)
    coded = Z.scalar_encode(e, Z.scalar_train(e)).select("vec_id", "code")
    asked = coded.filter("vec_id < 5").select(F.col("vec_id").alias("qid"), F.col("code").alias("qc"))
    pairs = coded.crossJoin(F.broadcast(asked)).select("qid", "vec_id", Z.code_distance(F.col("code"), F.col("qc")).alias("distance"))
    return K.top(pairs, 5, "qid", F.col("distance"), "vec_id").select("qid", "rk", "vec_id", F.round("distance", 5).alias("distance"))


@query("""SELECT 64 * 4 AS raw, (64 + 7) // 8 AS "binary", 64 AS scalar, 8 AS pq, 32.0::DOUBLE AS pq_ratio, round(100.0::DOUBLE * (1 - count(*) * 8 / (count(*) * 256.0::DOUBLE)), 4) AS pq_saved_percent FROM embeddings""")
def compression_sizes(spark, sf):
    s = Z.sizes(DIM, M, embeddings(spark, sf).count())
    return spark.createDataFrame([tuple(round(v, 4) if isinstance(v, float) else v for v in s.values())], "raw int, `binary` int, scalar int, pq int, pq_ratio double, pq_saved_percent double")


# --- product --------------------------------------------------------------------------------------------------------
BOOK = f"(SELECT vec_id AS code, (dim - 1) // 8 AS sub, list(x ORDER BY dim) AS c FROM {LONG} l WHERE vec_id < {CODES} GROUP BY ALL)"
PARTS = f"(SELECT vec_id, (dim - 1) // 8 AS sub, list(x ORDER BY dim) AS p FROM {LONG} l GROUP BY ALL)"
NEAR = f"(SELECT vec_id, sub, arg_min(code, (list_distance(p, c), code)) AS code FROM {PARTS} p JOIN {BOOK} b USING (sub) GROUP BY ALL)"


def first_book(spark, sf):
    return Z.first_codebook(embeddings(spark, sf), M, CODES, DIM)


@query(f"SELECT vec_id, list(code::INTEGER ORDER BY sub) AS code FROM {NEAR} n GROUP BY vec_id")
def pq_encode(spark, sf):
    """With the codebook that training starts from."""
    return Z.pq_encode(embeddings(spark, sf), first_book(spark, sf), M, DIM).select("vec_id", "code")


@query(f"SELECT vec_id, round(sqrt(sum(pow(list_distance(p, c), 2))), 5) AS error FROM {NEAR} n JOIN {BOOK} b USING (sub, code) JOIN {PARTS} p USING (vec_id, sub) GROUP BY vec_id")
def pq_decode_error(spark, sf):
    """The distance of each vector from what its code decodes to."""
    from ..functions.vector import l2

    book = first_book(spark, sf)
    return Z.pq_decode(Z.pq_encode(embeddings(spark, sf), book, M, DIM), book).select("vec_id", F.round(l2("embedding", "decoded"), 5).alias("error"))


ADC = f"""(SELECT vec_id, sqrt(sum(pow(list_distance(c, list_slice({VECTOR_SQL}, sub * 8 + 1, sub * 8 + 8)), 2))) AS d FROM {NEAR} n JOIN {BOOK} b USING (sub, code) GROUP BY vec_id)"""


def _adc(metric):
    def run(spark, sf):
        book = first_book(spark, sf)
        coded = Z.pq_encode(embeddings(spark, sf), book, M, DIM)
        table = Z.books(book).select(Z.lookup_table(F.array(*map(F.lit, VECTOR)), F.col("book"), M, DIM, metric).alias("lut"))
        scored = coded.crossJoin(F.broadcast(table)).select("vec_id", F.round(Z.adc_distance(F.col("code"), F.col("lut"), metric), 5).alias("distance"))
        return scored.orderBy("distance", "vec_id").limit(10)

    return run


def _adc_sql(one: str) -> str:
    part = one.format(f"list_inner_product(c, list_slice({VECTOR_SQL}, sub * 8 + 1, sub * 8 + 8))")
    return f"SELECT vec_id, round(sum({part}), 5) AS distance FROM {NEAR} n JOIN {BOOK} b USING (sub, code) GROUP BY vec_id ORDER BY distance, vec_id LIMIT 10"


many({
    "pq_adc_knn": (_adc("l2"), f"SELECT vec_id, round(d, 5) AS distance FROM {ADC} a ORDER BY round(d, 5), vec_id LIMIT 10"),
    "pq_adc_cosine": (_adc("cosine"), _adc_sql("1 - {}")),
    "pq_adc_ip": (_adc("ip"), _adc_sql("-{}")),
})


@query(f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {VECTOR_SQL}), 5) AS distance FROM embeddings JOIN (SELECT vec_id FROM {ADC} a ORDER BY d, vec_id LIMIT 40) USING (vec_id) ORDER BY list_distance(embedding::DOUBLE[], {VECTOR_SQL}), vec_id LIMIT 10")
def pq_adc_rerank(spark, sf):
    book = first_book(spark, sf)
    coded = Z.pq_encode(embeddings(spark, sf), book, M, DIM)
    return Z.adc_search(coded, book, VECTOR, 10, M, exact="embedding").withColumn("distance", F.round("distance", 5))


@query()
def pq_train(spark, sf):
    """Ten iterations; tests hold it against plain numpy."""
    book = Z.pq_train(embeddings(spark, sf), M, CODES, DIM, store=stored)
    return book.select("sub", "code", F.transform("centroid", lambda x: F.round(x, 5)).alias("centroid"))


@query()
def pq_refine(spark, sf):
    """The codebook after every vector has moved its centroids, in order of ids; tests hold it against plain numpy."""
    out = Z.refine(first_book(spark, sf), embeddings(spark, sf), M, DIM)
    return out.select("sub", "code", F.transform("centroid", lambda x: F.round(x, 5)).alias("centroid"))


@query("SELECT count(*) AS queries, TRUE AS good FROM embeddings WHERE vec_id % 20 = 0")
def pq_recall(spark, sf):
    """Whether looked-up distances, by a trained codebook of 16 parts, the 200 best ranked again, reach a mean recall@10 of 0.9."""
    e, m = embeddings(spark, sf), 16
    book = Z.pq_train(e, m, 32, DIM, iterations=3, store=stored)
    asked = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    found = Z.adc_batch(Z.pq_encode(e, book, m, DIM), book, asked, 10, exact="embedding", over=20)
    each = K.recall(found, K.knn_blocks(e, asked, 10), 10)
    return each.agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.9).alias("good"))
