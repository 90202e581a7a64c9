"""Text ranking, sparse vectors and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sparse as S
from ..operators import fusion, text_search
from ..operators.knn import knn
from ..sources.tables import read
from .registry import many, query
from .vectors import VECTOR, VECTOR_SQL, embeddings


def documents(spark, sf):
    return read(spark, sf, "documents")


WORDS = """(SELECT doc_id, lang, CASE WHEN t = '' THEN []::VARCHAR[] ELSE string_split(t, ' ') END AS words FROM (
  SELECT doc_id, lang, trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS t FROM documents))"""


def bm25_sql(terms: list[str], k: int, where: str = "TRUE") -> str:
    return f"""WITH d AS (SELECT doc_id, words, len(words) AS n FROM {WORDS} x WHERE {where}),
q AS (SELECT unnest({terms!r}) AS term),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(words) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT count(*) AS docs, avg(n) AS avg_n FROM d)
SELECT doc_id, round(sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * n / avg_n))), 5) AS score
FROM q JOIN tf USING (term) JOIN df USING (term), s GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT {k}"""


def ranked(df):
    return df.withColumn("score", F.round("score", 5))


def top_scores(df, k):
    return ranked(df).orderBy(F.col("score").desc(), "doc_id").limit(k)


many({
    "bm25_topk": (lambda s, sf: top_scores(text_search.bm25(documents(s, sf), "the"), 10), bm25_sql(["the"], 10)),
    "bm25_multi": (lambda s, sf: top_scores(text_search.bm25(documents(s, sf), "the That, and the"), 20), bm25_sql(["the", "that", "and", "the"], 20)),
    "bm25_after_delete": (lambda s, sf: top_scores(text_search.bm25(documents(s, sf).filter("lang != 'en'"), "der que"), 10), bm25_sql(["der", "que"], 10, "lang <> 'en'")),
    "bm25_unknown": (lambda s, sf: top_scores(text_search.bm25(documents(s, sf), "zzzzqqq"), 10), bm25_sql(["zzzzqqq"], 10)),
})


@query(f"SELECT (SELECT count(*) FROM documents) AS doc_count, count(DISTINCT w) AS vocab_size FROM (SELECT unnest(words) AS w FROM {WORDS} x)")
def vocab_stats(spark, sf):
    return text_search.vocabulary(documents(spark, sf))


@query(f"""SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 5) AS idf FROM (
  SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(words) AS term FROM {WORDS} x) GROUP BY term), (SELECT count(*) AS n FROM documents)""")
def idf(spark, sf):
    return text_search.idf(documents(spark, sf)).select("term", "df", F.round("idf", 5).alias("idf"))


@query(f"SELECT doc_id, len(words) AS len, count(DISTINCT w) AS n_terms FROM (SELECT doc_id, words, unnest(words) AS w FROM {WORDS} x) GROUP BY ALL")
def postings_stats(spark, sf):
    return text_search.lengths(documents(spark, sf)).filter("len > 0")


# --- sparse vectors: the large components of embeddings -------------------------------------------------------------
def sparse(spark, sf):
    limit = F.lit(0.15).cast("float")  # a double would let the float nearest to 0.15 through
    large = F.filter(F.transform("embedding", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: F.abs(p["x"]) > limit)
    return embeddings(spark, sf).select(F.col("vec_id").alias("doc_id"), F.map_from_entries(large).alias("sparse"))


LONG = "(SELECT vec_id AS doc_id, i - 1 AS dim, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i) WHERE abs(embedding[i]) > 0.15::FLOAT)"


def _sparse_pairs(spark, sf):
    s = sparse(spark, sf)
    a = s.select(F.col("doc_id").alias("a"), F.col("sparse").alias("sa"), (F.col("doc_id") + 7).alias("b"))
    return a.join(s.select(F.col("doc_id").alias("b"), F.col("sparse").alias("sb")), "b")


@query(f"""WITH s AS {LONG}, p AS (SELECT v.vec_id AS a, v.vec_id + 7 AS b FROM embeddings v),
m AS (SELECT doc_id, sqrt(sum(x * x)) AS m, count(*) AS n FROM s GROUP BY doc_id),
d AS (SELECT p.a, p.b, sum(x.x * y.x) AS dot, count(*) AS both FROM p JOIN s x ON x.doc_id = p.a JOIN s y ON y.doc_id = p.b AND y.dim = x.dim GROUP BY ALL)
SELECT p.a, p.b, round(coalesce(dot, 0), 5) AS dot, round(coalesce(coalesce(dot, 0) / (ma.m * mb.m), 0), 5) AS cosine,
  round(CASE WHEN ma.n IS NULL AND mb.n IS NULL THEN 1 ELSE coalesce("both", 0) / (coalesce(ma.n, 0) + coalesce(mb.n, 0) - coalesce("both", 0)) END, 5) AS jaccard
FROM p JOIN embeddings e ON e.vec_id = p.b LEFT JOIN d USING (a, b) LEFT JOIN m ma ON ma.doc_id = a LEFT JOIN m mb ON mb.doc_id = b""")
def sparse_similarities(spark, sf):
    """Dot product, cosine and Jaccard of sparse vectors."""
    p = _sparse_pairs(spark, sf)
    return p.select("a", "b", F.round(S.dot("sa", "sb"), 5).alias("dot"), F.round(S.cosine_similarity("sa", "sb"), 5).alias("cosine"), F.round(S.jaccard_similarity("sa", "sb"), 5).alias("jaccard"))


SPARSE_QUERY = {0: 1.0, 5: -0.5, 9: 2.0, 33: 0.25}


@query(f"""SELECT doc_id, round(sum(x * w), 5) AS score FROM {LONG} s JOIN (VALUES (0, 1.0::DOUBLE), (5, -0.5), (9, 2.0), (33, 0.25)) q(dim, w) USING (dim)
GROUP BY doc_id HAVING sum(x * w) > 0 ORDER BY sum(x * w) DESC, doc_id LIMIT 10""")
def sparse_topk(spark, sf):
    return ranked(text_search.sparse_scores(sparse(spark, sf), SPARSE_QUERY, 10))


@query(f"SELECT count(DISTINCT doc_id) AS vectors, count(*) AS total_nnz, count(*) / count(DISTINCT doc_id) AS avg_nnz FROM {LONG} s")
def sparse_stats(spark, sf):
    nnz = sparse(spark, sf).filter(S.is_valid("sparse")).select(F.size("sparse").cast("long").alias("n"))
    return nnz.agg(F.count("*").alias("vectors"), F.sum("n").alias("total_nnz"), F.avg("n").alias("avg_nnz"))


# --- fusion ---------------------------------------------------------------------------------------------------------
def _signals(spark, sf, k):
    n = fusion.candidates(k)
    dense = knn(embeddings(spark, sf), VECTOR, n, "cosine").withColumnRenamed("vec_id", "doc_id")
    words = fusion.normalized(ranked(text_search.bm25(documents(spark, sf), "the and")), "minmax").orderBy(F.col("score").desc(), "doc_id").limit(n)
    return dense, words, ranked(text_search.sparse_scores(sparse(spark, sf), SPARSE_QUERY)).orderBy(F.col("score").desc(), "doc_id").limit(n)


def fuse_sql(dense: float, bm25: float, sparse_: float, k: int = 10) -> str:
    n = 3 * k
    words = bm25_sql(["the", "and"], 10**9).replace("ORDER BY score DESC, doc_id LIMIT 1000000000", "")
    return f"""WITH b0 AS ({words}),
b AS (SELECT doc_id, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS score FROM b0 ORDER BY score DESC, doc_id LIMIT {n}),
d AS (SELECT vec_id AS doc_id, 1 - list_inner_product(embedding::DOUBLE[], {VECTOR_SQL}) AS dist FROM embeddings ORDER BY dist, vec_id LIMIT {n}),
s AS (SELECT doc_id, round(sum(x * w), 5) AS score FROM {LONG} s JOIN (VALUES (0, 1.0::DOUBLE), (5, -0.5), (9, 2.0), (33, 0.25)) q(dim, w) USING (dim) GROUP BY doc_id HAVING sum(x * w) > 0 ORDER BY score DESC, doc_id LIMIT {n}),
u AS (SELECT doc_id, 1 - greatest(least(dist, 1), 0) AS v, {dense} AS w FROM d UNION ALL SELECT doc_id, score, {bm25} FROM b UNION ALL SELECT doc_id, score, {sparse_} FROM s)
SELECT doc_id, round(sum(v * w) / sum(w), 4) AS score, count(*) AS signals FROM u GROUP BY doc_id ORDER BY sum(v * w) / sum(w) DESC, doc_id LIMIT {k}"""


def _fuse(preset: str):
    def run(spark, sf):
        out = fusion.fuse(*_signals(spark, sf, 10), 10, fusion.PRESETS[preset])
        n = sum((F.col(c).isNotNull().cast("long") for c in ("dense", "bm25", "sparse")), F.lit(0).cast("long"))
        return out.select("doc_id", F.round("score", 4).alias("score"), n.alias("signals"))

    return run


many({f"hybrid_{name}": (_fuse(name), fuse_sql(w.dense, w.bm25, w.sparse)) for name, w in fusion.PRESETS.items()})


def _norm(how: str):
    def run(spark, sf):
        rows = embeddings(spark, sf).select("vec_id", F.element_at("embedding", 1).cast("double").alias("score"))
        return fusion.normalized(rows, how).withColumn("score", F.round("score", 6))

    return run


X = "(SELECT vec_id, embedding[1]::DOUBLE AS x FROM embeddings)"
many({
    "norm_minmax": (_norm("minmax"), f"SELECT vec_id, round((x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()), 6) AS score FROM {X} t"),
    "norm_zscore": (_norm("zscore"), f"SELECT vec_id, round((x - avg(x) OVER ()) / stddev_pop(x) OVER (), 6) AS score FROM {X} t"),
    "norm_softmax": (_norm("softmax"), f"SELECT vec_id, round(exp(x - m) / sum(exp(x - m)) OVER (), 6) AS score FROM (SELECT *, max(x) OVER () AS m FROM {X} t)"),
})


def _slots(spark, sf):
    e = embeddings(spark, sf)
    kind = "struct<slot: string, dense: array<float>, sparse: map<int, float>>"
    s = sparse(spark, sf).withColumnRenamed("doc_id", "vec_id")
    rows = e.join(s, "vec_id")
    title = F.struct(F.lit("title").alias("slot"), F.col("embedding").alias("dense"), F.lit(None).cast("map<int,float>").alias("sparse"))
    body = F.struct(F.lit("body_text").alias("slot"), F.when(F.col("vec_id") % 4 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")).alias("dense"), F.lit(None).cast("map<int,float>").alias("sparse"))
    terms = F.struct(F.lit("terms").alias("slot"), F.lit(None).cast("array<float>").alias("dense"), F.col("sparse").alias("sparse"))
    bad = F.struct(F.lit("no good").alias("slot"), F.col("embedding").alias("dense"), F.lit(None).cast("map<int,float>").alias("sparse"))
    slots = F.when(F.col("vec_id") % 3 == 0, F.array(terms.cast(kind))).when(F.col("vec_id") % 3 == 1, F.array(title.cast(kind), body.cast(kind), bad.cast(kind))).otherwise(F.array(title.cast(kind), terms.cast(kind)))
    return rows.select(F.col("vec_id").alias("doc_id"), F.explode(slots).alias("s")).select("doc_id", "s.*")


NNZ = "len(list_filter(embedding, lambda x: abs(x) > 0.15::FLOAT))"
MULTI = f"""(SELECT vec_id AS doc_id, CASE vec_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS n_dense, CASE vec_id % 3 WHEN 1 THEN 0 ELSE 1 END::BIGINT AS n_sparse,
  NOT (vec_id % 3 = 1 AND vec_id % 4 = 0) AS consistent,
  (64 + CASE vec_id % 3 WHEN 0 THEN 5 + 8 * {NNZ} WHEN 1 THEN 5 + 256 + 9 + CASE WHEN vec_id % 4 = 0 THEN 128 ELSE 256 END ELSE 5 + 256 + 5 + 8 * {NNZ} END)::BIGINT AS bytes FROM embeddings)"""


@query(f"SELECT * FROM {MULTI} t")
def multivector_dims(spark, sf):
    """Of each document with named vectors: counts, whether dense lengths agree, and an estimate of its size."""
    return fusion.slot_stats(_slots(spark, sf))


@query(f"SELECT CASE WHEN n_dense > 0 AND n_sparse > 0 THEN 'hybrid' WHEN n_dense > 0 THEN 'dense' ELSE 'sparse' END AS kind, count(*) AS documents, sum(bytes)::BIGINT AS bytes FROM {MULTI} t GROUP BY ALL")
def multivector_stats(spark, sf):
    return fusion.store_stats(fusion.slot_stats(_slots(spark, sf)))
