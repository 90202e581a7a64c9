"""Vector arithmetic, nearest neighbours and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import filters as flt
from ..operators import knn as K
from ..operators.collection import Collection
from ..operators.duplicates import duplicates, near_pairs
from ..operators.quantize import center, per_dimension
from ..operators.stats import field_values
from ..sources.tables import read
from .registry import many, query


def embeddings(spark, sf) -> DataFrame:
    return read(spark, sf, "embeddings")


def five(rows: DataFrame) -> DataFrame:
    return rows.filter("vec_id < 5").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))


def typed(spark, sf) -> DataFrame:
    """Embeddings with typed metadata; every seventh row has no category."""
    e = embeddings(spark, sf)
    category = F.when(F.col("vec_id") % 7 != 0, F.concat(F.lit("cat_"), F.col("label").cast("string")))
    return e.select("vec_id", "embedding", "label", category.alias("category"), (F.col("vec_id") * 10.0).alias("price"), F.array(F.concat(F.lit("t"), (F.col("vec_id") % 3).cast("string")), F.lit("all")).alias("tags"))


TYPED = """(SELECT vec_id, embedding, label, CASE WHEN vec_id % 7 <> 0 THEN 'cat_' || label END AS category,
  vec_id * 10.0::DOUBLE AS price, ['t' || (vec_id % 3), 'all'] AS tags FROM embeddings)"""
BITS = "list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END)"
Q = "(SELECT vec_id AS qid, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id < 5)"


def knn_sql(distance: str, k: int = 5, rows: str = "(SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)", queries: str = Q, where: str = "TRUE") -> str:
    return f"""SELECT qid, rk, vec_id, round(d, 5) + 0 AS distance FROM (
  SELECT qid, vec_id, d, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id)::INTEGER AS rk
  FROM (SELECT qid, vec_id, {distance} AS d FROM {rows} e, {queries} q WHERE {where})) WHERE rk <= {k}"""


def shown(df: DataFrame) -> DataFrame:
    return df.select("qid", "rk", "vec_id", (F.round("distance", 5) + F.lit(0.0)).alias("distance"))


def _knn(metric: str, binary: bool = False):
    def run(spark, sf):
        rows = embeddings(spark, sf)
        if binary:
            rows = rows.withColumn("embedding", V.binarize("embedding"))
        return shown(K.knn_batch(rows, five(rows), 5, metric))

    return run


BINARY = f"(SELECT vec_id, {BITS} AS v FROM embeddings)"
BINARY_Q = f"(SELECT vec_id AS qid, {BITS} AS qv FROM embeddings WHERE vec_id < 5)"
PAIRS = "list_zip(v, qv)"
many({
    "knn_l2_batch": (_knn("l2"), knn_sql("list_distance(v, qv)")),
    "knn_cosine": (_knn("cosine"), knn_sql("1 - list_inner_product(v, qv)")),
    "knn_cosine_normalizing": (_knn("cosine_any"), knn_sql("list_cosine_distance(v, qv)")),
    "knn_ip": (_knn("ip"), knn_sql("-list_inner_product(v, qv)")),
    "knn_hamming": (_knn("hamming", True), knn_sql(f"len(list_filter({PAIRS}, lambda p: p[1] <> p[2]))::DOUBLE", rows=BINARY, queries=BINARY_Q)),
    "knn_jaccard": (_knn("jaccard", True), knn_sql(f"1 - list_inner_product(v, qv) / nullif(len(list_filter({PAIRS}, lambda p: p[1] + p[2] > 0)), 0)", rows=BINARY, queries=BINARY_Q)),
})


@query(knn_sql("list_distance(v, qv)", k=10, queries="(SELECT vec_id AS qid, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 5 = 0)"))
def knn_blocks_l2(spark, sf):
    """Many queries: block matrix products."""
    e = embeddings(spark, sf)
    asked = e.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    return shown(K.knn_blocks(e, asked, 10))


@query(knn_sql("-list_inner_product(v, qv)", k=10, queries="(SELECT vec_id AS qid, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 5 = 0)"))
def knn_blocks_ip(spark, sf):
    e = embeddings(spark, sf)
    asked = e.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    return shown(K.knn_blocks(e, asked, 10, "ip"))


@query(knn_sql("list_distance(v, qv)", k=10, rows="(SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: (vec_id % 7)::DOUBLE) AS v FROM embeddings WHERE vec_id % 11 <> 0)",
               queries="(SELECT vec_id AS qid, list_transform(embedding::DOUBLE[], lambda x: (vec_id % 4)::DOUBLE) AS qv FROM embeddings WHERE vec_id % 5 = 0)"))
def knn_blocks_ties(spark, sf):
    """Seven vectors, each many times, and rows with a null vector or component: ties go by id, nulls take no part."""
    e = embeddings(spark, sf)
    flat = lambda n: F.transform("embedding", lambda x: (F.col("vec_id") % n).cast("double"))
    odd = F.when(F.col("vec_id") % 22 == 0, F.lit(None)).when(F.col("vec_id") % 11 == 0, F.array(F.lit(None).cast("double"))).otherwise(flat(7))
    asked = e.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("qid"), flat(4).alias("qv"))
    return shown(K.knn_blocks(e.select("vec_id", odd.alias("embedding")), asked, 10))


@query(f"SELECT qid, vec_id, round(list_distance(e.embedding::DOUBLE[], qv), 5) AS distance FROM embeddings e, {Q} q WHERE list_distance(e.embedding::DOUBLE[], qv) <= 1.1")
def knn_range(spark, sf):
    e = embeddings(spark, sf)
    return K.in_range(e, five(e), 1.1).withColumn("distance", F.round("distance", 5))


VECTOR = [0.125 if i % 2 else -0.125 for i in range(64)]
VECTOR_SQL = "[" + ", ".join(map(str, VECTOR)) + "]::DOUBLE[]"


@query(f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {VECTOR_SQL}), 5) AS distance FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {VECTOR_SQL}), vec_id LIMIT 10")
def knn_single(spark, sf):
    """One query vector over the whole collection."""
    return Collection("c", 64, embeddings(spark, sf)).search(VECTOR, 10).withColumn("distance", F.round("distance", 5))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (3, 17, 255)")
def point_lookup(spark, sf):
    return Collection("c", 64, embeddings(spark, sf)).get(3, 17, 255).select("vec_id", "label")


@query(f"""WITH hot AS (SELECT vec_id, list_distance(embedding::DOUBLE[], {VECTOR_SQL}) + 0.01 AS d FROM embeddings WHERE vec_id % 3 = 0),
cold AS (SELECT vec_id, list_distance(embedding::DOUBLE[], {VECTOR_SQL}) AS d FROM embeddings WHERE vec_id % 2 = 0)
SELECT vec_id, round(d, 5) AS distance FROM (SELECT * FROM hot UNION ALL SELECT * FROM cold WHERE vec_id NOT IN (SELECT vec_id FROM hot)) ORDER BY d, vec_id LIMIT 10""")
def knn_merge_layers(spark, sf):
    """A newer layer over an older one: of an id in both the newer distance counts."""
    e = embeddings(spark, sf)
    q = F.array(*map(F.lit, VECTOR))
    hot = e.filter("vec_id % 3 = 0").select("vec_id", (V.l2("embedding", q) + 0.01).alias("distance"))
    cold = e.filter("vec_id % 2 = 0").select("vec_id", V.l2("embedding", q).alias("distance"))
    return K.merge_layers([hot, cold], 10).select("vec_id", F.round("distance", 5).alias("distance"))


@query(f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {VECTOR_SQL}), 5) AS distance FROM embeddings WHERE vec_id BETWEEN 10 AND 59 ORDER BY list_distance(embedding::DOUBLE[], {VECTOR_SQL}), vec_id LIMIT 10")
def rerank(spark, sf):
    e = embeddings(spark, sf)
    return K.rerank(e, e.filter("vec_id between 10 and 59"), VECTOR, 10).withColumn("distance", F.round("distance", 5))


@query(f"""WITH d AS (SELECT qid, vec_id, list_distance(e.embedding::DOUBLE[], qv) AS d FROM embeddings e, {Q} q),
truth AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) <= 10),
half AS (SELECT * FROM d WHERE vec_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) <= 10)
SELECT t.qid, count(h.vec_id) / least(count(*), 10) AS recall FROM truth t LEFT JOIN half h ON t.qid = h.qid AND t.vec_id = h.vec_id GROUP BY t.qid""")
def recall_at_k(spark, sf):
    """Of a search of every second row against all."""
    e = embeddings(spark, sf)
    return K.recall(K.knn_batch(e.filter("vec_id % 2 = 0"), five(e), 10), K.knn_batch(e, five(e), 10), 10)


@query("""SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: round(x / list_distance(embedding::DOUBLE[], list_transform(embedding, lambda y: 0.0::DOUBLE)), 5)) AS unit,
  round(list_distance(embedding::DOUBLE[], list_transform(embedding, lambda y: 0.0::DOUBLE)), 5) AS norm FROM embeddings""")
def normalize(spark, sf):
    e = embeddings(spark, sf)
    signed = lambda x: F.when(F.round(x, 5) == 0, x * F.lit(0.0)).otherwise(F.round(x, 5))  # noqa: E731  round() would lose the sign of a zero
    return e.select("vec_id", F.transform(V.normalize("embedding"), signed).alias("unit"), F.round(V.norm("embedding"), 5).alias("norm"))


MEANS = "(SELECT list(m ORDER BY dim) AS mean FROM (SELECT i AS dim, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY i))"


@query(f"SELECT vec_id, list_transform(list_zip(embedding::DOUBLE[], mean), lambda p: round(p[1] - p[2], 5) + 0) AS centered FROM embeddings, {MEANS}")
def center_vectors(spark, sf):
    return center(embeddings(spark, sf)).select("vec_id", F.transform("centered", lambda x: F.round(x, 5) + F.lit(0.0)).alias("centered"))


@query("SELECT (i - 1)::INTEGER AS dim, round(avg(embedding[i]::DOUBLE), 6) AS mean, round(min(embedding[i]::DOUBLE), 6) AS low, round(max(embedding[i]::DOUBLE), 6) AS high FROM embeddings, range(1, 65) r(i) GROUP BY i")
def dimension_stats(spark, sf):
    stats = per_dimension(embeddings(spark, sf), mean=F.avg, low=F.min, high=F.max)
    return stats.select("dim", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(1 - list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine,
  CASE WHEN 1 - list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) BETWEEN -1 AND 1 THEN round(1 - (1 - list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 5) END AS as_ip, NULL::DOUBLE AS as_l2
FROM embeddings a, embeddings b WHERE b.vec_id = a.vec_id + 1""")
def metric_convert(spark, sf):
    """Distances of neighbours by id, turned into other metrics where that needs no vectors."""
    e = embeddings(spark, sf)
    a = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("va"), (F.col("vec_id") + 1).alias("b"))
    pairs = a.join(e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("vb")), "b").withColumn("d", V.cosine("va", "vb"))
    return pairs.select("a", "b", F.round("d", 5).alias("cosine"), F.round(V.convert(F.col("d"), "cosine", "ip"), 5).alias("as_ip"), V.convert(F.col("d"), "cosine", "l2").alias("as_l2"))


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS valid FROM (SELECT len(v) > 0 AND len(list_filter(v, lambda x: NOT isfinite(x))) = 0 AS ok FROM (
  SELECT CASE WHEN vec_id % 10 = 0 THEN []::DOUBLE[] WHEN vec_id % 10 = 1 THEN list_transform(embedding::DOUBLE[], lambda x: x / 0.0) ELSE embedding::DOUBLE[] END AS v FROM embeddings))""")
def vector_validation(spark, sf):
    v = F.when(F.col("vec_id") % 10 == 0, F.array().cast("array<double>")).when(F.col("vec_id") % 10 == 1, F.transform("embedding", lambda x: F.lit(float("inf")) * F.signum(x.cast("double")))).otherwise(F.col("embedding").cast("array<double>"))
    return embeddings(spark, sf).select(V.is_valid(v).alias("ok")).agg(F.count("*").alias("total"), F.count_if("ok").alias("valid"))


SAME = "len(a.embedding) = len(b.embedding) AND len(list_filter(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda p: abs(p[1] - p[2]) >= 1e-6)) = 0"


@query(f"SELECT a.vec_id AS a, min(b.vec_id) AS b FROM embeddings a JOIN embeddings b ON b.vec_id < a.vec_id AND {SAME} GROUP BY a.vec_id")
def exact_duplicates(spark, sf):
    """Each vector that is a copy of an earlier one, with the first of its class."""
    return duplicates(embeddings(spark, sf))


@query(f"""WITH e AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN list_transform(embedding, lambda x: round(x + vec_id % 7)) ELSE embedding END AS embedding FROM embeddings),
t AS (SELECT vec_id, list_transform(embedding, lambda x: round(x)) AS embedding FROM e WHERE vec_id % 3 = 0)
SELECT a.vec_id AS a, min(b.vec_id) AS b FROM t a JOIN t b ON b.vec_id < a.vec_id AND {SAME} GROUP BY a.vec_id""")
def repeated_vectors(spark, sf):
    """The same over vectors that do repeat: components rounded to whole numbers, of every third row."""
    v = F.transform("embedding", lambda x: F.round(x + (F.col("vec_id") % 7).cast("float")))
    return duplicates(embeddings(spark, sf).filter("vec_id % 3 = 0").select("vec_id", v.alias("embedding")))


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS similarity
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label = b.label WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.6""")
def near_duplicates_in_label(spark, sf):
    """Pairs of one label with a cosine of 0.6 or more, by block products."""
    return near_pairs(embeddings(spark, sf), "label", 0.6).select("a", "b", F.round("dot", 5).alias("similarity"))


# --- filters --------------------------------------------------------------------------------------------------------
def _filter(where: flt.Filter):
    return lambda spark, sf: where.of(typed(spark, sf)).select("vec_id", "label", "category", "price")


def _filter_sql(where: str) -> str:
    return f"SELECT vec_id, label, category, price FROM {TYPED} t WHERE {where}"


FILTERS = {
    "filter_eq": (flt.Eq("category", "cat_3"), "category = 'cat_3'"),
    "filter_eq_number": (flt.Eq("label", 3), "label = 3"),
    "filter_has": (flt.Has("tags", "t1"), "list_contains(tags, 't1')"),
    "filter_ne": (flt.Ne("category", "cat_3"), "coalesce(category <> 'cat_3', TRUE)"),
    "filter_lt": (flt.Lt("price", 250), "price < 250"),
    "filter_le": (flt.Le("price", 250), "price <= 250"),
    "filter_gt": (flt.Gt("price", 4000.0), "price > 4000"),
    "filter_ge": (flt.Ge("price", 4000.0), "price >= 4000"),
    "filter_prefix": (flt.Prefix("category", "cat_1"), "starts_with(category, 'cat_1')"),
    "filter_contains": (flt.Contains("category", "_2"), "contains(category, '_2')"),
    "filter_string_range": (flt.Between("category", ("cat_2", "cat_5")), "category BETWEEN 'cat_2' AND 'cat_5'"),
    "filter_text_less": (flt.TextLess("label", 3), "label::VARCHAR < '3'"),
    "filter_text_greater": (flt.TextGreater("vec_id", "9"), "vec_id::VARCHAR > '9'"),
    "filter_has_all": (flt.HasAll("tags", ["t1", "all"]), "list_contains(tags, 't1') AND list_contains(tags, 'all')"),
    "filter_in": (flt.In("category", ["cat_1", "cat_9"]), "category IN ('cat_1', 'cat_9')"),
    "filter_exists": (flt.Exists("category"), "category IS NOT NULL"),
    "filter_and": (flt.Eq("category", "cat_4") & flt.Gt("price", 1000), "category = 'cat_4' AND price > 1000"),
    "filter_or": (flt.Eq("category", "cat_4") | flt.Lt("price", 100), "category = 'cat_4' OR price < 100"),
    "filter_not": (~(flt.Eq("category", "cat_4") | flt.Lt("price", 100)), "NOT (coalesce(category = 'cat_4', FALSE) OR price < 100)"),
    "filter_and_none": (flt.And(), "TRUE"),
    "filter_or_none": (flt.Or(), "FALSE"),
}
many({name: (_filter(f), _filter_sql(sql)) for name, (f, sql) in FILTERS.items()})


@query(knn_sql("list_distance(v, qv)", rows=f"(SELECT vec_id, embedding::DOUBLE[] AS v, category, price FROM {TYPED} t)", where="category IN ('cat_1', 'cat_2') AND price > 500"))
def filtered_knn(spark, sf):
    """The filter is applied before distances."""
    rows = (flt.In("category", ["cat_1", "cat_2"]) & flt.Gt("price", 500)).of(typed(spark, sf))
    return shown(K.knn_batch(rows, five(embeddings(spark, sf)), 5))


@query(f"""SELECT qid, vec_id, round(d, 5) AS distance FROM (
  SELECT qid, vec_id, d, category FROM (SELECT qid, vec_id, category, list_distance(e.embedding::DOUBLE[], qv) AS d FROM {TYPED} e, {Q} q)
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) <= 50) WHERE coalesce(category IN ('cat_1', 'cat_2'), TRUE)
QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) <= 5""")
def post_filtered_knn(spark, sf):
    """The filter is applied to the 50 nearest; rows without the field pass."""
    rows = typed(spark, sf)
    near = K.knn_batch(rows, five(embeddings(spark, sf)), 50).drop("rk").join(rows.select("vec_id", "category"), "vec_id")
    kept = near.filter(F.coalesce(F.col("category").isin("cat_1", "cat_2"), F.lit(True)))
    return K.top(kept, 5, "qid", F.col("distance"), "vec_id").select("qid", "vec_id", F.round("distance", 5).alias("distance"))


@query(f"SELECT count(*) AS n FROM {TYPED} t WHERE price >= 100 AND NOT coalesce(category = 'cat_0', FALSE)")
def count_matching(spark, sf):
    return flt.count_matching(typed(spark, sf), flt.Ge("price", 100) & ~flt.Eq("category", "cat_0"))


@query("SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 20 OFFSET 40")
def scroll(spark, sf):
    return Collection("c", 64, embeddings(spark, sf)).scroll(20, 40).select("vec_id", "label")


@query("""SELECT count(x) AS "count", sum(x) AS "sum", avg(x) AS "avg", min(x) AS "min", max(x) AS "max" FROM (SELECT try_cast(CASE WHEN vec_id % 4 = 0 THEN 'none' ELSE label::VARCHAR END AS DOUBLE) AS x FROM embeddings)""")
def metadata_aggregate(spark, sf):
    """Over a text field; what is no number is left out."""
    rows = embeddings(spark, sf).withColumn("m", F.when(F.col("vec_id") % 4 == 0, "none").otherwise(F.col("label").cast("string")))
    return Collection("c", 64, rows).aggregate("m")


@query(f"SELECT vec_id FROM {TYPED} t WHERE coalesce(category IN ('cat_1', 'cat_3'), FALSE) AND NOT coalesce(label IN (1), FALSE)")
def bitmap_query(spark, sf):
    return flt.by_values(typed(spark, sf), {"category": ("any", ["cat_1", "cat_3"]), "label": ("not", [1])}).select("vec_id")


@query(f"""SELECT 'category' AS field, count(DISTINCT category) AS n_values, count(category) AS n_rows FROM {TYPED} t
UNION ALL SELECT 'label', count(DISTINCT label), count(label) FROM {TYPED} t""")
def field_index_stats(spark, sf):
    return field_values(typed(spark, sf), "category", "label")


@query(f"SELECT label, count(*) AS n FROM {TYPED} t WHERE NOT (price < 1000) GROUP BY label")
def delete_by_filter(spark, sf):
    left = Collection("c", 64, typed(spark, sf)).delete_by_filter(flt.Lt("price", 1000)).rows
    return left.groupBy("label").agg(F.count("*").alias("n"))


@query(f"SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 7 ELSE label END AS label, CASE WHEN vec_id % 4 <> 0 THEN category END AS category FROM {TYPED} t")
def update_by_id(spark, sf):
    """A row that is written anew keeps only what is written."""
    rows = typed(spark, sf)
    new = rows.filter("vec_id % 4 = 0").select("vec_id", "embedding", F.lit(7).alias("label"))
    return Collection("c", 64, rows).update(new).rows.select("vec_id", "label", "category")


@query(f"SELECT CASE WHEN coalesce(category = 'cat_2', FALSE) THEN 'updated' ELSE category END AS category, count(*) AS n FROM {TYPED} t GROUP BY ALL")
def update_by_filter(spark, sf):
    rows = Collection("c", 64, typed(spark, sf)).update_by_filter(flt.Eq("category", "cat_2"), category="updated").rows
    return rows.groupBy("category").agg(F.count("*").alias("n"))


