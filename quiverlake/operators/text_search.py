"""BM25 ranking and sparse-vector scoring over exploded postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.scratch import stored

K1, B = 1.5, 0.75


def postings(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, term and tf: a count combined before the shuffle."""
    return docs.select(F.col(id_col), F.explode(tokens(text)).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, len and n_terms: the words of each document, and the different ones."""
    words = docs.select(F.col(id_col), tokens(text).alias("__words"))
    return words.select(id_col, F.size("__words").cast("long").alias("len"), F.size(F.array_distinct("__words")).cast("long").alias("n_terms"))


def idf_of(n, df):
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def idf(docs: DataFrame, text: str = "text") -> DataFrame:
    """term, df and idf of the whole vocabulary; each row is a document, as in :func:`bm25`.

    A document's words are made distinct where it is read, so a task sends one count of each term: no postings are shuffled.
    """
    n = docs.agg(F.count("*").alias("n"))
    df = docs.select(F.explode(F.array_distinct(tokens(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", idf_of(F.col("n"), F.col("df")).alias("idf"))  # n is one row


def query_terms(query: str) -> list[tuple[str, int]]:
    import re

    found: dict[str, int] = {}
    for t in re.findall(r"[^\W_]+", query.lower()):
        found[t] = found.get(t, 0) + 1
    return list(found.items())


def bm25(docs: DataFrame, query: str, k: int | None = None, id_col: str = "doc_id", text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """id and score of the documents with a word of the query, best first. A word that the query repeats counts as often.

    Texts are read once: each document is reduced to its length and the counts of the query's words, which are kept in a
    scratch table for the statistics and the scores. No postings are shuffled.
    """
    terms = query_terms(query)
    if not terms:
        return docs.select(id_col, F.lit(0.0).alias("score")).limit(0)
    words = F.col("__words")
    counted = docs.select(F.col(id_col), tokens(text).alias("__words")).select(
        F.col(id_col), F.size(words).alias("len"),
        *[F.size(F.array_remove(words, t)).alias(f"without{i}") for i, (t, _) in enumerate(terms)],
    )
    counted = stored(counted.select(id_col, "len", *[(F.col("len") - F.col(f"without{i}")).alias(f"tf{i}") for i in range(len(terms))]), "counts")
    stats = counted.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *[F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(terms))])
    joined = counted.filter(" or ".join(f"tf{i} > 0" for i in range(len(terms)))).crossJoin(F.broadcast(stats))  # stats is one row
    score = F.lit(0.0)
    for i, (_, times) in enumerate(terms):
        tf = F.col(f"tf{i}")
        one = idf_of(F.col("n"), F.col(f"df{i}")) * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
        score = score + times * F.when(tf > 0, one).otherwise(0.0)
    out = joined.select(id_col, score.alias("score"))
    return out if k is None else out.orderBy(F.col("score").desc(), id_col).limit(k)


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_count and vocab_size."""
    words = docs.select(F.explode(tokens(text)).alias("term")).agg(F.count_distinct("term").alias("vocab_size"))
    return docs.agg(F.count("*").alias("doc_count")).crossJoin(words)


def sparse_scores(rows: DataFrame, query: dict[int, float], k: int | None = None, id_col: str = "doc_id", vector: str = "sparse") -> DataFrame:
    """id and dot product with a sparse query; only scores over 0, best first."""
    from ..functions.sparse import dot

    q = F.create_map(*[x for d, v in query.items() for x in (F.lit(d), F.lit(float(v)))])
    out = rows.select(id_col, dot(F.col(vector), q).alias("score")).filter("score > 0")
    return out if k is None else out.orderBy(F.col("score").desc(), id_col).limit(k)
