"""The registered queries of this package: each applies its operator to whole tables and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, mixing, pieces, quality, rules, secrets, simhash, token_store, topk, urls
from .runtime import table

PIECE_MODEL, WORD_MODEL, END_ID = "piece_bpe_32k.model", "word_bpe_49k.json", 1


def _sha(column: Column | str) -> Column:
    return F.sha2(column if isinstance(column, Column) else F.col(column), 256)


def op1_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    out = chat.read_back(chat.format_windows(turns.unionByName(more)))
    return out.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.with_spans(docs, secrets.learn(secrets.samples(docs))).drop("text")
    count = lambda k: F.size(F.filter("base_spans", lambda x: x["rank"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        _sha(secrets.as_text("base_spans")).alias("base_sha256"), secrets.as_text("spans").alias("spans"),
    )


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pieces.encode(docs, PIECE_MODEL, drop=("text",), decoded="decoded")
    return out.select(
        "doc_id", F.size("piece_ids").cast("long").alias("n_tokens"),
        _sha(F.array_join(F.col("piece_ids").cast("array<string>"), ",")).alias("ids_sha256"), _sha("decoded").alias("decoded_sha256"),
    )


def op5_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def url_events(pages: DataFrame) -> DataFrame:
    """The dated list of op6: hosts of the pages, without a leading www, m or blog. The md5 of a host says whether it is
    listed (a first digit of 0 to 3), with its subdomains or only for pages in German, and when: it is added, removed, and
    added again for good. The two advertisers are on the list from March 2024."""
    bare = F.regexp_replace(urls.host("url"), r"^(www|m|blog)\.", "")
    hosts = pages.select(bare.alias("h")).filter("h != ''").distinct().withColumn("m", F.md5("h"))
    number = lambda at: F.conv(F.substring("m", at, 2), 16, 10).cast("int")
    listed = hosts.filter(F.substring("m", 1, 1).isin("0", "1", "2", "3")).select(
        F.when(number(2) % 2 == 0, F.col("h")).otherwise(F.concat("h", F.lit("/de"))).alias("pattern"), number(4).alias("n")
    )
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    dated = listed.select("pattern", F.explode(F.array(
        F.struct(F.lit("add").alias("action"), day(F.col("n") % 90).alias("day")),
        F.struct(F.lit("remove").alias("action"), day(F.col("n") % 90 + 60).alias("day")),
        F.struct(F.lit("add").alias("action"), day(F.col("n") % 90 + 200).alias("day")),
    )).alias("e")).select("pattern", "e.action", "e.day")
    fixed = [(h, "add") for h in ("spam-farm.example.org", "cheap-pills.example.com")]
    return dated.union(pages.sparkSession.createDataFrame(fixed, "pattern string, action string").withColumn("day", F.lit("2024-03-01").cast("date")))


def op6_url_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages carry no date, so page_id gives one: its multiple of 37 within the year 2024."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_on", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 366).cast("int")))
    return urls.judge(captures, url_events(pages)).select("page_id", "fetched_on", "n_active", "blocked", "rule", "listed_on")


def op7_ball_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", topk.whole_components("embedding").alias("vector"))
    asked = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    return topk.top_k(asked, rows, 20).select("query_id", "rank", "vec_id", "score")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = token_store.write(table(spark, sf_dir, "documents"), WORD_MODEL, END_ID)
    return token_store.crc32(token_store.read(segments))


def op10_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rules.with_rules(docs, drop=("text",), whole=rules.LEARNT_WHOLE, chunk=rules.LEARNT_CHUNK, bad_chunks=rules.LEARNT_BAD_CHUNKS).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_qda, op2_chat_windows, op3_secret_scan, op4_sentencepiece, op5_simhash_anchors, op6_url_asof,
        op7_ball_tree_topk, op8_source_mix, op9_token_store, op10_compression_bands,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op6_url_asof": r"""
WITH captures AS (
  SELECT page_id, DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS fetched_on,
    regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.$', '') AS host,
    regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '^/+|/+$', '', 'g') AS path
  FROM pages),
hosts AS (SELECT DISTINCT regexp_replace(host, '^(www|m|blog)\.', '') AS h FROM captures WHERE host <> ''),
digits AS (SELECT h, md5(h) AS m FROM hosts),
listed AS (
  SELECT CASE WHEN ('0x' || substr(m, 2, 2))::INTEGER % 2 = 0 THEN h ELSE h || '/de' END AS pattern,
    ('0x' || substr(m, 4, 2))::INTEGER % 90 AS n
  FROM digits WHERE substr(m, 1, 1) IN ('0', '1', '2', '3')),
spans AS (
  SELECT pattern, DATE '2024-01-01' + n AS valid_from, DATE '2024-01-01' + n + 60 AS valid_to FROM listed
  UNION ALL SELECT pattern, DATE '2024-01-01' + n + 200, DATE '9999-12-31' FROM listed),
fixed AS (
  SELECT unnest(['spam-farm.example.org', 'cheap-pills.example.com']) AS pattern, DATE '2024-03-01' AS valid_from, DATE '9999-12-31' AS valid_to),
lists AS (  -- an add while a pattern is listed changes nothing, so intervals of one pattern are joined
  SELECT pattern, min(valid_from) AS valid_from, max(valid_to) AS valid_to FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY pattern ORDER BY valid_from, valid_to) AS run FROM (
      SELECT *, CASE WHEN valid_from <= max(valid_to) OVER (PARTITION BY pattern ORDER BY valid_from, valid_to ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh
      FROM (SELECT * FROM spans WHERE pattern NOT IN (SELECT pattern FROM fixed) UNION ALL SELECT * FROM fixed)))
  GROUP BY pattern, run),
hits AS (
  SELECT page_id, fetched_on, pattern, valid_from
  FROM captures JOIN lists ON fetched_on >= valid_from AND fetched_on < valid_to
    AND (host = split_part(pattern, '/', 1) OR ends_with(host, '.' || split_part(pattern, '/', 1)))
    AND (NOT contains(pattern, '/') OR starts_with(lower(path) || '/', substr(pattern, strpos(pattern, '/') + 1) || '/')))
SELECT c.page_id, c.fetched_on, count(pattern) AS n_active, count(pattern) > 0 AS blocked,
  arg_min(pattern, (-length(pattern), pattern)) AS rule, arg_min(valid_from, (-length(pattern), pattern)) AS listed_on
FROM captures c LEFT JOIN hits h ON c.page_id = h.page_id
GROUP BY c.page_id, c.fetched_on""",
    "op7_ball_tree_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS vector FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, r.vec_id, list_dot_product(q.vector, r.vector)::BIGINT AS score
    FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0))
WHERE rank <= 20""",
    "op8_source_mix": r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
own AS (
  SELECT source, source_size, 3 * source_size AS cap, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source)),
levels AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shares FROM own),
level AS (SELECT rest, shares FROM levels WHERE rest * weight <= cap * shares ORDER BY cap / weight, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size, least(cap::DOUBLE, (level.rest * weight)::DOUBLE / level.shares::DOUBLE) AS target FROM own, level),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM docs JOIN rates ON docs.source IS NOT DISTINCT FROM rates.source""",
}
