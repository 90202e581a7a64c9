"""Stores on a shared file system, batches with statuses, slots of documents, tiers and joined streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sparse as P
from ..operators import collection as C
from ..operators import fusion
from ..operators import quantize as Z
from ..operators import routing as R
from ..sources.scratch import scratch_path
from ..sources.tables import ChangeFeed, GraphSnapshots, KeyValueStore
from ..streaming import ingest
from .changes import events
from .registry import many, query
from .text import LONG, _sparse_pairs
from .vectors import embeddings


# --- keys and values, logs, graph snapshots -------------------------------------------------------------------------
def _store(spark, sf) -> KeyValueStore:
    """Every row is put, every third put again, every seventh deleted."""
    rows = embeddings(spark, sf).select("vec_id", F.concat(F.lit("vec_"), F.col("vec_id").cast("string")).alias("key"), F.col("label").cast("string").alias("value"))
    store = KeyValueStore(spark, scratch_path(spark, "store"))
    store.put(rows, 1)
    store.put(rows.filter("vec_id % 3 = 0").withColumn("value", F.lit("new")), 2)
    store.delete(rows.filter("vec_id % 7 = 0"), 3)
    return store


@query("SELECT 'vec_' || vec_id AS key, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE label::VARCHAR END AS value FROM embeddings WHERE vec_id % 7 <> 0 AND starts_with('vec_' || vec_id, 'vec_1')")
def store_scan(spark, sf):
    return _store(spark, sf).scan("vec_1")


@query("SELECT 'vec_' || vec_id * 2 AS key, vec_id * 2 < (SELECT count(*) FROM embeddings) AND vec_id * 2 % 7 <> 0 AS found FROM embeddings")
def store_contains(spark, sf):
    asked = embeddings(spark, sf).select(F.concat(F.lit("vec_"), (F.col("vec_id") * 2).cast("string")).alias("key"))
    return _store(spark, sf).contains(asked)


def _log(spark, sf, cleared: bool) -> ChangeFeed:
    ops = events(spark, sf).select(F.col("event_id").alias("seq"), F.col("event_type").alias("op"), F.col("user_id").alias("id"))
    feed = ChangeFeed(spark, scratch_path(spark, "log"), "seq long, op string, id long")
    feed.append(ops.filter("seq % 2 = 0"))
    if cleared:
        feed.clear()
    feed.append(ops.filter("seq % 2 = 1"))
    return feed


@query("SELECT event_id AS seq, event_type AS op, user_id AS id FROM events WHERE event_id > 100")
def log_read(spark, sf):
    return _log(spark, sf, False).read(100)


@query("SELECT event_id AS seq, event_type AS op, user_id AS id FROM events WHERE event_id % 2 = 1")
def log_cleared(spark, sf):
    return _log(spark, sf, True).read()


@query("SELECT v AS version, vec_id AS src, vec_id + v AS dst FROM embeddings, range(2, 4) r(v)")
def graph_snapshots(spark, sf):
    """Three versions are saved, the oldest goes, the others are loaded."""
    e, shots = embeddings(spark, sf), GraphSnapshots(spark, scratch_path(spark, "graphs"))
    for v in (1, 2, 3):
        shots.save(e.select(F.col("vec_id").alias("src"), (F.col("vec_id") + v).alias("dst")), v)
    shots.cleanup(2)
    first, second = (shots.load(v).select(F.lit(v).cast("long").alias("version"), "src", "dst") for v in shots.list())
    return first.union(second)


# --- batches --------------------------------------------------------------------------------------------------------
def _ops(spark, sf):
    v = F.when(F.col("vec_id") % 13 == 0, F.lit(None)).when(F.col("vec_id") % 11 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    op = F.when(F.col("vec_id") % 17 == 0, "rename").when(F.col("vec_id") % 3 == 0, "delete").otherwise("insert")
    return embeddings(spark, sf).select(F.col("vec_id").alias("seq"), op.alias("op"), (F.col("vec_id") % 40).alias("vec_id"), v.alias("embedding"))


def _statuses(policy):
    return lambda spark, sf: C.statuses(embeddings(spark, sf).filter("vec_id < 20").select("vec_id"), _ops(spark, sf), 64, policy).select("seq", "op", "vec_id", "error")


def _statuses_sql(rejects: str) -> str:
    return f"""WITH o AS (SELECT vec_id AS seq, CASE WHEN vec_id % 17 = 0 THEN 'rename' WHEN vec_id % 3 = 0 THEN 'delete' ELSE 'insert' END AS op, vec_id % 40 AS id FROM embeddings),
b AS (SELECT *, CASE WHEN op = 'rename' THEN 1702 WHEN op = 'insert' AND seq % 13 = 0 THEN 1702 WHEN op = 'insert' AND seq % 11 = 0 THEN 1001 END AS bad FROM o),
t AS (SELECT *, coalesce(last_value(CASE WHEN bad IS NULL THEN op = 'insert' END IGNORE NULLS) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), id < 20) AS there FROM b)
SELECT seq, op, id AS vec_id, (CASE WHEN bad IS NOT NULL THEN bad WHEN op = 'delete' AND NOT there THEN 1401 WHEN {rejects} AND op = 'insert' AND there THEN 1503 END)::INTEGER AS error FROM t"""


many({"batch_statuses": (_statuses("overwrite"), _statuses_sql("FALSE")), "batch_statuses_reject": (_statuses("reject"), _statuses_sql("TRUE"))})


@query("""SELECT reason, count(*) AS total, count(*) FILTER (WHERE ts <= 5000) AS cleaned FROM (
  SELECT user_id, CASE event_type WHEN 'error' THEN 'ttl_expired' ELSE 'user_delete' END AS reason, max(event_id) AS ts FROM events WHERE event_type IN ('error', 'view') GROUP BY ALL) GROUP BY reason""")
def tombstone_reasons(spark, sf):
    e = events(spark, sf).select(F.col("user_id").alias("id"), "event_type", "event_id")
    ts = F.col("event_id")
    both = C.bury(e.filter("event_type = 'error'"), "ttl_expired", ts).union(C.bury(e.filter("event_type = 'view'"), "user_delete", ts))
    return C.tombstone_stats(both, 5_000)


# --- documents with several vectors ---------------------------------------------------------------------------------
def _named(spark, sf):
    none = F.lit(None).cast("map<int,float>")
    return embeddings(spark, sf).select(F.col("vec_id").alias("doc_id"), F.lit("title").alias("slot"), F.col("embedding").alias("dense"), none.alias("sparse"))


@query("""SELECT vec_id AS doc_id, 'title' AS slot, CASE WHEN vec_id % 4 = 0 THEN 8 ELSE 64 END AS n FROM embeddings WHERE vec_id % 5 <> 0 UNION ALL SELECT vec_id, 'body', 64 FROM embeddings WHERE vec_id % 3 = 0""")
def slot_changes(spark, sf):
    """Slots are set, added and removed; one with a bad name is not taken."""
    old = _named(spark, sf)
    new = old.filter("doc_id % 4 = 0").withColumn("dense", F.slice("dense", 1, 8)).union(old.filter("doc_id % 3 = 0").withColumn("slot", F.lit("body")))
    new = new.union(old.withColumn("slot", F.lit("not a name")))
    return fusion.remove_slot(fusion.set_slot(old, new), old.filter("doc_id % 5 = 0")).select("doc_id", "slot", F.size("dense").alias("n"))


@query("SELECT vec_id AS doc_id FROM embeddings WHERE vec_id % 3 = 0")
def slot_documents(spark, sf):
    old = _named(spark, sf)
    return fusion.documents_with(fusion.set_slot(old, old.filter("doc_id % 3 = 0").withColumn("slot", F.lit("body"))), "body")


@query(f"""WITH s AS {LONG}, p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 7),
m AS (SELECT doc_id, sqrt(sum(x * x)) AS m FROM s GROUP BY doc_id), d AS (SELECT p.a, p.b, sum(x.x * y.x) AS dot FROM p JOIN s x ON x.doc_id = p.a JOIN s y ON y.doc_id = p.b AND y.dim = x.dim GROUP BY ALL)
SELECT p.a, p.b, round(1 - coalesce(dot / (ma.m * mb.m), 0), 5) AS distance FROM p LEFT JOIN d USING (a, b) LEFT JOIN m ma ON ma.doc_id = a LEFT JOIN m mb ON mb.doc_id = b""")
def sparse_distances(spark, sf):
    return _sparse_pairs(spark, sf).select("a", "b", F.round(P.cosine_distance("sa", "sb"), 5).alias("distance"))


# --- shards, tiers, sizes -------------------------------------------------------------------------------------------
@query("SELECT vec_id, (CASE WHEN substr(h, 1, 2) < '08' THEN ('0x' || substr(h, 1, 2))::INTEGER ELSE 7 END) AS shard FROM (SELECT vec_id, md5(vec_id::VARCHAR) AS h FROM embeddings)")
def shard_even_ranges(spark, sf):
    key = F.md5(F.col("vec_id").cast("string"))
    return embeddings(spark, sf).select("vec_id", R.range_shard(key, R.even_ranges(8)).alias("shard"))


@query("""SELECT tenant, tier, (CASE tier WHEN 'free' THEN vectors <= 1000000 AND bytes <= 1073741824 AND qps <= 100 AND collections <= 10
  WHEN 'pro' THEN vectors <= 100000000 AND bytes <= 107374182400 AND qps <= 1000 AND collections <= 100 ELSE TRUE END) AS within,
  (CASE tier WHEN 'free' THEN greatest(100 - floor(bytes * 100.0::DOUBLE / 1073741824), 0) WHEN 'pro' THEN greatest(100 - floor(bytes * 100.0::DOUBLE / 107374182400), 0) ELSE 100 END)::BIGINT AS remaining
FROM (SELECT user_id AS tenant, ['free', 'pro', 'enterprise'][1 + user_id % 3] AS tier, count(*) AS qps, count(*) * 20000000 AS bytes, max(event_id) * 1000 AS vectors, count(DISTINCT event_type) * 3 AS collections FROM events GROUP BY user_id)""")
def tier_quotas(spark, sf):
    use = events(spark, sf).groupBy(F.col("user_id").alias("tenant")).agg(
        F.count("*").alias("qps"), (F.count("*") * 20_000_000).alias("bytes"), (F.max("event_id") * 1_000).alias("vectors"), (F.count_distinct("event_type") * 3).alias("collections")
    )
    tier = F.element_at(F.array(*map(F.lit, R.TIERS)), (F.pmod("tenant", F.lit(3)) + 1).cast("int"))
    return R.tier_use(use.withColumn("tier", tier)).select("tenant", "tier", "within", "remaining")


@query("SELECT 8 * 16 * 4 AS bytes")
def lookup_table_size(spark, sf):
    return spark.createDataFrame([(Z.lookup_table_bytes(8, 16),)], "bytes int")


# --- streams --------------------------------------------------------------------------------------------------------
@query("""SELECT a.user_id, a.event_id AS a, b.event_id AS b, b.ts AS ts FROM events a JOIN events b USING (user_id)
WHERE a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR""")
def stream_join(spark, sf):
    """Purchases within an hour of a view."""
    of = lambda kind: events(spark, sf).filter(F.col("event_type") == kind).select("user_id", F.col("event_id").alias("id"), "ts")
    return ingest.joined(of("view"), of("purchase"), "user_id").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
