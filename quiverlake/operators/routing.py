"""Shard routing, replicas, result merging and cluster predicates, as expressions and small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashes import djb2, fnv1a_low


def hash_shard(key: Column, shards: int) -> Column:
    """DJB2 modulo the shards; 0 shards: 0."""
    return F.lit(0) if shards == 0 else F.pmod(djb2(key), F.lit(shards).cast("decimal(20,0)")).cast("int")


def fnv_shard(key: Column, shards: int) -> Column:
    return F.pmod(fnv1a_low(key), F.lit(shards)).cast("int")


def replicas(shard: Column, shards: int, factor: int) -> Column:
    """The shards of the copies after the first."""
    return F.transform(F.sequence(F.lit(1), F.lit(factor - 1)), lambda i: F.pmod(shard + i, F.lit(shards))) if factor > 1 else F.array().cast("array<int>")


def range_shard(key: Column, bounds: list[tuple[str, str]]) -> Column:
    """The first range, both ends included, that holds the key; else the last."""
    out = F.lit(len(bounds) - 1)
    for i, (low, high) in reversed(list(enumerate(bounds))):
        out = F.when(key.between(low, high), i).otherwise(out)
    return out


def even_ranges(shards: int) -> list[tuple[str, str]]:
    """The ranges of 32-digit hexadecimal keys by their first two digits; from the 256th on the bounds wrap."""
    bound = lambda i: f"{i % 256:02x}" + "0" * 30
    return [(bound(i), bound(i + 1)) for i in range(shards)]


def length_shard(key: Column, shards: int) -> Column:
    return F.pmod(F.octet_length(key), F.lit(shards))


def poly31(text: Column) -> Column:
    """The 31-polynomial hash of the code units of ASCII text, as an unsigned 32-bit number."""
    codes = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.ascii(F.substring(text, i, F.lit(1))).cast("bigint"))
    return F.when(F.length(text) > 0, F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, c: (h * 31 + c).bitwiseAND(0xFFFFFFFF))).otherwise(F.lit(0).cast("bigint"))


def ring(nodes: DataFrame, vnodes: int = 160) -> DataFrame:
    """point and node of a consistent-hash ring."""
    return nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))).alias("v")).select("node", fnv1a_low(F.concat_ws("#", "node", F.col("v").cast("string"))).alias("point"))


def on_ring(keys: DataFrame, points: DataFrame, key: str = "key") -> DataFrame:
    """The node of each key: that of the next point on the ring, or of the first one after the last.

    The ring (a few hundred points for a node) becomes one sorted array, which each row searches without a join.
    """
    table = points.agg(F.sort_array(F.collect_list(F.struct("point", "node"))).alias("ring"))
    both = keys.withColumn("__h", fnv1a_low(F.col(key))).crossJoin(F.broadcast(table))
    first = F.try_element_at(F.filter("ring", lambda p: p["point"] >= F.col("__h")), F.lit(1))
    return both.withColumn("node", F.coalesce(first["node"], F.element_at("ring", 1)["node"])).drop("__h", "ring")


def merge_results(shards: DataFrame, k: int, id_col: str = "doc_id") -> DataFrame:
    """The k best documents of the shards' results (shard, id, score): each with its best score and the first shard that
    returned it."""
    return shards.groupBy(id_col).agg(F.max("score").alias("score"), F.min("shard").alias("shard")).orderBy(F.col("score").desc(), id_col).limit(k)


def assignment(shards: DataFrame, nodes: int, factor: int) -> DataFrame:
    """shard, node and role: the primary is shard modulo nodes, replicas follow it."""
    i = F.explode(F.sequence(F.lit(0), F.lit(factor - 1))).alias("i")
    rows = shards.select("shard", i).select("shard", "i", F.pmod(F.col("shard") + F.col("i"), F.lit(nodes)).alias("node"))
    return rows.filter((F.col("i") == 0) | (F.col("node") != F.pmod("shard", F.lit(nodes)))).groupBy("shard", "node").agg(F.min(F.when(F.col("i") == 0, "primary").otherwise("replica")).alias("role"))


def distribution(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("node").agg(F.count("*").alias("shards"), F.count_if(F.col("role") == "primary").alias("primaries"))


def rebalance(primaries: DataFrame, removed: int, left: list[int]) -> DataFrame:
    """Shards (shard, node) after a node has gone: its shards go to the left nodes in turn."""
    new = F.element_at(F.array(*map(F.lit, left)), F.pmod("shard", F.lit(len(left))).cast("int") + 1)
    return primaries.withColumn("node", F.when(F.col("node") == removed, new).otherwise(F.col("node")))


def quorum(beats: DataFrame, now: int, timeout: int) -> DataFrame:
    """Of each cluster (cluster, node, last_beat): nodes, healthy ones, and whether they, with this node, are over half."""
    fresh = (F.lit(now) - F.col("last_beat")) < timeout
    out = beats.groupBy("cluster").agg(F.count("*").alias("nodes"), F.count_if(fresh).alias("healthy"))
    return out.withColumn("has_quorum", (F.col("healthy") + 1) * 2 > F.col("nodes") + 1)


def consistency(status: DataFrame, level: str) -> DataFrame:
    """Whether a query (query, shard, ok) succeeds: eventual with any shard, quorum with two or more, strong with all."""
    good = {"eventual": F.count_if("ok") >= 1, "quorum": F.count_if("ok") >= 2, "strong": F.count_if(~F.col("ok")) == 0}[level]
    return status.groupBy("query").agg(good.alias("succeeds"))


def catch_up(replicas_: DataFrame, snapshot_index: int, leader_index: int, batch: int) -> DataFrame:
    """State and next batch of each replica (replica, index)."""
    state = F.when(F.col("index") < snapshot_index, "needs_snapshot").when(F.col("index") >= leader_index, "in_sync").otherwise("catching_up")
    return replicas_.select("replica", "index", state.alias("state"), F.least(F.greatest(F.lit(leader_index) - F.col("index"), F.lit(0)), F.lit(batch)).alias("next_batch"))


# --- tenants --------------------------------------------------------------------------------------------------------
def scoped(tenant: Column, collection: Column) -> Column:
    return F.concat_ws(":", tenant, collection)


def admission(requests: DataFrame, limit: Column | int) -> DataFrame:
    """accepted, rejected and used of each tenant after its requests (tenant, seq, delta) in order: a request over the
    limit adds nothing, and use does not go below 0. Each decision depends on those before it, so a tenant is one ordered
    stream of rows; nothing is collected."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

    rows = requests.select("tenant", "seq", F.col("delta").cast("long"), (F.lit(limit) if isinstance(limit, int) else limit).cast("long").alias("limit"))
    dealt = rows.repartition("tenant").sortWithinPartitions("tenant", "seq")

    def fold(batches):
        own, n, used = None, [0, 0], 0
        done = lambda: pa.RecordBatch.from_pylist([{"tenant": own, "accepted": n[0], "rejected": n[1], "used": used}], schema)
        for batch in batches:
            for tenant, delta, most in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if tenant != own:
                    if n != [0, 0]:
                        yield done()
                    own, n, used = tenant, [0, 0], 0
                if used + delta > most:
                    n[1] += 1
                else:
                    n[0] += 1
                    used = max(0, used + delta)
        if n != [0, 0]:
            yield done()

    schema = pa.schema([to_arrow_schema(rows.schema).field("tenant"), ("accepted", pa.int64()), ("rejected", pa.int64()), ("used", pa.int64())])
    return dealt.mapInArrow(fold, from_arrow_schema(schema))


#: The operations that a tenant may ask for.
OPERATIONS = ("insert", "update", "delete", "search")


def validated(requests: DataFrame, tenants: DataFrame, collections: DataFrame) -> DataFrame:
    """``requests`` (tenant, collection, op, ...) with error: unknown tenant, unknown collection (of that tenant) or unknown
    operation, the first that holds, or null. ``tenants`` has tenant, ``collections`` tenant and collection."""
    known = requests.join(tenants.select("tenant").distinct().withColumn("__t", F.lit(True)), "tenant", "left")
    known = known.join(collections.select("tenant", "collection").distinct().withColumn("__c", F.lit(True)), ["tenant", "collection"], "left")
    error = F.when(F.col("__t").isNull(), "unknown tenant").when(F.col("__c").isNull(), "unknown collection").when(~F.coalesce(F.col("op").isin(*OPERATIONS), F.lit(False)), "unknown operation")
    return known.select(*requests.columns, error.alias("error"))


#: Requests a second, bytes, vectors of a collection and collections that a tier allows; none: no limit.
TIERS = {"free": (100, 1 << 30, 1_000_000, 10), "pro": (1_000, 100 << 30, 100_000_000, 100), "enterprise": (None, None, None, None)}


def tier_use(usage: DataFrame) -> DataFrame:
    """``usage`` (tenant, tier, qps, bytes, vectors, collections, ...) with within, whether all are at most what the tier allows
    (an unknown tier allows nothing), and remaining, the percentage of its bytes that is left, in whole numbers from 0."""
    names = ("qps", "bytes", "vectors", "collections")
    limit = lambda i: F.coalesce(*[F.when(F.col("tier") == t, F.lit(float("inf") if v[i] is None else float(v[i]))) for t, v in TIERS.items()], F.lit(0.0))
    within = F.lit(True)
    for i, name in enumerate(names):
        within = within & (F.col(name) <= limit(i))
    used = F.floor(F.col("bytes") * 100.0 / limit(1))
    left = F.when(limit(1) == 0, F.lit(0)).otherwise(F.greatest(F.lit(100) - used, F.lit(0)))
    return usage.withColumns({"within": within, "remaining": left.cast("long")})


def replica_quorum(in_sync: Column, replicas_: Column) -> Column:
    """Whether the replicas in sync, with the leader, are a majority of all."""
    return in_sync + 1 >= F.floor((replicas_ + 2) / 2)


def newest(audit: DataFrame, n: int, by: str, seq: str) -> DataFrame:
    """The n newest entries of each tenant."""
    return audit.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(F.col(seq).desc()))).filter(F.col("__r") <= n).drop("__r")


def write_by_shard(rows: DataFrame, shard: Column, path: str) -> None:
    """One folder for each shard; a point query then reads one (partition pruning)."""
    rows.withColumn("shard", shard).repartition("shard").write.mode("append").partitionBy("shard").parquet(path)


def shards_of(kind: str, shard: int, shards: int, factor: int, strong: bool = False) -> list[int]:
    """The shards that a query goes to: a point query to one, with its replicas if reads are strong; others to all."""
    if kind != "point":
        return list(range(shards))
    return [(shard + i) % shards for i in range(factor if strong else 1)]
