"""Collections: validated upserts, change feeds, tombstones, compaction and snapshots.

A collection is a DataFrame with an id column; operations return the new one. Latest-wins is an aggregation with
``max_by``, which combines before the shuffle and has no hot group: not a window over all versions of an id.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ..functions.vector import is_valid
from ..sources.scratch import stored


class EngineError(Exception):
    """With the code of the error's kind."""

    #: The codes that clients know. NOT_FOUND and DUPLICATE are of rows, MISSING and EXISTS of collections.
    DIMENSION, NOT_FOUND, MISSING, EXISTS, DUPLICATE, SETTING, INVALID = 1001, 1401, 1501, 1502, 1503, 1701, 1702

    def __init__(self, code: int, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def validate(rows: DataFrame, dim: int, vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Rows with a finite vector of the right length, and the others with an ``error`` code."""
    code = F.when(~is_valid(vector), EngineError.INVALID).when(F.size(vector) != dim, EngineError.DIMENSION)
    marked = rows.withColumn("error", code)
    return marked.filter("error is null").drop("error"), marked.filter("error is not null")


def _place(rows: DataFrame, order: str | None) -> Column:
    """What orders the rows of one id: a column, or, so that runs agree, a hash of the row."""
    return F.col(order) if order else F.xxhash64(*[f.name for f in rows.schema if "map<" not in f.dataType.simpleString()])


def latest(rows: DataFrame, id_col: str, order: str | None, first: bool = False) -> DataFrame:
    """The row of each id with the largest ``order`` (the smallest, if ``first``)."""
    others = [c for c in rows.columns if c != id_col]
    best = rows.groupBy(id_col).agg((F.min_by if first else F.max_by)(F.struct(*others), _place(rows, order)).alias("__r"))
    return best.select(id_col, *[F.col(f"__r.{c}").alias(c) for c in others]).select(*rows.columns)


def upsert(table: DataFrame, new: DataFrame, policy: str = "overwrite", id_col: str = "vec_id", order: str | None = None) -> DataFrame:
    """The table with ``new``. For an id in both: overwrite takes the new row, skip keeps the old, reject raises.

    ``new`` may repeat an id: overwrite takes its last row by ``order`` (a column of ``new``; without one, the hash of the
    row decides), skip its first, reject raises. A column named as ``order`` that the table lacks is not added to it.
    """
    if policy not in ("overwrite", "skip", "reject"):
        raise ValueError(f"no policy {policy}")
    fits = lambda df: df.select(*table.columns)
    if policy == "reject":
        if not rejected(table, new, id_col).isEmpty():
            raise EngineError(EngineError.DUPLICATE, "an id exists already, or repeats")
        return table.unionByName(fits(new))
    one = fits(latest(new, id_col, order, first=policy == "skip"))
    if policy == "skip":
        return table.unionByName(one.join(table.select(id_col), id_col, "left_anti"))
    return table.join(one.select(id_col), id_col, "left_anti").unionByName(one)


def rejected(table: DataFrame, new: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """The new rows that the reject policy does not take: those whose id the table has, or another new row."""
    taken = table.select(id_col).union(new.groupBy(id_col).count().filter("count > 1").select(id_col))
    return new.join(taken, id_col, "left_semi")


def delete(table: DataFrame, ids: DataFrame, id_col: str = "vec_id") -> DataFrame:
    return table.join(ids.select(id_col).distinct(), id_col, "left_anti")


def statuses(table: DataFrame, ops: DataFrame, dim: int, policy: str = "overwrite", id_col: str = "vec_id", seq: str = "seq", vector: str = "embedding") -> DataFrame:
    """``ops`` (seq, op insert or delete, id, vector) with error: null, or the code of why the operation does nothing.

    Operations of an id are in order of ``seq``, so a delete sees the inserts before it in the batch, and an insert that
    fails leaves the id as it was. Deletes of an id that is not there, vectors that are none or of another length, and under
    the reject policy inserts of an id that is there, are errors. Other operations are invalid. An id's operations are one
    ordered stream, which spills; nothing is collected.
    """
    bad = F.when(~F.coalesce(F.col("op").isin("insert", "delete"), F.lit(False)) | F.col(id_col).isNull(), EngineError.INVALID)
    bad = F.when(bad.isNotNull(), bad).when((F.col("op") == "insert") & ~is_valid(vector), EngineError.INVALID).when((F.col("op") == "insert") & (F.size(vector) != dim), EngineError.DIMENSION)
    known = table.select(id_col).distinct().withColumn("__there", F.lit(True))
    marked = ops.withColumn("__bad", bad).join(known, id_col, "left")
    # whatever it meets, a sound insert leaves its id there, and a delete leaves it not there
    before = Window.partitionBy(id_col).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("__bad").isNull(), F.col("op") == "insert"), ignorenulls=True).over(before)
    there = F.coalesce(last, F.col("__there"), F.lit(False))
    error = F.when(F.col("__bad").isNotNull(), F.col("__bad")).when((F.col("op") == "delete") & ~there, EngineError.NOT_FOUND)
    if policy == "reject":
        error = error.when((F.col("op") == "insert") & there, EngineError.DUPLICATE)
    return marked.withColumn("error", error).select(*ops.columns, "error")


def patch_metadata(table: DataFrame, patches: DataFrame, id_col: str = "vec_id", column: str = "metadata") -> DataFrame:
    """Merges each patch (id, patch map; one for an id) into the row's map; of a key in both the patch counts."""
    both = table.join(patches.select(id_col, F.col("patch").alias("__p")), id_col, "left")
    old = F.map_filter(F.col(column), lambda k, _: ~F.array_contains(F.map_keys("__p"), k))
    merged = F.when(F.col("__p").isNull(), F.col(column)).otherwise(F.map_concat(F.coalesce(old, F.create_map().cast("map<string,string>")), F.col("__p")))
    return both.withColumn(column, merged).drop("__p").select(*table.columns)


def migrate(rows: DataFrame, fields: dict[str, tuple[str, object, bool]]) -> DataFrame:
    """To a schema of (type, default, required) by name: unknown columns go, missing ones and nulls get the default. A
    required field without column or default is an error."""
    out = []
    for name, (kind, default, required) in fields.items():
        if name not in rows.columns and default is None and required:
            raise EngineError(EngineError.INVALID, f"{name} is required and has no default")
        value = F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)
        out.append(F.coalesce(value, F.lit(default).cast(kind)).alias(name))
    return rows.select(*out)


# --- change feeds ---------------------------------------------------------------------------------------------------
def replay(feed: DataFrame, id_col: str = "id") -> DataFrame:
    """The last write of each id in a feed (seq, op, id, ...). A delete is final: what follows it is ignored."""
    ended = feed.groupBy(id_col).agg(F.min(F.when(F.col("op") == "delete", F.col("seq"))).alias("__end"), F.max(F.when(F.col("op") != "delete", F.col("seq"))).alias("__last"))
    ended = ended.filter("__end is null and __last is not null").select(id_col, F.col("__last").alias("seq"))
    return feed.filter("op != 'delete'").join(ended, [id_col, "seq"])


def replay_counts(feed: DataFrame, id_col: str = "id") -> DataFrame:
    """op and the number of operations that a replay applies: those before an id's first delete, and that delete."""
    end = feed.filter("op = 'delete'").groupBy(id_col).agg(F.min("seq").alias("__end"))
    return feed.join(end, id_col, "left").filter("__end is null or seq <= __end").groupBy("op").agg(F.count("*").alias("applied"))


def dedup_ops(feed: DataFrame, id_col: str = "id") -> DataFrame:
    """The first operation of each key, op and id."""
    key = F.concat_ws("_", "op", F.col(id_col).cast("string"))
    return feed.withColumn("op_key", key).groupBy("op_key").agg(F.min("seq").alias("seq"))


def batch_metrics(feed: DataFrame, batch: int = 1_000) -> DataFrame:
    """Batches of ``batch`` operations in order of arrival: operations, batches, mean size and the percentage of writes that
    batching saves. Gaps between sequence numbers make no batch smaller."""
    batches = F.ceil(F.col("ops") / batch)
    return feed.agg(F.count("*").alias("ops")).select(
        "ops", batches.alias("batches"), (F.col("ops") / batches).alias("avg_batch_size"), ((1 - batches / F.col("ops")) * 100).alias("reduction_ratio")
    )


def flushes(feed: DataFrame, by: str, seq: str = "seq", ts: str = "ts", batch: int = 1_000, seconds: float = 60.0) -> DataFrame:
    """What each writer's buffer flushes: ``by``, batch (from 0), n, first and last (seq), and reason: size, time, or open for
    what is left at the end.

    A buffer flushes when it holds ``batch`` operations, and before an operation that comes ``seconds`` or more after its
    first one. Each decision depends on those before it, so a writer is one ordered stream of rows; nothing is collected.
    """
    schema = to_arrow_schema(StructType([StructField(by, feed.schema[by].dataType), *StructType.fromDDL("batch long, n long, first long, last long, reason string")]))
    rows = feed.select(by, F.col(seq).cast("long"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us")).repartition(by).sortWithinPartitions(by, seq)

    def fold(batches):
        own, k, held = None, 0, []  # held: n, first, last, microseconds of the first
        say = lambda reason: pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((own, k, *held[:3], reason), schema, strict=True)], schema=schema)
        for part in batches:
            for writer, at, us in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if writer != own:
                    if held:
                        yield say("open")
                    own, k, held = writer, 0, []
                if held and us - held[3] >= seconds * 1e6:
                    yield say("time")
                    k, held = k + 1, []
                held = [held[0] + 1, held[1], at, held[3]] if held else [1, at, at, us]
                if held[0] == batch:
                    yield say("size")
                    k, held = k + 1, []
        if held:
            yield say("open")

    return rows.mapInArrow(fold, from_arrow_schema(schema))


# --- compaction -----------------------------------------------------------------------------------------------------
def compact(buffer: DataFrame, tombstones: DataFrame, now_ms: int, ttl_secs: int | None, id_col: str = "id") -> DataFrame:
    """The entries (id, inserted_ms, ...) that are neither expired nor deleted. Ages are whole seconds."""
    age = F.floor((F.lit(now_ms) - F.col("inserted_ms")) / 1000)
    kept = buffer if ttl_secs is None else buffer.filter(age <= ttl_secs)
    return kept.join(tombstones.select(id_col).distinct(), id_col, "left_anti")


def compaction_counts(buffer: DataFrame, tombstones: DataFrame, now_ms: int, ttl_secs: int, id_col: str = "id") -> DataFrame:
    expired = F.floor((F.lit(now_ms) - F.col("inserted_ms")) / 1000) > ttl_secs
    dead = tombstones.select(id_col).distinct().withColumn("__dead", F.lit(True))
    marked = buffer.join(dead, id_col, "left").select(expired.alias("e"), F.coalesce("__dead", F.lit(False)).alias("d"))
    return marked.agg(F.count("*").alias("drained"), F.count_if("e").alias("expired"), F.count_if(~F.col("e") & F.col("d")).alias("tombstoned"), F.count_if(~F.col("e") & ~F.col("d")).alias("emitted"))


#: Why a row may be a tombstone.
REASONS = ("user_delete", "ttl_expired", "update_overwrite")


def bury(rows: DataFrame, reason: str, ts: int | Column, id_col: str = "id") -> DataFrame:
    """Tombstones (id, reason, ts) of rows, one for an id."""
    if reason not in REASONS:
        raise EngineError(EngineError.INVALID, f"no reason {reason}")
    return rows.groupBy(id_col).agg(F.max(F.lit(ts) if isinstance(ts, int) else ts).cast("long").alias("ts")).select(id_col, F.lit(reason).alias("reason"), "ts")


def tombstone_stats(tombstones: DataFrame, cutoff: int) -> DataFrame:
    """Of each reason: tombstones, and those that a cleanup at ``cutoff`` removes."""
    return tombstones.groupBy("reason").agg(F.count("*").alias("total"), F.count_if(F.col("ts") <= cutoff).alias("cleaned"))


def cleanup_tombstones(tombstones: DataFrame, cutoff: int) -> DataFrame:
    return tombstones.filter(F.col("ts") > cutoff)


def needs_compaction(entries: int, limit: int = 50_000) -> bool:
    return entries >= limit


def buffer_batches(rows: DataFrame, order: str, capacity: int = 10_000) -> DataFrame:
    """Adds ``batch``: which filling of a buffer of ``capacity`` a row falls in, by ``order`` and then by a hash of the row.

    The rows are dealt out by ranges once, and written with their place in their range; the ranges' sizes are counted from
    that table (one row for each range), so both mean the same ranges, and there is no global window.
    """
    place = [F.col(order), F.xxhash64(*[f.name for f in rows.schema if "map<" not in f.dataType.simpleString()])]
    ranged = rows.drop("batch").repartitionByRange(*place).sortWithinPartitions(*place).withColumn("__m", F.monotonically_increasing_id())
    ranged = stored(ranged, "ranges").withColumn("__p", F.shiftright("__m", 33))
    counts = ranged.groupBy("__p").agg(F.count("*").alias("__n"))
    before = counts.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(F.broadcast(before), "__p").withColumn("batch", F.floor((F.col("__before") + own) / capacity)).drop("__p", "__m", "__before")


# --- snapshots ------------------------------------------------------------------------------------------------------
def delta_between(old: DataFrame, new: DataFrame, id_col: str = "vec_id", version: str = "version") -> DataFrame:
    """change (inserted, deleted, updated) and id of the rows that differ between two states."""
    a, b = old.select(id_col, F.col(version).alias("__old")), new.select(id_col, F.col(version).alias("__new"))
    change = F.when(F.col("__old").isNull(), "inserted").when(F.col("__new").isNull(), "deleted").when(F.col("__old") != F.col("__new"), "updated")
    return a.join(b, id_col, "full_outer").select(id_col, change.alias("change")).filter("change is not null")


def restore(base: DataFrame, deltas: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """The base with its deltas (delta_ts, op delete or upsert, id and the base's columns) applied in order. Within one
    delta deletes come before upserts, so an id in both stays."""
    cols = [c for c in base.columns if c != id_col]
    feed = base.select(id_col, F.struct(F.lit(-(1 << 62)).alias("ts"), F.lit(1).alias("rank")).alias("at"), F.struct(*cols).alias("v"))
    upserts = F.when(F.col("op") == "upsert", F.struct(*cols))
    feed = feed.union(deltas.select(id_col, F.struct(F.col("delta_ts").cast("long"), F.when(F.col("op") == "delete", 0).otherwise(1)), upserts))
    last = feed.groupBy(id_col).agg(F.max_by(F.struct("v"), "at").alias("w"))
    return last.filter("w.v is not null").select(id_col, *[F.col(f"w.v.{c}").alias(c) for c in cols]).select(*base.columns)


def delta_size(n_vectors: int, n_deletes: int) -> int:
    return 128 * n_vectors + 32 * n_deletes


def retain(snapshots: DataFrame, n: int, by: str = "collection", ts: str = "ts") -> DataFrame:
    """The n newest snapshots of each collection."""
    return snapshots.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(F.col(ts).desc()))).filter(F.col("__r") <= n).drop("__r")


def fallback(snapshots: DataFrame, before: int, by: str = "collection") -> DataFrame:
    """The newest valid snapshot older than ``before`` of each collection."""
    return snapshots.filter((F.col("ts") < before) & F.col("valid")).groupBy(by).agg(F.max("ts").alias("ts"))


def checksum(rows: DataFrame, by: str | None = None) -> DataFrame:
    """n and a checksum (a number in text) that do not depend on the order of rows, of all or of each value of ``by``: the sum
    of the first 60 bits of each row's SHA-256, of its columns as JSON. Rows that repeat count as often."""
    whole = F.to_json(F.struct(*[c for c in rows.columns if c != by]), {"ignoreNullFields": "false"})
    part = F.conv(F.substring(F.sha2(whole, 256), 1, 15), 16, 10).cast("decimal(20,0)")
    group = rows.groupBy(by) if by else rows.groupBy()
    return group.agg(F.count("*").alias("n"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("checksum"))


def verified(rows: DataFrame, manifest: DataFrame, by: str = "ts") -> DataFrame:
    """``by`` and valid of each snapshot of the manifest (``by``, n, checksum): whether its rows are there as they were written."""
    now = checksum(rows, by).select(by, F.col("n").alias("__n"), F.col("checksum").alias("__c"))
    same = (F.coalesce("__n", F.lit(0)) == F.col("n")) & (F.coalesce("__c", F.lit("0")) == F.col("checksum"))
    return manifest.join(now, by, "left").select(by, same.alias("valid"))


# --- a façade -------------------------------------------------------------------------------------------------------
@dataclass
class Collection:
    """A named collection: what a client does, over one DataFrame. Every call leaves the old DataFrame as it was."""

    name: str
    dim: int
    rows: DataFrame
    metric: str = "l2"
    policy: str = "overwrite"
    id_col: str = "vec_id"
    vector: str = "embedding"
    errors: list[DataFrame] = field(default_factory=list)

    def add(self, new: DataFrame) -> Collection:
        good, bad = validate(new, self.dim, self.vector)
        self.errors.append(bad)
        self.rows = upsert(self.rows, good, self.policy, self.id_col)
        return self

    def search(self, query: list[float], k: int = 5, where=None) -> DataFrame:
        from .knn import knn

        if len(query) != self.dim:
            raise EngineError(EngineError.DIMENSION, f"the query has {len(query)} dimensions, the collection {self.dim}")
        return knn(self.rows, query, k, self.metric, self.id_col, self.vector, where.where() if where else None)

    def batch_search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        from .knn import knn_batch

        return knn_batch(self.rows, queries, k, self.metric, self.id_col, self.vector)

    def get(self, *ids) -> DataFrame:
        return self.rows.filter(F.col(self.id_col).isin(*ids))

    def delete(self, *ids) -> Collection:
        self.rows = self.rows.filter(~F.col(self.id_col).isin(*ids))
        return self

    def update(self, new: DataFrame) -> Collection:
        """Rows of ids that are there get the vectors of ``new``; a column that ``new`` lacks becomes null, as a row is written
        anew. An id that is not there is an error."""
        good, bad = validate(new, self.dim, self.vector)
        self.errors.append(bad)
        if not good.join(self.rows.select(self.id_col), self.id_col, "left_anti").isEmpty():
            raise EngineError(EngineError.NOT_FOUND, "an id is not there")
        self.rows = upsert(self.rows, good.select(*[F.col(c) if c in good.columns else F.lit(None).alias(c) for c in self.rows.columns]), "overwrite", self.id_col)
        return self

    def patch(self, patches: DataFrame, column: str = "metadata") -> Collection:
        """Merges metadata, as :func:`patch_metadata`."""
        self.rows = patch_metadata(self.rows, patches, self.id_col, column)
        return self

    def snapshot(self, snapshots, ts: int) -> DataFrame:
        """Writes the rows as a base of ``snapshots`` and returns their count and checksum."""
        snapshots.write_base(self.rows, ts)
        return checksum(self.rows)

    def info(self) -> DataFrame:
        """name, dimension, metric and rows."""
        return self.rows.agg(F.count("*").alias("rows")).select(F.lit(self.name).alias("name"), F.lit(self.dim).alias("dimension"), F.lit(self.metric).alias("metric"), "rows")

    def delete_by_filter(self, where) -> Collection:
        self.rows = self.rows.filter(~where.column())
        return self

    def update_by_filter(self, where, **values) -> Collection:
        for name, value in values.items():
            self.rows = self.rows.withColumn(name, F.when(where.column(), F.lit(value)).otherwise(F.col(name)))
        return self

    def scroll(self, limit: int, offset: int = 0) -> DataFrame:
        return self.rows.orderBy(self.id_col).offset(offset).limit(limit)

    def aggregate(self, column: str) -> DataFrame:
        """count, sum, avg, min and max of a metadata field, of values that are numbers."""
        x = F.col(column).try_cast("double")
        return self.rows.agg(F.count(x).alias("count"), F.sum(x).alias("sum"), F.avg(x).alias("avg"), F.min(x).alias("min"), F.max(x).alias("max"))

    def count(self) -> int:
        return self.rows.count()
