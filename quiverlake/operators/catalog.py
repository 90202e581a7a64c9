"""Collections by name and tenant, their schemas, and the plans of metric migrations."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .collection import Collection, EngineError


# --- ingest ---------------------------------------------------------------------------------------------------------
def with_ids(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows without an id get one of their own: a hash of the row, and its place in the table that this writes, which keeps
    equal rows apart. The ids stay as they are however often the result is read."""
    rest = [c for c in rows.columns if c != id_col]
    made = F.concat(F.lit("vec_"), F.substring(F.sha2(F.to_json(F.struct(*rest)), 256), 1, 16), F.lit("_"), F.monotonically_increasing_id().cast("string"))
    return stored(rows.withColumn(id_col, F.coalesce(F.col(id_col), made)), "ids")


def as_text(value: object) -> str:
    """A metadata value as it is stored: text as it is, everything else as JSON."""
    return value if isinstance(value, str) else json.dumps(value, separators=(",", ":"))


def metadata_text(variant_json: Column) -> Column:
    """The same for a column of JSON objects: a map of texts; null becomes the text null."""
    parsed = F.from_json(variant_json, "map<string,string>")
    return F.transform_values(parsed, lambda _, v: F.coalesce(v, F.lit("null")))


def infer_dimension(rows: DataFrame, vector: str = "embedding", order: str = "vec_id") -> int:
    """The length of the first vector."""
    first = rows.orderBy(order).select(F.size(vector).alias("n")).first()
    if first is None:
        raise EngineError(EngineError.INVALID, "no vector to infer a dimension from")
    return first.n


# --- schemas --------------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class VectorField:
    kind: str = "dense"
    dim: int | None = None
    compression: str | None = None

    def check(self, name: str) -> None:
        if not re.fullmatch(r"[A-Za-z0-9_]{1,128}", name):
            raise EngineError(EngineError.INVALID, f"no name for a vector: {name!r}")
        if self.kind not in ("dense", "sparse", "text") or self.compression not in (None, "pq8", "pq4"):
            raise EngineError(EngineError.INVALID, f"{name}: {self.kind}, {self.compression}")
        if self.kind == "dense" and (self.dim or 0) < 1:
            raise EngineError(EngineError.DIMENSION, f"{name} needs a dimension")


@dataclass(frozen=True)
class Schema:
    vectors: dict[str, VectorField]
    metadata: dict[str, str] = field(default_factory=dict)
    version: int = 1

    def check(self) -> Schema:
        if not self.vectors:
            raise EngineError(EngineError.INVALID, "a collection has a vector")
        for name, v in self.vectors.items():
            v.check(name)
        if bad := [k for k, t in self.metadata.items() if t not in ("string", "number", "boolean", "json")]:
            raise EngineError(EngineError.INVALID, f"types of {bad}")
        return self


# --- catalog --------------------------------------------------------------------------------------------------------
@dataclass
class Catalog:
    """Collections of tenants. Names are scoped in every call, so a tenant only sees its own."""

    spark: SparkSession
    collections: dict[str, Collection] = field(default_factory=dict)

    @staticmethod
    def scope(tenant: str, name: str) -> str:
        return f"{tenant}:{name}"

    def create(self, tenant: str, name: str, rows: DataFrame, dim: int, metric: str = "l2", policy: str = "overwrite") -> Collection:
        key = self.scope(tenant, name)
        if key in self.collections:
            raise EngineError(EngineError.EXISTS, name)
        self.collections[key] = Collection(name, dim, rows, metric, policy)
        return self.collections[key]

    def get(self, tenant: str, name: str) -> Collection:
        key = self.scope(tenant, name)
        if key not in self.collections:
            raise EngineError(EngineError.MISSING, name)
        return self.collections[key]

    def list(self, tenant: str) -> list[str]:
        return sorted(k.partition(":")[2] for k in self.collections if k.startswith(f"{tenant}:"))

    def drop(self, tenant: str, name: str) -> None:
        self.get(tenant, name)
        del self.collections[self.scope(tenant, name)]

    def add(self, tenant: str, name: str, rows: DataFrame) -> Collection:
        """Adds rows, to a new collection of the first vector's dimension if there is none."""
        try:
            return self.get(tenant, name).add(rows)
        except EngineError as e:
            if e.code != EngineError.MISSING:
                raise
        dim = infer_dimension(rows)
        return self.create(tenant, name, rows.limit(0), dim).add(rows)


# --- metric migrations ----------------------------------------------------------------------------------------------
@dataclass
class Migration:
    """From pending to running, and to completed or failed; only a completed one can be rolled back."""

    source: str
    target: str
    total: int
    batch: int = 10_000
    done: int = 0
    state: str = "pending"
    history: list[str] = field(default_factory=list)

    def _to(self, state: str, *allowed: str) -> Migration:
        if self.state not in allowed:
            raise EngineError(EngineError.INVALID, f"{state} after {self.state}")
        self.history.append(self.state)
        self.state = state
        return self

    def advance(self) -> Migration:
        """One batch; the last one completes the migration."""
        if self.state == "pending":
            self._to("running", "pending")
        if self.state != "running":
            raise EngineError(EngineError.INVALID, f"no batch after {self.state}")
        self.done = min(self.total, self.done + self.batch)
        return self._to("completed", "running") if self.done == self.total else self

    def fail(self) -> Migration:
        return self._to("failed", "pending", "running")

    def roll_back(self) -> Migration:
        self._to("rolled_back", "completed")
        self.source, self.target, self.done = self.target, self.source, 0
        return self

    @property
    def percent(self) -> float:
        return 100.0 * self.done / self.total if self.total else 100.0


# --- recovery -------------------------------------------------------------------------------------------------------
def recovery_plan(snapshots: DataFrame, feed: DataFrame, crashed: bool = False) -> DataFrame:
    """state (empty, ready, recovering or corrupted), the snapshot to start from and the operations to replay after it.

    ``snapshots`` has ts and valid, ``feed`` has seq, on one scale. After a crash (``crashed``) what has a valid snapshot is
    recovering until that is loaded, also where nothing is to be replayed."""
    best = snapshots.agg(F.max(F.when(F.col("valid"), F.col("ts"))).alias("base"), F.count("*").alias("n"))
    ops = feed.crossJoin(F.broadcast(best)).agg(F.count_if(F.col("seq") > F.coalesce("base", F.lit(-1))).alias("replay"))
    state = F.when((F.col("n") == 0) & (F.col("replay") == 0), "empty").when((F.col("n") > 0) & F.col("base").isNull(), "corrupted").when((F.col("replay") > 0) | F.lit(crashed), "recovering").otherwise("ready")
    return best.crossJoin(ops).select(state.alias("state"), "base", "replay")
