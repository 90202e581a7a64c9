"""Tables, key-value stores, change feeds and snapshots on a shared file system."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


class KeyValueStore:
    """Keys and values in Parquet; lookups and prefix scans push down to it. The last write of a key counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, rows: DataFrame, seq: int) -> None:
        rows.select("key", "value", F.lit(seq).cast("long").alias("seq")).write.mode("append").parquet(self.path)

    def delete(self, keys: DataFrame, seq: int) -> None:
        self.put(keys.select("key", F.lit(None).cast("string").alias("value")), seq)

    def _now(self, where) -> DataFrame:
        rows = self.spark.read.parquet(self.path).filter(where)
        return rows.groupBy("key").agg(F.max_by(F.struct("value"), "seq").alias("v")).select("key", "v.value").filter("value is not null")

    def contains(self, keys: DataFrame) -> DataFrame:
        """key and found of each different key."""
        here = self._now(F.lit(True)).select("key", F.lit(True).alias("__here"))
        return keys.select("key").distinct().join(here, "key", "left").select("key", F.col("__here").isNotNull().alias("found"))

    def get(self, *keys: str) -> DataFrame:
        return self._now(F.col("key").isin(*keys))

    def scan(self, prefix: str = "") -> DataFrame:
        return self._now(F.col("key").startswith(prefix))


class ChangeFeed:
    """An append-only log of operations (seq, op, id, ...) as JSON or Parquet files."""

    def __init__(self, spark: SparkSession, path: str, schema: str, kind: str = "json"):
        self.spark, self.path, self.schema, self.kind = spark, path, schema, kind

    def append(self, ops: DataFrame) -> None:
        ops.write.mode("append").format(self.kind).save(self.path)

    def clear(self) -> None:
        """An empty log. What was appended is on disk when ``append`` returns, so there is nothing else to sync."""
        self.spark.createDataFrame([], self.schema).write.mode("overwrite").format(self.kind).save(self.path)

    def read(self, after: int = -1) -> DataFrame:
        return self.spark.read.schema(self.schema).format(self.kind).load(self.path).filter(F.col("seq") > after)

    def stream(self, files_per_batch: int = 100) -> DataFrame:
        return self.spark.readStream.schema(self.schema).format(self.kind).option("maxFilesPerTrigger", files_per_batch).load(self.path)


class Snapshots:
    """Bases and deltas of a collection, one folder each; a restore reads the base and the deltas up to a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write_base(self, rows: DataFrame, ts: int) -> None:
        rows.write.mode("errorifexists").parquet(f"{self.path}/base_ts={ts}")

    def write_delta(self, changes: DataFrame, base_ts: int, ts: int) -> None:
        changes.withColumn("delta_ts", F.lit(ts).cast("long")).write.mode("errorifexists").parquet(f"{self.path}/deltas_of={base_ts}/ts={ts}")

    def restore(self, base_ts: int, deltas: list[int], id_col: str = "vec_id") -> DataFrame:
        from ..operators.collection import restore

        base = self.spark.read.parquet(f"{self.path}/base_ts={base_ts}")
        if not deltas:
            return base
        return restore(base, self.spark.read.parquet(*[f"{self.path}/deltas_of={base_ts}/ts={ts}" for ts in deltas]), id_col)


class GraphSnapshots:
    """Versions of an edge table, one folder each. A version counts once its writer has committed it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _folder(self, version: int | None = None):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path if version is None else f"{self.path}/version={version}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def save(self, edges: DataFrame, version: int) -> None:
        edges.write.mode("errorifexists").parquet(f"{self.path}/version={version}")

    def list(self) -> list[int]:
        """The committed versions, oldest first."""
        files, at = self._folder()
        names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
        return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version=") and files.exists(at.suffix(f"/{n}/_SUCCESS")))

    def load(self, version: int | None = None) -> DataFrame:
        """The edges of a version, or of the newest."""
        from ..operators.collection import EngineError

        there = self.list()
        if not there or version not in (None, *there):
            raise EngineError(EngineError.NOT_FOUND, f"no snapshot {version}")
        return self.spark.read.parquet(f"{self.path}/version={there[-1] if version is None else version}")

    def cleanup(self, keep: int) -> list[int]:
        """Removes all but the ``keep`` newest versions, and returns those removed."""
        gone = self.list()[: -keep or None]
        for version in gone:
            files, at = self._folder(version)
            files.delete(at, True)
        return gone
