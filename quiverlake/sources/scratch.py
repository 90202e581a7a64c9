"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_FOLDER: str | None = None
_LEFT: list = []  # what to remove when this process ends


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``, or the folder that ``setCheckpointDir`` was given. Where both are unset, in
    local mode (as in tests), a folder of this process, which is also made the checkpoint folder and goes when the process
    ends; on a cluster that is an error, as its executors would write to their own disks."""
    global _OWN_FOLDER
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _OWN_FOLDER is None:
        _OWN_FOLDER = tempfile.mkdtemp(prefix="quiverlake-")
        atexit.register(shutil.rmtree, _OWN_FOLDER, True)
    context.setCheckpointDir(f"file://{_OWN_FOLDER}")
    return f"file://{_OWN_FOLDER}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is there goes when this process ends."""
    path = f"{shared_folder(spark)}/quiverlake/{name}-{uuid.uuid4().hex}"
    _LEFT.append(_remover(spark, path))
    return path


def stored(df: DataFrame, name: str = "table", partition_by: str | None = None, **options: str) -> DataFrame:
    """``df`` written as a table in the shared folder, and read again; ``options`` are the Parquet writer's.

    This cuts the lineage: a lost executor costs at most a read of that table. Spark's committer makes sure that
    a task which runs twice leaves its rows once. The table goes when this process ends.
    """
    path = scratch_path(df.sparkSession, name)
    (df.write.partitionBy(partition_by) if partition_by else df.write).options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remover(spark: SparkSession, path: str):
    """Removes a folder through Hadoop, so in any store, also after the session has stopped."""
    conf, at = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return lambda: at.getFileSystem(conf).delete(at, True)


@atexit.register
def _clean() -> None:
    while _LEFT:
        with contextlib.suppress(Exception):  # the JVM may have gone before
            _LEFT.pop()()


def drop_stored(df: DataFrame) -> None:
    """Remove the files that ``df``, which comes from :func:`stored`, reads. For tables that no later plan needs."""
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        _remover(df.sparkSession, folder)()
