"""What the operators share: tables, intermediate tables, and columns from batches of rows in Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.scratch import drop_stored, stored  # noqa: F401

#: Words, as every contract of this package has them: runs of anything but a space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key is hot if it has more than one in so many of the rows; there can't be more hot keys than that.
HOT_SHARE = 10_000


def join_once(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The inner join of ``left`` with a ``right`` that has each key once, where a key may have most rows of ``left``.

    Keys are counted first. Rows with a hot key, of which there are fewer than ``HOT_SHARE``, are joined where they are; only
    the others are shuffled. ``left`` is read three times, so it should be a table. Null keys join nothing.
    """
    total = left.count()
    hot = left.groupBy(key).count().filter(F.col("count") * HOT_SHARE > total).select(key)
    names = [*left.columns, *[c for c in right.columns if c != key]]
    joined = left.join(F.broadcast(right.join(F.broadcast(hot), key, "left_semi")), key).select(*names)
    return joined.union(left.join(F.broadcast(hot), key, "left_anti").join(right, key).select(*names))


def with_columns(
    df: DataFrame,
    inputs: list[str],
    fields: str,
    make: Callable[..., dict[str, object]],
    drop: tuple[str, ...] = (),
    slice_rows: int = 256,
) -> DataFrame:
    """``df`` with the columns of ``fields`` (a schema string) from ``make``, which gets the Arrow arrays of ``inputs``
    for at most ``slice_rows`` rows at a time. Rows stay in their partitions and order.

    A column of ``df`` that has a new column's name gives way to it, as in ``withColumn``.
    """
    new = StructType.fromDDL(fields)
    kept = [f for f in df.schema if f.name not in {*drop, *new.names}]
    plan = df.select(*[F.col(f"`{f.name}`") for f in kept], *[F.col(f"`{c}`").alias(f"__in_{i}") for i, c in enumerate(inputs)])
    schema = StructType([*kept, *new])
    target, n = to_arrow_schema(schema), len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                part = batch.slice(at, slice_rows)
                out = make(*part.columns[n:])
                made = [out[f.name] for f in new]
                yield pa.RecordBatch.from_arrays(
                    [c if c.type == f.type else c.cast(f.type) for c, f in zip(part.columns[:n], target, strict=False)]
                    + [v if isinstance(v, pa.Array) and v.type == f.type else pa.array(v, type=f.type) for v, f in zip(made, list(target)[n:], strict=True)],
                    schema=target,
                )

    return plan.mapInArrow(run, schema)
