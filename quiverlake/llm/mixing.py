"""Mixing sources to target weights: whole copies at each source's repetition rate.

A source's rate is its target over its size. A document is taken floor(rate) times, and once more with the rate's
fraction as probability, decided by a hash of the seed and its id: reruns agree, and no document waits for another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import WORD, stored

#: Weights of the sources in order of their names, repeating; a target's cap in sizes of its source.
WEIGHTS, CAP, SEED = (5, 2, 1), 3, 7
#: Up to so many sources (each a name and two numbers), their rates are broadcast.
BROADCAST_SOURCES = 10_000


def words(text: str = "text") -> Column:
    """Words of a text; none for null."""
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size and target of each source, from rows with ``source`` and ``size``.

    Targets are proportional to the weights and sum to the whole size, but stop at ``CAP`` times their source's size;
    what is over is shared again by weight until none is above. That is a water level: with sources in order of cap
    over weight, those before the first that a level leaves below its cap are full, and the level shares the rest.
    A null source is a source, the last. With no words at all every target is 0.
    """
    own = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    own = own.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((n - 1) % len(WEIGHTS)) + 1).cast("long"))
    own = own.withColumn("cap", CAP * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    own = own.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    own = own.withColumn("shares", F.sum("weight").over(after))
    # The first source that this level leaves at or below its cap fixes the level; it is the largest of such levels.
    fits = F.col("left") * F.col("weight") <= F.col("cap") * F.col("shares")
    level = F.first(F.when(fits, F.struct("left", "shares")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    own = own.withColumn("level", level)
    share = F.col("level.left") * F.col("weight") / F.col("level.shares")
    return own.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(share, F.lit(0.0))).alias("target"))


def chance(doc_id: str = "doc_id", seed: int = SEED) -> Column:
    """A number from 0 up to 1 that a document's id and the seed fix: the first 52 bits of an md5."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def with_copies(df: DataFrame, rates: DataFrame, doc_id: str = "doc_id", source: str = "source", seed: int = SEED, name: str = "mix") -> DataFrame:
    """Adds ``name``, a struct of source_size, target and copies; ``rates`` is what targets() returns.

    The rates are counted first, and broadcast only if they are few; otherwise they are joined by a shuffle, where
    adaptive execution splits the partitions of large sources. A null source is a source; rows may repeat; an empty table
    stays empty; a column of that name gives way.
    """
    rates = stored(rates, "rates").select(F.struct("source", "source_size", "target").alias("__rate"))
    few = rates.count() <= BROADCAST_SOURCES
    joined = df.join(F.broadcast(rates) if few else rates, F.col(f"`{source}`").eqNullSafe(F.col("__rate.source")))
    rate = F.when(F.col("__rate.source_size") > 0, F.col("__rate.target") / F.col("__rate.source_size")).otherwise(0.0)
    copies = F.floor(rate) + (chance(doc_id, seed) < rate - F.floor(rate)).cast("long")
    return joined.withColumn(name, F.struct("__rate.source_size", "__rate.target", copies.cast("long").alias("copies"))).drop("__rate")


def sized(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    return df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), words(text).alias("size"))


def plan(df: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (words that the mix takes) of each row of ``df``.

    Null texts have size 0. Rows with the same id get the same number of copies. An empty table gives no row.
    """
    rows = stored(sized(df), "sizes")
    return with_copies(rows, targets(rows), seed=seed).select("doc_id", "source", "size", "mix.*", (F.col("size") * F.col("mix.copies")).alias("taken"))


def mix(df: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it, with all columns, whatever their names. Null texts have size 0, a
    null source is a source, repeated rows are taken alike, an empty table stays empty. Sizes are one pass over the texts; the
    second pass joins the rates where the rows are, without a shuffle of texts (if there are few sources), and repeats them."""
    out = with_copies(df, targets(sized(df)), seed=seed, name="__mix").filter("__mix.copies > 0")
    again = F.sequence(F.lit(1).cast("long"), F.col("__mix.copies"))
    return out.withColumn("__mix", F.explode(again)).drop("__mix")
