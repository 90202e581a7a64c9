"""Continuous ingestion with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums of values by window and type, with a watermark: for streams and tables alike."""
    ts = F.col("ts").cast("timestamp")
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    rows = events.withColumn("ts", ts).withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: events no more than the gap apart."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = rows.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def joined(left: DataFrame, right: DataFrame, key: str, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``key``, a and b (ids), ts of the events of ``right`` (key, id, ts) that follow one of ``left`` by at most ``within``. Watermarks
    and the range of times bound the state of a stream; tables join alike."""
    a = left.select(F.col(key), F.col("id").alias("a"), F.col("ts").cast("timestamp").alias("ta")).withWatermark("ta", late)
    b = right.select(F.col(key).alias("__key"), F.col("id").alias("b"), F.col("ts").cast("timestamp").alias("tb")).withWatermark("tb", late)
    near = (F.col(key) == F.col("__key")) & (F.col("tb") >= F.col("ta")) & (F.col("tb") <= F.col("ta") + F.expr(f"interval {within}"))
    return a.join(b, near).select(key, "a", "b", F.col("tb").alias("ts"))


def unique_ops(ops: DataFrame, key: str = "op_key", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Drops operations that repeat within the watermark: bounded state."""
    return ops.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def ingest(stream: DataFrame, table_path: str, checkpoint: str, id_col: str = "id", seq: str = "seq"):
    """Writes each micro-batch's latest row of each id; readers take the latest of all batches with ``latest``. A batch
    that is run again overwrites its own folder, so its rows are there once."""
    from ..operators.collection import latest

    def write(batch: DataFrame, number: int) -> None:
        latest(batch, id_col, seq).write.mode("overwrite").parquet(f"{table_path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_available(df: DataFrame, checkpoint: str, out_path: str):
    """Runs a streaming DataFrame over what is there, into Parquet, and waits."""
    query = df.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def rate_limited(requests: DataFrame, rate: float, burst: float) -> DataFrame:
    """client, allowed and denied of each micro-batch's requests (client, ts): a token bucket for each client, which fills
    with ``rate`` tokens a second up to ``burst``. The state of a client is two numbers."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def decide(key, batches, state: GroupState):
        tokens, last = state.get if state.exists else (burst, None)
        n = [0, 0]
        for ts in sorted(x for b in batches for x in b["ts"].astype("datetime64[ns]").astype("int64").tolist()):
            tokens = min(burst, tokens + (max(0, ts - last) / 1e9 * rate if last is not None else 0))
            last = ts if last is None else max(last, ts)
            ok = tokens >= 1
            tokens -= ok
            n[not ok] += 1
        state.update((tokens, last))
        yield pd.DataFrame({"client": [key[0]], "allowed": [n[0]], "denied": [n[1]]})

    return requests.groupBy("client").applyInPandasWithState(decide, "client long, allowed long, denied long", "tokens double, last long", "update", GroupStateTimeout.NoTimeout)
