"""Streaming forms of delivery dedup and event windows; all take batch DataFrames too.

Times must be TIMESTAMP for watermarks; ``instant`` casts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def instant(df: DataFrame, time: str) -> DataFrame:
    return df.withColumn(time, F.col(time).cast("timestamp"))


def deliveries_once(df: DataFrame, key: str, time: str, delay: str = "1 day") -> DataFrame:
    """First delivery of each key; state is kept for ``delay`` only.

    Payloads are not compared; ``stateful.deliveries`` reports those that differ.
    """
    if not df.isStreaming:
        return df.dropDuplicates([key])
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def sessions(df: DataFrame, key: str, time: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """(key, started_at, ended_at, events): runs of a key's events with pauses below the gap."""
    rows = df.withWatermark(time, delay) if df.isStreaming else df
    found = rows.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("events"), F.max(time).alias("ended_at"))
    return found.select(key, F.col("w.start").alias("started_at"), "ended_at", "events")


def tumbling(df: DataFrame, time: str, width: str = "1 day", delay: str = "1 hour", by: list[str] | None = None) -> DataFrame:
    """(by, window_start, events) in windows of fixed width."""
    rows = df.withWatermark(time, delay) if df.isStreaming else df
    found = rows.groupBy(*(by or []), F.window(time, width).alias("w")).agg(F.count("*").alias("events"))
    return found.select(*(by or []), F.col("w.start").alias("window_start"), "events")


def write_once(stream: DataFrame, path: str, checkpoint: str, key: str | None = None):
    """Starts a query whose micro-batches are each written whole to ``path/batch=<id>``, over what a failed try left there.

    A batch that runs again after a failure replaces its own folder, so every row is in the table once. With ``key``,
    repeats inside a batch are dropped; ``deliveries_once`` drops those across batches.
    """

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates([key]) if key else batch
        rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
