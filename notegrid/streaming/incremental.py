"""Structured Streaming: files and changes that arrive while the vault is in use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from notegrid.operators.state import upsert


def read_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1_000) -> DataFrame:
    """New parquet files of a folder; the checkpoint of the query remembers what was read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def upsert_stream(changes: DataFrame, load: Callable[[], DataFrame], store: Callable[[DataFrame, int], None], keys: list[str], checkpoint: str) -> StreamingQuery:
    """Each batch of changes (with seq) written over the table by key, then done.
    store gets the whole new table and the batch's number, so that a repeated batch
    can overwrite its own version."""

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store(upsert(load(), batch, keys), number)

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, n, total) of tumbling windows; works on a table and on a stream."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    out = source.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, session_start, n) of bursts of a user's events without a longer gap."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    out = source.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("session_start"), "n")
