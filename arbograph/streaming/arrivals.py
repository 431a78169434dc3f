"""Arriving turns and documents, as Structured Streaming.

An extension of the library's batch operators: rows that come late or twice
are handled by watermarks, and each micro-batch is appended to a table of the
graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arbograph.graph import conform


def first_arrivals(stream: DataFrame, key: list[str], time: str, lateness: str = "1 hour") -> DataFrame:
    """The first row of each key; keys are remembered for as long as rows may be late."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(key)


def turns_by_window(turns: DataFrame, width: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """Turns and sessions by window of time."""
    return (
        turns.withWatermark("created_at", lateness)
        .groupBy(F.window("created_at", width).alias("w"))
        .agg(F.count("*").alias("n_turns"), F.approx_count_distinct("session_id").alias("n_sessions"))
        .select(F.col("w.start").alias("start"), "n_turns", "n_sessions")
    )


def append_to(stream: DataFrame, table: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch to a graph's stored table, once: a batch that is run again overwrites its own part."""

    def write(batch: DataFrame, number: int) -> None:
        conform(batch, table).write.mode("overwrite").parquet(f"{folder}/{table}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
