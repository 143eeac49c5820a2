"""Aggregate states over streams: batches are aggregated as they come and their states merge into a running table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from basaltine.operators.aggregate import merge_states, state


def running_states(stream: DataFrame, key: str, value: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Writes the states of each micro-batch to its own folder; a batch that is run again replaces its own states."""

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy(key).agg(*state(value)).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, folder: str, key: str) -> DataFrame:
    """The states of all batches so far, merged."""
    return merge_states(spark.read.parquet(folder), key)


def windowed(stream: DataFrame, time: str, key: str, value: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """States per key and time window, for streams with late rows (beyond the inventory)."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(window, key).agg(*state(value))


def sessions(stream: DataFrame, time: str, key: str, value: str, gap: str, late: str) -> DataFrame:
    """States per key and session (beyond the inventory)."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(*state(value))
