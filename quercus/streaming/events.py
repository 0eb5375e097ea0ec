"""Streaming wrappers: windowed counts and per-batch import (an extension: the reference is batch only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def per_minute(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events by user and minute; works on batch and streaming input alike, the latter with a watermark."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", "1 minute").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("minute"), "user_id", "n")


def import_batches(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, trigger: str = "1 minute") -> StreamingQuery:
    """Each micro-batch of new records goes through the batch import; the checkpoint makes a batch's number safe to repeat."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()
