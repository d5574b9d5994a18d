"""Structured Streaming over append-only event tables; each aggregate has a batch twin with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """Events and their value by type and window of ``width``; ``late`` is how long a stream waits for stragglers."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if late and e.isStreaming else e
    w = e.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value"))
    return w.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Events of a user with no longer pause than ``gap`` between them."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if late and e.isStreaming else e
    s = e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "n")


def follow(folder_glob: str, like: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Run ``plan`` over all files of a folder as an available-now stream, appended as Parquet to ``out``."""
    stream = like.sparkSession.readStream.schema(like.schema).parquet(folder_glob)
    q = plan(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    q.awaitTermination()
