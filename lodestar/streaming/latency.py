"""Latency per system and event-time window, from a growing folder of log files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.latency import SCHEMA
from .board import Steps


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(path).withColumn("logged_at", F.timestamp_seconds("logged_at"))


def windowed(log: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Works on a stream (rows later than ``late`` are dropped, windows close) and on a table alike."""
    w = F.window("logged_at", window)
    return log.withWatermark("logged_at", late).groupBy(w, "model_id").agg(F.count("*").alias("n"), F.sum("duration").alias("total")).select(
        F.col("window.start").alias("start"), "model_id", "n", F.round("total", 4).alias("total"),
    )


def append_windows(windows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a stream that appends each window of ``windowed`` to Parquet files when the watermark passes its end, once and for
    good; rows that come after that are dropped."""
    out = windows.writeStream.format("parquet").outputMode("append").option("path", path)
    return out.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def replace_windows(windows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a stream that writes all windows so far after each batch, in the place of those before (see ``board.Steps``);
    the state keeps every window."""

    def batch(rows: DataFrame, number: int) -> None:
        steps = Steps(rows.sparkSession, path)
        steps.write(number, rows)
        steps.forget(number - 1)

    out = windows.writeStream.foreachBatch(batch).outputMode("complete")
    return out.option("checkpointLocation", checkpoint).trigger(**trigger).start()
