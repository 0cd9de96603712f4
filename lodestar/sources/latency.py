"""The latency log: JSON lines of one call each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "model_id string, sentence_cat string, sentence string, duration double, logged_at double"


def append(rows: DataFrame, path: str) -> None:
    rows.select(
        "model_id", "sentence_cat", "sentence", "duration",
        F.coalesce("logged_at", F.unix_timestamp().cast("double")).alias("logged_at"),
    ).write.mode("append").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def summary(log: DataFrame) -> DataFrame:
    return log.groupBy("model_id", "sentence_cat").agg(
        F.count("*").alias("n"), F.round(F.sum("duration"), 4).alias("total"),
        F.round(F.max("duration"), 4).alias("longest"),
    )
