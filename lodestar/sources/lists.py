"""Lists that an evaluation starts from: sentences by category, systems under test, judges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import entry_id

ENTRY = "list_name string, pos int, model_name string, model_company string, service string, model string, temp string, thinking string"
JUDGE = "pos int, judge string, service string, model string, prefix string"


def sentences(rows: DataFrame) -> DataFrame:
    """(category, sentences array) to sentence_category, category_pos, sentence_pos, sentence."""
    if "category_pos" not in rows.columns:
        rows = rows.withColumn("category_pos", F.lit(0))
    return rows.select(
        F.col("category").alias("sentence_category"), "category_pos",
        F.posexplode("sentences").alias("sentence_pos", "sentence"),
    )


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object of category: [sentences], in the order of the file."""
    whole = spark.read.text(path, wholetext=True)
    listed = whole.select(
        F.posexplode(F.map_entries(F.from_json("value", "map<string,array<string>>"))).alias("category_pos", "x")
    )
    return sentences(
        listed.select("category_pos", F.col("x.key").alias("category"), F.col("x.value").alias("sentences"))
    )


def entries(rows: DataFrame, list_name: str | None = None) -> DataFrame:
    """Systems of a list (of all lists without a name), with the key that caches know them by.

    ``temp`` is the text that the key holds ('0', '0.33'); the number is ``temperature``. Positions count from 0.
    """
    rows = rows if list_name is None else rows.where(F.col("list_name") == list_name)
    key = entry_id(F.col("model_name"), F.col("model_company"), F.col("service"), F.col("temp"), F.col("thinking"))
    return rows.withColumns({"temperature": F.col("temp").try_cast("double"), "tested_entry": key})


def read_entries(spark: SparkSession, path: str, list_name: str | None = None) -> DataFrame:
    """JSON lines of ENTRY."""
    return entries(spark.read.schema(ENTRY).json(path), list_name)


def read_judges(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of JUDGE: the judges in order, with the service and model that speak for each."""
    return judges(spark.read.schema(JUDGE).json(path))


def judges(rows: DataFrame) -> DataFrame:
    """A registry with each judge once, at its first position, and with an empty prefix instead of none."""
    first = F.min_by(
        F.struct("pos", "service", "model", F.coalesce("prefix", F.lit("")).alias("prefix")), "pos",
    ).alias("x")
    return rows.where("judge is not null").groupBy("judge").agg(first).select("judge", "x.*")


def entry_struct() -> F.Column:
    """What a result says about a system."""
    return F.struct(
        "model_name", "model_company", F.col("service").alias("inference_service_name"),
        F.col("temperature").alias("temp"),
    )
