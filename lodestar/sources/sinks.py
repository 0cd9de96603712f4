"""Where results go: nested documents as JSON or Parquet, reports as text, charts as SVG."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_document(document: DataFrame, path: str, kind: str = "json") -> None:
    """The nested document, one JSON object a line and language, or Parquet."""
    document.write.mode("overwrite").format(kind).save(path)


def as_json(document: DataFrame, nested: str) -> DataFrame:
    """``document`` with its nested column as JSON text."""
    return document.withColumn(nested, F.to_json(nested))


def write_lines(report: DataFrame, path: str, by: str | None = None) -> None:
    """The lines of a report in its order, as one text file, or one for each value of ``by``, in folders: reports have a row per
    system, judge or category."""
    if by is None:
        report.orderBy("rank").select("line").coalesce(1).write.mode("overwrite").text(path)
    else:
        rows = report.repartition(by).sortWithinPartitions(by, "rank").select(by, "line")
        rows.write.partitionBy(by).mode("overwrite").text(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text, such as a chart, as one file."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
