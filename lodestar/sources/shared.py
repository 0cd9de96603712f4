"""Tables that cut lineage: what was paid for (answers of services) or is read often (fits) is written once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors reach. Only in local mode is one made where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestar-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _write(df: DataFrame):
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{uuid.uuid4().hex}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    df.write.parquet(path.toString())
    files.deleteOnExit(path)
    return files, path, spark.read.schema(df.schema).parquet(path.toString())


def settle(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read back: computed once, and a lost executor costs no second call of a service.

    The table goes when the application ends.
    """
    return _write(df)[2]


#: The most rows of a side that goes whole to every task.
FEW = 100_000


def few(df: DataFrame) -> DataFrame:
    """``df``, such as a list of systems, judges or languages, marked for broadcast if it has FEW rows at most, which are
    counted; else as it is, for Spark to decide."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


class Settled:
    """Settled tables of a loop, which go as soon as the loop has made the next ones."""

    def __init__(self, spark: SparkSession):
        self.spark, self.files = spark, {}

    def write(self, df: DataFrame) -> DataFrame:
        files, path, out = _write(df)
        self.files[id(out)] = (files, path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Nothing that is still to run may read them."""
        for df in tables:
            files, path, _ = self.files.pop(id(df))
            files.delete(path, True)

    def swap(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """``new``, written, in the place of ``old``, which it may read."""
        out = self.write(new)
        self.drop(old)
        return out
