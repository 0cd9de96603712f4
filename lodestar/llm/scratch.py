"""Shared intermediate tables that cut lineage, in the folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import shared_dir

#: Settings while a table is written. An Arrow batch of whole texts is bounded, so that Python memory doesn't follow the
#: longest texts, and shuffle files go when their query ends.
WRITING = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for a while; the former ones come back."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def bound_batches(spark: SparkSession) -> None:
    """For a lazy result whose last step maps whole texts: bounds the batches of the session where they are Spark's own.

    A lazy plan reads these settings when it runs, so they can't be put back here; values that the caller has set stay.
    """
    for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"):
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, WRITING[k])


class Scratch:
    """Writes tables into a folder of its own; what isn't dropped before goes when the application ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        self.n = 0

    def _files(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def write(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as Parquet and return the table read back: a lost executor costs no recomputation."""
        path = f"{self.root}/{self.n}"
        with settings(self.spark, WRITING):
            df.write.option("compression", "zstd").parquet(path)
        if not self.n:
            files, root = self._files(self.root)
            files.deleteOnExit(root)
        self.n += 1
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables made by ``write``; nothing that is still to run may read them."""
        for df in tables:
            files, path = self._files(df._scratch)
            files.delete(path, True)
