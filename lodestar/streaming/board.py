"""A leaderboard that grows with the log of comparisons: each micro-batch adds its pair counts to a kept state and refits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.pairwise import pair_counts

COUNTS = ("w_ij", "w_ji", "t_ij")


class Steps:
    """Tables of numbered steps in a folder; a step that is written again replaces itself, so a repeated micro-batch
    counts once. A step counts when its write has ended."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _folder(self, step: int | None = None):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path if step is None else f"{self.path}/step={step}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def numbers(self) -> list[int]:
        files, folder = self._folder()
        if not files.exists(folder):
            return []
        done = lambda x: files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))
        return sorted(int(x.getPath().getName().split("=")[1]) for x in files.listStatus(folder) if done(x.getPath()))

    def write(self, step: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/step={step}")

    def last(self, before: int | None = None) -> DataFrame | None:
        """The table of the last step (below ``before``), None if there is none."""
        found = [n for n in self.numbers() if before is None or n < before]
        return self.spark.read.parquet(f"{self.path}/step={found[-1]}") if found else None

    def forget(self, below: int) -> None:
        for n in self.numbers():
            if n < below:
                files, path = self._folder(n)
                files.delete(path, True)


def grow(
    comparisons: DataFrame, path: str, checkpoint: str, *by: str, fit: Callable[[DataFrame], DataFrame] | None = None, **trigger,
) -> StreamingQuery:
    """Start a stream that keeps the pair counts of all ``comparisons`` so far, per group of ``by``, in ``path``/counts and, with
    ``fit`` (of pair counts), what it gives for them in ``path``/board.

    The state has one row for each pair of systems that met, however long the log. A batch adds to the state of the batch before
    it and is written under its own number, so one that runs again after a failure gives the same tables; the last
    two steps are kept. ``trigger`` is as in ``writeStream.trigger``.
    """

    def batch(rows: DataFrame, number: int) -> None:
        counts, boards = Steps(rows.sparkSession, f"{path}/counts"), Steps(rows.sparkSession, f"{path}/board")
        now, before = pair_counts(rows, *by), counts.last(number)
        if before is not None:
            now = before.unionByName(now).groupBy(*by, "i", "j").agg(*[F.sum(c).alias(c) for c in COUNTS])
        counts.write(number, now)
        counts.forget(number - 1)
        if fit is not None:
            boards.write(number, fit(counts.last()))
            boards.forget(number - 1)

    return comparisons.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def state(spark: SparkSession, path: str, what: str = "counts") -> DataFrame | None:
    """The latest counts (or, as ``what`` says, the latest board) of a stream that grows in ``path``."""
    return Steps(spark, f"{path}/{what}").last()
