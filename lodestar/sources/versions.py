"""A key-value table of versions: files dealt by key into buckets, and a manifest for each version.

Writers put their files beside the others and then try to create the next manifest, which only one of them can; the others read it and
try the one after. So no writer loses what another wrote, the order of entries is that of the versions and no clock's, and
a reader sees a version whole or not at all. A probe reads the buckets of the asked keys and no other file.
"""

from __future__ import annotations

import json
import os
import random
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "key string, value string, seq long"


class Conflict(RuntimeError):
    """Others kept writing, or changed what a writer built on."""


@dataclass(frozen=True)
class Commit:
    """Files of one write: their folder, and the version that they belong to."""

    folder: str
    version: int


class VersionedTable:
    """``buckets`` holds for a new table only; an old one keeps its own. The folder must be one that all executors reach."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        self.new_buckets = buckets

    # files

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):
        return self._at("data").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _text(self, name: str) -> str:
        stream = self._files().open(self._at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _create(self, name: str, text: str) -> bool:
        """Write a file that is there whole or not at all; false if it was there before."""
        files, draft = self._files(), self._at(f"drafts/{uuid.uuid4().hex}")
        stream = files.create(draft)
        stream.write(bytearray(text.encode()))
        stream.close()
        files.mkdirs(self._at("versions"))
        target = self._at(name)
        try:
            if files.getUri().getScheme() == "file":  # a local rename would replace the target, a link never does
                os.link(draft.toUri().getPath(), target.toUri().getPath())
            else:
                context = self.spark._jvm.org.apache.hadoop.fs.FileContext
                keep = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
                how = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
                how[0] = keep
                context.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, target, how)
            return True
        except Exception:
            if files.exists(target):
                return False
            raise
        finally:
            files.delete(draft, False)

    # versions

    def version(self) -> int:
        """The latest version, 0 before the first."""
        files, folder = self._files(), self._at("versions")
        if not files.exists(folder):
            return 0
        return max((int(x.getPath().getName().split(".")[0]) for x in files.listStatus(folder)), default=0)

    def manifest(self, version: int | None = None) -> tuple[int, list[Commit]]:
        """Number of buckets and commits of a version (the latest, if none is given)."""
        version = self.version() if version is None else version
        if not version:
            return self.new_buckets, []
        found = json.loads(self._text(f"versions/{version:012d}.json"))
        return found["buckets"], [Commit(**x) for x in found["commits"]]

    def _commit(self, build, buckets: int, attempts: int) -> int:
        """The version that ``build(version, commits before)`` became; it may raise Conflict itself."""
        for i in range(attempts):
            now = self.version()
            commits = build(now + 1, self.manifest(now)[1])
            text = json.dumps({"buckets": buckets, "commits": [x.__dict__ for x in commits]})
            if self._create(f"versions/{now + 1:012d}.json", text):
                return now + 1
            time.sleep(random.uniform(0, 0.02 * (i + 1)))
        raise Conflict(f"{attempts} others came first")

    # entries

    def _bucket(self, buckets: int) -> F.Column:
        return F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")

    def _put(self, rows: DataFrame) -> tuple[str, int]:
        """Files of entries (ENTRY), sorted by key in each bucket; of repeated keys the last by seq stays."""
        kinds = dict(rows.dtypes)
        if kinds["key"] != "string" or kinds["value"] != "string":
            raise TypeError("keys and values must be strings")
        buckets, folder = self.manifest()[0], uuid.uuid4().hex
        if "seq" not in rows.columns:
            rows = rows.withColumn("seq", F.monotonically_increasing_id())
        last = rows.where("key is not null").groupBy("key").agg(
            F.max_by(F.struct("value"), F.struct(F.coalesce(F.col("seq"), F.lit(-1)), "value")).alias("x"), F.max("seq").alias("seq"),
        )
        out = last.select("key", "x.value", "seq", self._bucket(buckets).alias("bucket"))
        out.repartition("bucket").sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(
            f"{self.path}/data/commit={folder}"
        )
        return folder, buckets

    def set(self, rows: DataFrame, attempts: int = 50) -> int:
        """Write rows (key, value and, if there, seq) over what is there and return the version; null keys and values are
        refused. Of rows that repeat a key the last by seq counts, without one the last of the table."""
        return self._append(rows.where("value is not null"), attempts)

    def delete(self, keys: DataFrame, attempts: int = 50) -> int:
        return self._append(keys.select("key", F.lit(None).cast("string").alias("value")), attempts)

    def _append(self, rows: DataFrame, attempts: int) -> int:
        folder, buckets = self._put(rows)
        return self._commit(lambda v, before: [*before, Commit(folder, v)], buckets, attempts)

    def _log(self, version: int | None) -> DataFrame:
        """All entries of a version with bucket and version."""
        _, commits = self.manifest(version)
        files = self._files()
        folders = [f"{self.path}/data/commit={c.folder}" for c in commits]
        there = [x for x in folders if any(s.isDirectory() for s in files.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(x)))]
        if not there:  # no rows were ever written
            return self.spark.createDataFrame([], f"{ENTRY}, bucket int, version long")
        rows = self.spark.read.schema(f"{ENTRY}, commit string, bucket int").option(
            "basePath", f"{self.path}/data",
        ).parquet(*there)
        known = self.spark.createDataFrame([(c.folder, c.version) for c in commits], "commit string, version long")
        return rows.join(F.broadcast(known), "commit").drop("commit")  # as many rows as a manifest lists

    @staticmethod
    def _latest(log: DataFrame) -> DataFrame:
        last = log.groupBy("key").agg(F.max_by(F.struct("value"), "version").alias("x"))
        return last.select("key", "x.value").where("value is not null")

    def read(self, version: int | None = None) -> DataFrame:
        """key and value of a version, the latest if none is given."""
        return self._latest(self._log(version))

    def probe(self, requests: DataFrame) -> DataFrame:
        """Every request (key) with ``value`` (null: a miss) and ``hit``, as of the version that is the latest now.

        Only the buckets of the asked keys are read: their numbers, of which there are ``buckets`` at most, come to the driver.
        """
        buckets, _ = self.manifest()
        asked = [r[0] for r in requests.where("key is not null").select(self._bucket(buckets).alias("b")).distinct().collect()]
        found = self._latest(self._log(None).where(F.col("bucket").isin(asked)))
        return requests.join(found, "key", "left").withColumn("hit", F.col("value").isNotNull())

    def compact(self, attempts: int = 50) -> int:
        """One folder of the latest values in place of those of all versions so far; versions that come meanwhile stay.

        Raises Conflict if another compaction came first.
        """
        base = self.version()
        buckets, old = self.manifest(base)
        if not old:
            return base
        folder, _ = self._put(self.read(base))

        def build(version, commits):
            if commits[: len(old)] != old:
                raise Conflict("another compaction came first")
            return [Commit(folder, old[-1].version), *commits[len(old) :]]

        return self._commit(build, buckets, attempts)

    def vacuum(self) -> int:
        """Delete all manifests but the latest and the files that only they name; their number. Readers of older versions
        must be done; files that no manifest names may belong to a writer and stay."""
        now, files = self.version(), self._files()
        keep = {c.folder for c in self.manifest(now)[1]}
        gone = 0
        for x in files.listStatus(self._at("versions")) if now else []:
            number = int(x.getPath().getName().split(".")[0])
            if number < now:
                for c in self.manifest(number)[1]:
                    gone += c.folder not in keep and files.delete(self._at(f"data/commit={c.folder}"), True)
                files.delete(x.getPath(), False)
        return gone
