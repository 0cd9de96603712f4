"""Key-value and JSON caches as tables: batch probes instead of point lookups, latest value wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .versions import VersionedTable

JSON_SCHEMA = "entry_id string, source_lang string, target_lang string, text string, temperature double, response string"


def latest(log: DataFrame) -> DataFrame:
    """The current state of an append-only log of (key, value, updated_at and, if there, seq): the last entry of a key
    counts, by time, then by seq; a null value deletes its key."""
    order = ["updated_at", "seq"] if "seq" in log.columns else ["updated_at"]
    last = F.row_number().over(
        Window.partitionBy("key").orderBy(*[F.desc_nulls_last(c) for c in order], F.desc_nulls_last("value"))
    )
    return log.withColumn("_n", last).where("_n = 1 and value is not null").drop("_n")


def upsert(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """``cache`` with the keys of ``rows`` replaced; the last of repeated keys counts. Null keys and values are refused."""
    return latest(cache.unionByName(rows.where("key is not null and value is not null")))


def delete(cache: DataFrame, keys: DataFrame) -> DataFrame:
    return cache.join(keys.select("key").distinct(), "key", "left_anti")


def keys(cache: DataFrame) -> DataFrame:
    return cache.select("key")


def probe(requests: DataFrame, cache: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Every request with ``value`` (null: a miss) and ``hit``; an empty value is a hit."""
    on = on or ["key"]
    return requests.join(cache.select(*on, "value"), on, "left").withColumn("hit", F.col("value").isNotNull())


def misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    return requests.join(cache, "key", "left_anti")


def probe_json(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """A hit needs entry, both languages, text and temperature to be equal (null temperatures are)."""
    c = cache.alias("c")
    r = requests.alias("r")
    same = [
        F.col(f"r.{x}").eqNullSafe(F.col(f"c.{x}")) for x in (
            "entry_id", "source_lang", "target_lang", "text", "temperature",
        )
    ]
    return r.join(c, same, "left").select("r.*", "c.response")


def read_json_cache(spark: SparkSession, path: str) -> DataFrame:
    """A missing or corrupt file counts as an empty cache; after a writer that died while it exchanged them, the old one counts."""
    there = lambda p: (lambda x: x.getFileSystem(spark._jsc.hadoopConfiguration()).exists(x))(spark._jvm.org.apache.hadoop.fs.Path(p))
    path = path if there(path) else path + ".old"
    if not there(path):
        return spark.createDataFrame([], JSON_SCHEMA)
    return spark.read.schema(JSON_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def upsert_json(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """JSON_SCHEMA: an entry has one record, the last that was written for it; ``rows`` has a column seq for its order."""
    both = cache.withColumn("seq", F.lit(-1).cast("long")).unionByName(
        rows.where("entry_id is not null").withColumn("seq", F.col("seq").cast("long"))
    )
    record = F.struct(*[c.split()[0] for c in JSON_SCHEMA.split(", ")[1:]])
    return both.groupBy("entry_id").agg(F.max_by(record, "seq").alias("x")).select("entry_id", "x.*")


def write_json_cache(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Read, change and write the whole cache; a missing or corrupt one is replaced. The new one is complete beside the
    old, which is moved aside before and deleted after the new one has its place: one of them can be read at any time."""
    upsert_json(read_json_cache(spark, path), rows).write.mode("overwrite").json(path + ".new")
    now, new, old = (spark._jvm.org.apache.hadoop.fs.Path(path + x) for x in ("", ".new", ".old"))
    files = now.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(now):
        files.delete(old, True)
        files.rename(now, old)
    files.rename(new, now)
    files.delete(old, True)


class KVTable:
    """A cache in a folder: writes are versions of a ``VersionedTable``, so their order is that of commits and no clock's."""

    def __init__(self, spark: SparkSession, path: str):
        self.versions = VersionedTable(spark, path)

    def set(self, rows: DataFrame) -> None:
        """Of rows that repeat a key the last counts: by ``seq`` if there is one, else in the order of the table. Null keys and
        values are refused."""
        self.versions.set(rows)

    def delete(self, keys: DataFrame) -> None:
        self.versions.delete(keys)

    def read(self) -> DataFrame:
        """key and value."""
        return self.versions.read()

    def probe(self, requests: DataFrame) -> DataFrame:
        return self.versions.probe(requests)

    def compact(self) -> None:
        self.versions.compact()
