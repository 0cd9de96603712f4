"""Queries of streams and of the versioned table, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import davidson as dv
from .operators import pairwise
from .sources import fixtures
from .sources.shared import shared_dir
from .sources.versions import VersionedTable
from .streaming import board
from .streaming.latency import append_windows, windowed

N = 8  # systems of the test facts
PARTS, LATE = 6, "3 days"


def _path(s: SparkSession, name: str) -> str:
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


def _in_parts(rows: DataFrame, part: F.Column, parts: int, path: str) -> DataFrame:
    """``rows`` as a stream of so many files, one a micro-batch, in the order of their parts."""
    for k in range(parts):  # a file source reads files in the order of their times
        rows.where(part == k).coalesce(1).write.mode("append").parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _grown(s, d, fit=None):
    """The comparisons as a stream of four batches, added up and fitted after each."""
    path, rows = _path(s, "board"), fixtures.comparisons(s, d)
    stream = _in_parts(rows, F.col("sentence").cast("long") % 4, 4, f"{path}/log")
    q = board.grow(pairwise.watched(stream), path, f"{path}/progress", "language", fit=fit, availableNow=True)
    q.awaitTermination()
    return path, q


def stream_counts(s, d):
    """The state of the stream after its last batch: the pair counts of all comparisons."""
    return board.state(s, _grown(s, d)[0])


def stream_board(s, d):
    """The board that the stream has refitted last: points won equal points expected."""
    path, _ = _grown(s, d, lambda counts: dv.fit(counts, N, "language"))
    counts = board.state(s, path)
    return dv.moments(counts, board.state(s, path, "board"), "language").where("points > 0 or expected > 0")


def stream_progress(s, d):
    """What the running stream has reported of its batches, added up: comparisons, ties and their share."""
    _, q = _grown(s, d)
    seen = [p["observedMetrics"]["progress"] for p in q.recentProgress if p["observedMetrics"]]  # one for each batch
    rows = s.createDataFrame([(int(x["n"]), int(x["ties"])) for x in seen], "n long, ties long")
    return rows.agg(F.sum("n").alias("n"), F.sum("ties").alias("ties")).withColumn(
        "tie_rate", F.round(F.try_divide("ties", "n"), 6),
    )


def latency_appended(s, d):
    """Windows of an hour as a stream closes them: every seventh event comes a part late, every eleventh two parts, and what comes
    after the watermark has passed its window is dropped."""
    e = fixtures.table(s, d, "events")
    n = e.count()
    late = F.when(F.col("event_id") % 11 == 0, 2).when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    place = F.least(F.lit(PARTS - 1), F.floor(F.col("event_id") * PARTS / n).cast("int") + late)
    rows = e.select(
        F.concat(F.lit("m"), (F.col("user_id") % 8).cast("string")).alias("model_id"), F.col("value").alias("duration"),
        F.col("ts").cast("timestamp").alias("logged_at"), place.alias("part"),
    )
    path = _path(s, "windows")
    stream = _in_parts(rows, F.col("part"), PARTS, f"{path}/log")
    append_windows(windowed(stream, "1 hour", LATE), f"{path}/out", f"{path}/progress", availableNow=True).awaitTermination()
    return s.read.parquet(f"{path}/out").select(F.col("start").cast("timestamp_ntz").alias("start"), "model_id", "n", "total")


def _versions(s, d):
    """Events written over one another in three versions, keys deleted, then compacted, and written once more."""
    e = fixtures.table(s, d, "events").select(
        F.concat(F.lit("u"), (F.col("user_id") % 70).cast("string")).alias("key"), F.col("event_type").alias("value"),
        F.col("event_id").alias("seq"),
    )
    kv = VersionedTable(s, _path(s, "versions"), buckets=8)
    kv.set(e.where("value <> 'click'"))
    kv.set(e.where("value = 'click'"))
    kv.delete(e.select("key").where("key like '%7'").distinct())
    kv.compact()
    kv.set(e.where("key like 'u3%' and value = 'view'"))
    return kv, e


def versioned_table(s, d):
    return _versions(s, d)[0].read()


def versioned_history(s, d):
    """The table as of each version, in rows and keys."""
    kv, _ = _versions(s, d)
    at = [kv.read(v).groupBy("value").agg(F.count("*").alias("keys")).withColumn("version", F.lit(v)) for v in range(1, kv.version() + 1)]
    return fixtures.union_all(at)


def versioned_probe(s, d):
    """Requests of twice as many keys as there are, against the latest version."""
    kv, e = _versions(s, d)
    asked = fixtures.table(s, d, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 140).cast("string")).alias("key"))
    return kv.probe(asked).groupBy("hit", "value").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))


QUERIES = {f.__name__: f for f in (
    stream_counts, stream_board, stream_progress, latency_appended, versioned_table, versioned_history, versioned_probe,
)}

_VERSIONS = """e AS (SELECT 'u' || (user_id % 70)::VARCHAR AS key, event_type AS value, event_id AS seq FROM events),
log AS (
  SELECT key, value, seq, 1 AS version FROM e WHERE value <> 'click' UNION ALL
  SELECT key, value, seq, 2 FROM e WHERE value = 'click' UNION ALL
  SELECT DISTINCT key, NULL, 0, 3 FROM e WHERE key LIKE '%7' UNION ALL
  SELECT key, value, seq, 5 FROM e WHERE key LIKE 'u3%' AND value = 'view'),
state AS (
  SELECT v AS version, key, value FROM (
    SELECT v, key, value, row_number() OVER (PARTITION BY v, key ORDER BY version DESC, seq DESC) AS k
    FROM log JOIN (SELECT unnest(range(1, 6)) AS v) x ON version <= v) WHERE k = 1 AND value IS NOT NULL)"""


def oracle(comp: str, counts: str, moments: str) -> dict[str, str]:
    return {
        "stream_counts": counts,
        "stream_board": moments,
        "stream_progress": f"""WITH {comp} SELECT count(*) AS n, count_if(vote = 'tie')::BIGINT AS ties,
  round(count_if(vote = 'tie') / count(*), 6) AS tie_rate FROM votes""",
        "latency_appended": f"""WITH e AS (
  SELECT *, least({PARTS - 1}, event_id * {PARTS} // (SELECT count(*) FROM events) + CASE WHEN event_id % 11 = 0 THEN 2
    WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) AS part FROM events),
w AS (  -- rows of a part are late by the watermark that closed windows before it
  SELECT p.part, (SELECT max(ts) FROM e WHERE e.part <= p.part - 2) - INTERVAL {LATE} AS mark FROM (SELECT DISTINCT part FROM e) p),
r AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS start, 'm' || (user_id % 8)::VARCHAR AS model_id, value FROM e
  JOIN w ON e.part = w.part WHERE mark IS NULL OR date_trunc('hour', ts) + INTERVAL 1 HOUR > mark)
SELECT start, model_id, count(*) AS n, round(sum(value), 4) AS total FROM r
  WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL {LATE} GROUP BY ALL""",
        "versioned_table": f"WITH {_VERSIONS} SELECT key, value FROM state WHERE version = 5",
        "versioned_history": f"WITH {_VERSIONS} SELECT version::INT AS version, value, count(*) AS keys FROM state GROUP BY ALL",
        "versioned_probe": f"""WITH {_VERSIONS}, q AS (SELECT 'u' || (user_id % 140)::VARCHAR AS key FROM events)
SELECT a.key IS NOT NULL AS hit, a.value, count(*) AS n, count(DISTINCT q.key) AS keys FROM q
  LEFT JOIN (SELECT * FROM state WHERE version = 5) a ON q.key = a.key GROUP BY ALL""",
    }
