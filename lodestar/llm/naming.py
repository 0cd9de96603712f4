"""Exact copies by deterministic block naming.

Texts are cut into blocks of a fixed size. Equal blocks meet, are sorted, and get one integer name; then names of
adjacent blocks are paired, equal pairs get one name, and so on until a text has a single name. Names are given by
comparing bytes and pairs, never by a digest, so two texts of one size have the same last name exactly if they are equal.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .skew import join_split
from .textbytes import NOT_SPACE, batch_bytes, slices

#: Bytes of a block, and of the blocks that a task remembers twice over: blocks that recur often stay remembered.
BLOCK, REMEMBER = 1024, 16 << 20


class Seen:
    """Where a task met a block first, for the blocks it met lately."""

    def __init__(self):
        self.new, self.old, self.room = {}, {}, REMEMBER

    def first(self, block: bytes, at: tuple[int, int]):
        """The place of an equal block that was forwarded before, or None, and then ``at`` is its place."""
        found = self.new.get(block) or self.old.get(block)
        if block not in self.new:
            self.room -= len(block) + 100
            if self.room < 0:
                self.new, self.old, self.room = {}, self.new, REMEMBER
            self.new[block] = found or at
        return found


def counts_between(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many ``marks`` each document has."""
    out = np.zeros(len(offsets) - 1, np.int64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(marks, offsets[:-1][full], dtype=np.int64)
    return out


def _blocks(docs: DataFrame, key: str, text: str, block: int, keep: np.ndarray, columns: bool) -> DataFrame:
    """A row for each block: k (the document's number), pos, and its bytes, or where the task forwarded equal bytes
    (ref_k, ref_pos). The first block's row also tells key, size, blocks, points and digest, and the whole row."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if columns else F.lit(None).cast("boolean")
    rows = docs.select(
        F.monotonically_increasing_id().alias("k"), F.col(f"`{key}`").alias("key"), whole.alias("row"),
        F.col(f"`{text}`").cast("string").alias("t"),
    )
    kinds = dict(rows.dtypes)
    schema = (
        "k long, pos long, ref_k long, ref_pos long, bytes binary, size long, blocks long, points long, digest string, "
        f"key {kinds['key']}, row {kinds['row']}"
    )

    def run(batches):
        seen = Seen()
        for batch in batches:
            data, offsets = batch_bytes(batch.column(3))
            for a, b in slices(offsets):
                low, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                yield one(seen, batch.slice(a, b - a), low, at)

    def one(seen, part, low, at):
        points = counts_between((low & 0xC0) != 0x80, at).tolist()
        stay = keep[low]
        sizes = counts_between(stay, at)
        raw = low[stay].tobytes()
        ends = np.concatenate(([0], np.cumsum(sizes))).tolist()
        ks = part.column(0).to_pylist()
        out: dict[str, list] = {
            x: [] for x in ("k", "pos", "ref_k", "ref_pos", "bytes", "size", "blocks", "points", "digest", "head")
        }
        for d, k in enumerate(ks):
            a, b = ends[d], ends[d + 1]
            n = max(1, -(-(b - a) // block))
            for i in range(n):
                piece = raw[a + i * block : min(b, a + (i + 1) * block)]
                ref = seen.first(piece, (k, i))
                out["k"].append(k)
                out["pos"].append(i)
                out["ref_k"].append(ref and ref[0])
                out["ref_pos"].append(ref and ref[1])
                out["bytes"].append(None if ref else piece)
                head = not i
                out["size"].append(b - a if head else None)
                out["blocks"].append(n if head else None)
                out["points"].append(points[d] if head else None)
                out["digest"].append(hashlib.sha256(raw[a:b]).hexdigest() if head else None)
                out["head"].append(d if head else None)
        heads = pa.array(out.pop("head"), pa.int64())
        kind = lambda x: pa.binary() if x == "bytes" else pa.string() if x == "digest" else pa.int64()
        return pa.RecordBatch.from_arrays(
            [*(pa.array(v, kind(x)) for x, v in out.items()), part.column(1).take(heads), part.column(2).take(heads)],
            names=[*out, "key", "row"],
        )

    return rows.mapInArrow(run, schema)


def _name_blocks(blocks: DataFrame) -> DataFrame:
    """``blocks`` with a name instead of bytes: equal bytes meet in one task, sorted, and are numbered there.

    The hash only deals the rows out; names follow from comparing the bytes. A name is null where bytes are.
    """
    spread = F.when(F.col("bytes").isNotNull(), F.xxhash64("bytes")).otherwise(F.xxhash64("k", "pos"))
    at = blocks.columns.index("bytes")

    def run(batches):
        name, last = (TaskContext.get().partitionId() << 40) - 1, None
        for batch in batches:
            names = []
            for x in batch.column(at).to_pylist():
                if x is not None and x != last:
                    name, last = name + 1, x
                names.append(None if x is None else name)
            rest = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(names, pa.int64())], names=[c for c in batch.schema.names if c != "bytes"] + ["name"],
            )

    schema = blocks.drop("bytes").schema.add("name", "long")
    return blocks.repartition(spread).sortWithinPartitions("bytes").mapInArrow(run, schema)


def _identities(rows: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """(k, level, name) of every document of ``rows`` (k, pos, name, m: its number of names, over 1), by levels."""
    found, level = [], 0
    while True:
        level += 1
        even = F.col("pos") % 2 == 0
        pairs = scratch.write(
            rows.groupBy("k", F.expr("pos div 2").alias("pos")).agg(
                F.max(F.when(even, F.col("name"))).alias("l"),
                F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("r"),
                F.expr("(max(m) + 1) div 2").alias("m"),
            )
        )
        if level > 1:
            scratch.drop(rows)
        n = pairs.count()
        if not n:
            scratch.drop(pairs)
            return found
        distinct = pairs.groupBy("l", "r").agg(F.count("*").alias("weight")).sortWithinPartitions("l", "r")
        names = scratch.write(distinct.withColumn("name", F.monotonically_increasing_id()))
        named = scratch.write(join_split(pairs, names, ["l", "r"], "weight", n).select("k", "pos", "name", "m"))
        scratch.drop(pairs, names)
        ready = named.where("m = 1").select("k", F.lit(level).alias("level"), "name")
        found.append(scratch.write(ready))
        rows = scratch.write(named.where("m > 1"))
        scratch.drop(named)


def exact_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK, keep: np.ndarray = NOT_SPACE,
    columns: bool = False,
) -> DataFrame:
    """Every row's ``key``, keep_id, group_size, kept, n_points and text_sha256 (hex, of the bytes that are compared).

    Texts are equal if the same bytes stay after deleting those that ``keep`` (256 booleans) marks false. Of equal texts
    the row with the most code points in its whole text stays, then the one with the smallest key (null last), then, of
    rows that agree in both, one of them; keep_id is the key of the row that stays. Null texts are empty and empty texts
    equal each other. With ``columns`` the rows of ``docs`` come as column row. An empty table gives no rows; other
    columns are not read. Rows are numbered as they are read, so ``docs`` must be a table or a plan whose tasks give the
    same rows when they run again.

    A document that shares its size and first name with no other is done after the first naming. Of blocks that recur
    within a task one goes on, and joins split at frequent names, so no task gets a third of all rows.
    """
    scratch = Scratch(docs.sparkSession)
    named = scratch.write(_name_blocks(_blocks(docs, key, text, block, keep, columns)))
    first = named.where("name is not null").select(F.col("k").alias("ref_k"), F.col("pos").alias("ref_pos"), "name")
    again = named.where("name is null").drop("name").join(first, ["ref_k", "ref_pos"])
    rows = named.where("name is not null").unionByName(again).drop("ref_k", "ref_pos")
    heads = scratch.write(rows.where("pos = 0").drop("pos"))
    total = heads.count()
    shared = heads.groupBy("size", "name").agg(F.count("*").alias("weight"), F.count("*").alias("n"))
    known = scratch.write(join_split(heads, shared, ["size", "name"], "weight", total))
    longer = known.where("n > 1 and blocks > 1").select("k", F.col("blocks").alias("m"))
    found = _identities(rows.select("k", "pos", "name").join(longer, "k"), scratch)
    some = known.where("n > 1")
    facts = some.where("blocks = 1").withColumn("level", F.lit(0))
    for x in found:
        facts = facts.unionByName(some.drop("name").join(x, "k"))
    facts = scratch.write(facts.drop("n"))
    scratch.drop(named, heads, *found)
    best = F.min(F.struct(-F.col("points"), F.col("key").isNull(), F.col("key"), F.col("k"))).alias("best")
    groups = scratch.write(
        facts.groupBy("size", "level", "name").agg(F.count("*").alias("weight"), F.count("*").alias("n"), best)
    )
    met = join_split(facts, groups, ["size", "level", "name"], "weight", total)
    alone = known.where("n = 1")
    out = met.select(
        "key", "row", "points", "digest", F.col("best.key").alias("keep"), "n", (F.col("best.k") == F.col("k")).alias("kept"),
    ).unionByName(alone.select("key", "row", "points", "digest", F.col("key").alias("keep"), "n", F.lit(True).alias("kept")))
    return _named(out, key, columns)


def _named(out: DataFrame, key: str, columns: bool) -> DataFrame:
    return out.select(
        F.col("key").alias(key), F.col("keep").alias("keep_id"), F.col("n").cast("long").alias("group_size"), "kept",
        F.col("points").alias("n_points"), F.col("digest").alias("text_sha256"), *(["row"] if columns else []),
    )


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of equal texts (see ``exact_groups``), with all their columns."""
    kept = exact_groups(docs, key, text, columns=True, **how).where("kept")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
