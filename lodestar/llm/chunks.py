"""Substring deduplication by content-defined chunks: a gear rolling hash cuts, digests find chunks seen before.

A chunk ends where the gear hash of the last HASHED bytes is the least of all within ``near`` bytes on either side. No cut
depends on another, so after an insertion the chunks are the same again as soon as these bytes are, and a repeat that is
a few chunks long holds one whole. A digest only says where to look: chunks found are compared byte by byte with the text where
they occur first, and extended to the borders of what is equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, bound_batches
from .skew import Identified, join_split
from .textbytes import RangeHash, batch_bytes, blocks, mix, slices

GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)
#: Bytes that a gear hash covers.
HASHED = 16
#: The least range of equal bytes that counts.
EQUAL = 32
#: Bytes compared beside what a digest found (more than nearly all chunks have, which is the most to a border), and the most
#: bytes between finds of a slice.
CONTEXT, SLICE = 128, 4096
#: A place is its byte times 2**LENGTH, plus the bytes of its chunk.
LENGTH = 20


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i - j]] << j for j < HASHED: the rolling gear hash, by doubling the window four times."""
    h = GEAR[data]
    for w in (1, 2, 4, 8):
        g = h.copy()
        g[w:] += h[:-w] << np.uint32(w)
        h = g
    return h


def gear_blocks(data: np.ndarray):
    """(start, end, gear hashes) of parts of the buffer."""
    for a, b in blocks(len(data)):
        before = min(a, HASHED - 1)
        yield a, b, gear_hashes(data[a - before : b])[before:]


def least_places(h: np.ndarray, near: int) -> np.ndarray:
    """Places whose number is less than all within ``near`` before and not greater than any within ``near`` after;
    FREE counts as greater than any."""
    found = []
    for a, b in blocks(len(h)):
        low, high = max(0, a - near), min(len(h), b + near)
        part = (h[low:high].astype(np.uint64) << np.uint64(32)) + np.arange(high - low, dtype=np.uint64)
        part = np.concatenate((np.full(near - (a - low), NOWHERE), part, np.full(near - (high - b), NOWHERE)))
        least, w = part, 1
        while 2 * w <= 2 * near + 1:
            least = np.minimum(least[:-w], least[w:])
            w *= 2
        least = np.minimum(least[: len(least) - (2 * near + 1 - w)], least[2 * near + 1 - w :])
        found.append(a + np.flatnonzero((least == part[near : len(part) - near]) & (h[a:b] != FREE)))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


#: No gear hash: what stands where a text has none.
FREE, NOWHERE = np.uint32(0xFFFFFFFF), np.uint64(0xFFFFFFFFFFFFFFFF)


def cut(data: np.ndarray, offsets: np.ndarray, near: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Chunk ends in the buffer and each document's number of the first; every non-empty document ends a chunk.

    A chunk ends before the first character after a byte whose gear hash is the least within ``near`` bytes, of hashes
    that lie in the document; where that leaves over ``most`` bytes, about every ``most`` bytes.
    """
    sizes = np.diff(offsets)
    room = np.arange(len(sizes)) * near  # documents stand apart, so no hash of another one is near
    h = np.full(len(data) + len(sizes) * near, FREE)
    for a, b, part in gear_blocks(data):
        of = np.searchsorted(offsets, np.arange(a, b), "right") - 1
        inside = np.arange(a, b) - offsets[of] >= HASHED - 1
        h[np.arange(a, b)[inside] + room[of[inside]]] = np.minimum(part[inside], FREE - np.uint32(1))
    at = least_places(h, near)
    at = at - room[np.searchsorted(offsets[:-1] + room, at, "right") - 1] + 1 if len(at) else at
    whole = np.ones(len(data) + 1, bool)
    whole[:-1] = (data & 0xC0) != 0x80
    for _ in range(3):
        at = at + ~whole[at]
    ends = np.unique(np.concatenate((at, offsets[1:][sizes > 0])))
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    more = []
    for i in np.flatnonzero(ends - starts > most).tolist():
        last, stop = int(starts[i]), int(ends[i])
        while stop - last > most:
            last += most
            while last < stop and not whole[last]:
                last += 1
            if last < stop:
                more.append(last)
    if more:
        ends = np.sort(np.concatenate((ends, more)))
    return ends, np.searchsorted(ends, offsets, "right")


def equal_runs(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Maximal ranges of EQUAL bytes or more in which x and y agree."""
    n = min(len(x), len(y))
    edge = np.flatnonzero(np.diff(np.concatenate(([False], x[:n] == y[:n], [False])).astype(np.int8)))
    return [(a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if b - a >= EQUAL]


def places_of(part: np.ndarray, o: np.ndarray, near: int, most: int, least: int):
    """Chunks of ``least`` bytes or more of a buffer: document, place and two digests."""
    ends, first = cut(part, o, near, most)
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    doc = np.repeat(np.arange(len(o) - 1), np.diff(first))
    long = np.flatnonzero(ends - starts >= least)
    starts, ends, doc = starts[long], ends[long], doc[long]
    h = RangeHash(part)
    one, two = h(starts, ends).view(np.int64), (h(starts, ends, 1) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return doc, (starts - o[doc] << LENGTH) + ends - starts, one, two


def dedup_chunks(
    docs: DataFrame, near: int = 16, most: int = 1024, least: int = 16, min_bytes: int = 128, key: str = "doc_id", text: str = "text", columns: bool = False
) -> DataFrame:
    """Remove runs of bytes, ``min_bytes`` long or more, that all occur earlier (smaller key, or same row before), in
    equal ranges of EQUAL bytes or more around a chunk that occurs earlier, of ``least`` bytes or more.

    Returns ``key``, n_bytes, n_chunks, n_removed, n_spans, text (what is left); with ``columns`` the rows of ``docs``
    with the text replaced instead. Each map task forwards a digest once (its other places are known to be later), so a
    passage in a third of all rows reaches a reducer once a task; its source is a block of bounded size that is
    broadcast to the rows that repeat it. Rows equal in key and text are one document and get the same result; null keys
    come last; null text stays null and counts as empty; an empty table gives an empty result; keys may be of any type
    that sorts.
    """
    bound_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    carry = Identified(docs, key, text, scratch).rows
    rows = carry.select("k", "u", "t")

    def find(batches):
        held, n = [], 0
        for batch in batches:
            ids, us = (batch.column(i).to_numpy() for i in (0, 1))
            data, offsets = batch_bytes(batch.column(2))
            for a, b in slices(offsets):
                doc, place, one, two = places_of(
                    data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], near, most, least,
                )
                held.append((one, two, ids[a + doc], us[a + doc], place))
                n += len(doc)
            if n > 1_500_000:
                yield from once(held)
                held, n = [], 0
        yield from once(held)

    def once(held):
        if not held:
            return
        d, e, k, u, i = (np.concatenate(x) for x in zip(*held))
        o = np.lexsort((i, u, k, e, d))
        d, e, k, u, i = d[o], e[o], k[o], u[o], i[o]
        again = np.zeros(len(d), bool)
        equal = (d[1:] == d[:-1]) & (e[1:] == e[:-1])
        again[1:] = equal & ~((k[1:] == k[:-1]) & (u[1:] == u[:-1]) & (i[1:] == i[:-1]))
        same = np.zeros(len(d), bool)
        same[1:] = equal & ~again[1:]
        # one row of a repeated document stands for all; a known repeat travels under a digest of its own
        run = np.maximum.accumulate(np.where(again | ~same, np.arange(len(d)), 0))
        keep, again = ~same, again[run]
        head = np.maximum.accumulate(np.where(np.concatenate(([True], ~equal)), np.arange(len(d)), 0))
        source = [x[head] for x in (k, u, i)]
        own = mix(d.view(np.uint64) ^ mix(k.view(np.uint64) * np.uint64(31) + i.view(np.uint64)))
        d, e = np.where(again, own.view(np.int64), d), np.where(again, np.int32(0), e)
        for a in range(0, len(d), 100_000):
            z = slice(a, a + 100_000)
            m = keep[z]
            places = [pa.array(x[z][m], mask=~again[z][m]) for x in source]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x[z][m]) for x in (d, e, k, u, i)), *places], names=["d", "e", "k", "u", "i", "k0", "u0", "i0"],
            )

    found = rows.mapInArrow(find, "d long, e int, k long, u long, i long, k0 long, u0 long, i0 long")
    order = Window.partitionBy("d", "e").orderBy("k", "u", "i")
    place = F.struct("k", "u", "i")
    later = found.withColumn("first", F.first(place).over(order)).where(
        F.col("k0").isNotNull() | (place != F.col("first"))
    )
    at, at0 = F.shiftright("i", LENGTH), F.shiftright(F.coalesce("i0", F.col("first.i")), LENGTH)
    n = F.col("i").bitwiseAND((1 << LENGTH) - 1)
    later = later.select(
        "k", "u", *[F.coalesce(f"{c}0", F.col(f"first.{c}")).alias(f"{c}0") for c in "ku"], (at - at0).alias("away"),
        at.alias("at"), (at + n).alias("to"),
    )
    # what one document shares with one source at one distance is compared in slices
    spans = later.groupBy(
        "k", "u", "k0", "u0", "away", F.floor(F.col("at") / SLICE),
    ).agg(F.min("at").alias("lo"), F.max("to").alias("hi"))
    block = F.floor((F.col("lo") - F.col("away")) / SLICE).alias("block")
    spans = scratch.write(spans.select("k", "u", "k0", "u0", "away", "lo", "hi", block))
    begin, stop = F.greatest(F.col("lo") - F.col("away") - CONTEXT, F.lit(0)), F.col("hi") - F.col("away") + CONTEXT
    blocks = spans.groupBy("k0", "u0", "block").agg(
        F.min(begin).alias("begin"), F.max(stop).alias("stop"), F.count("*").alias("weight"),
    )
    wanted = blocks.groupBy("k0", "u0").agg(
        F.collect_list(F.struct("block", "begin", "stop", "weight")).alias("blocks")
    )
    sources = rows.select(
        F.col("k").alias("k0"), F.col("u").alias("u0"), F.encode(F.coalesce("t", F.lit("")), "UTF-8").alias("t"),
    ).join(wanted, ["k0", "u0"]).dropDuplicates(["k0", "u0"])
    sources = sources.select("k0", "u0", "t", F.explode("blocks").alias("b")).select(
        "k0", "u0", "b.*",
        F.expr("substring(t, cast(b.begin as int) + 1, cast(b.stop - b.begin as int))").alias("bytes"),
    )
    sources = scratch.write(sources.drop("stop"))
    # slices of the source, from their place in the document
    start = F.greatest(F.greatest(F.col("lo") - CONTEXT, F.lit(0)), F.col("away"))
    joined = join_split(spans, sources, ["k0", "u0", "block"], "weight", spans.count()).withColumn("start", start)
    pieces = joined.select(
        "k", "u", "start",
        F.expr(
            f"substring(bytes, cast(start - away - begin as int) + 1, cast(hi + {CONTEXT} - start as int))"
        ).alias("piece"),
    )
    pieces = scratch.write(pieces)
    scratch.drop(spans, sources)
    pieces = pieces.groupBy("k", "u").agg(F.collect_list(F.struct("start", "piece")).alias("pieces"))
    schema = docs.schema if columns else f"`{key}` {dict(docs.dtypes)[key]}, n_bytes long, n_chunks long, n_removed long, n_spans long, text string"

    def left(batches):
        for batch in batches:
            names = batch.schema.names
            source = pa.RecordBatch.from_struct_array(batch.column(names.index("row")))
            texts = batch.column(names.index("t"))
            data, offsets = batch_bytes(texts)
            pieces = batch.column(names.index("pieces")).to_pylist()
            out, facts = [], []
            for a, b in slices(offsets):
                part, o = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                chunks = np.diff(cut(part, o, near, most)[1]).tolist() if not columns else [0] * (b - a)
                raw = part.tobytes()
                for j in range(b - a):
                    spans = repeats(part, raw, int(o[j]), int(o[j + 1]), pieces[a + j] or (), min_bytes)
                    at, keep = int(o[j]), []
                    for s, e in spans:
                        keep.append(raw[at:s])
                        at = e
                    keep.append(raw[at : int(o[j + 1])])
                    out.append(b"".join(keep))
                    facts.append((int(o[j + 1] - o[j]), chunks[j], sum(e - s for s, e in spans), len(spans)))
            left_over = pa.array(
                [x.decode("utf-8", "replace") if ok else None for x, ok in zip(out, texts.is_valid().to_pylist())],
                pa.string(),
            )
            if columns:
                yield pa.RecordBatch.from_arrays(
                    [left_over if n == text else source.column(n) for n in source.schema.names],
                    names=source.schema.names,
                )
            else:
                yield pa.RecordBatch.from_arrays(
                    [source.column(key), *(pa.array([f[q] for f in facts], pa.int64()) for q in range(4)), left_over],
                    names=[key, "n_bytes", "n_chunks", "n_removed", "n_spans", "text"],
                )

    if not columns:
        carry = carry.withColumn("row", F.struct(F.col(f"row.`{key}`").alias(key)))
    return carry.join(pieces, ["k", "u"], "left").mapInArrow(left, schema)


def repeats(part: np.ndarray, raw: bytes, start: int, stop: int, pieces, min_bytes: int) -> list[tuple[int, int]]:
    """Runs of whole characters of a document, at least ``min_bytes`` long, that its slices of earlier texts equal."""
    known = []
    for x in pieces:
        s = start + x["start"]
        known += [(s + c, s + e) for c, e in equal_runs(np.frombuffer(x["piece"], np.uint8), part[s:stop])]
    runs, spans = [], []
    for s, e in sorted(known):
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    for s, e in runs:
        while s < e and raw[s] & 0xC0 == 0x80:
            s += 1
        while s < e < stop and raw[e] & 0xC0 == 0x80:
            e -= 1
        if e - s >= min_bytes:
            spans.append((s, e))
    return spans
