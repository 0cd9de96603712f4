"""Exact substring deduplication by suffix order, built column by column over many strings.

Every window of ``length`` bytes belongs to one anchor, the least hash of its grams of ``gram`` bytes (the leftmost, if
tied), so equal windows belong to equal grams at equal distances. The windows of an anchor form a segment of under
2 * ``length`` bytes. Grams that occur in two different segments or more send these segments to ``collection``: it
inserts one symbol of every segment a round, from the back, updates the collection's Burrows-Wheeler transform and
common prefixes in one sequential pass each, and so sorts all suffixes; windows are equal where the common prefix is
``length`` or more. Copies of a segment are known by two independent digests of 64 bits and only their first goes on.

The segments of a gram that has over MOST are cut in two: of what a window adds to its gram, half or more stands before it or
else more than half behind it, and equal windows agree in which and in these bytes. So gram and bytes are a longer anchor, which
fewer segments share, and cutting on makes it longer until it is the window itself. Such grams are dealt to
tasks by anchors that are cut CUTS times; a task cuts on what still has too many segments. What meets in a collection stays
small however often a gram occurs.

Inserting symbols of whole documents would take as many passes over the corpus as its longest text has bytes;
segments bound that number and the size of a collection, and collections are independent tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, bound_batches
from .skew import Identified
from .textbytes import RangeHash, batch_bytes, mix, slices

#: Segments of a collection, at least; and of one anchor in a collection, at most. A round of a collection handles all its
#: segments at once, so small ones cost as many rounds as large ones: hence the first number. The second bounds what one key brings
#: to a task at a few hundred rows, the size of a collection.
COLLECTION, MOST = 1000, 500
#: Bytes of the parts that longer texts are read in (at most 2**24, the room for a place).
LONG = 1 << 21


def collection(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All non-empty suffixes of the segments in order: segment numbers, suffix lengths, common prefixes with the one before.

    Round j adds the suffixes of length j. The transform holds, for every suffix so far, the symbol before it (0 at a
    segment's start); those of one symbol keep their order when it is put before them. That gives each new suffix its
    place, and its common prefixes with both neighbours are 1 + the least between theirs a symbol later.
    """
    sizes = np.diff(offsets)
    m, width = len(sizes), int(sizes.max(initial=0))
    text = np.zeros((m, width), np.uint8)  # column j: the symbol j + 1 from the end; UTF-8 has no 0xFF, so + 1 fits
    text[np.repeat(np.arange(m), sizes), np.repeat(offsets[1:], sizes) - 1 - np.arange(len(data))] = data + 1
    kind = np.uint8 if width < 255 else np.uint32
    before, common = np.zeros(m, np.uint8), np.zeros(m + 1, kind)
    names = np.arange(m) << 16
    place, active = np.arange(m), np.arange(m)
    for j in range(1, width + 1):
        going = sizes[active] >= j
        active, place = active[going], place[going]
        before[place] = text[active, j - 1]
        order = np.argsort(before, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        ended = int(np.searchsorted(before[order], 1))
        at = rank[place]
        o = np.argsort(at)
        at, active, place = at[o], active[o], place[o]
        new = m + at - ended
        size = len(before) + len(new)
        # common prefixes with the neighbours of the same first symbol: least of a range, by one ordered reduction each
        c = before[place]
        left, right = order[np.maximum(at - 1, 0)], order[np.minimum(at + 1, len(order) - 1)]
        has_left, has_right = (at > 0) & (before[left] == c), (at + 1 < len(order)) & (before[right] == c)
        with_left, with_right = np.zeros(len(at), kind), np.zeros(len(at), kind)
        for has, a, b, out in ((has_left, left + 1, place + 1, with_left), (has_right, place + 1, right + 1, with_right)):
            i = np.flatnonzero(has)
            if len(i):
                i = i[np.argsort(a[i], kind="stable")]
                out[i] = np.minimum.reduceat(common, np.stack((a[i], b[i]), axis=1).ravel())[::2] + 1
        fresh = np.zeros(size, bool)
        fresh[new] = True
        old = np.flatnonzero(~fresh)
        grown = np.zeros(size + 1, kind)
        grown[old] = common[:-1]
        grown[new + 1] = with_right
        grown[new] = with_left
        common = grown
        held = np.zeros(size, np.uint8)
        held[old] = before
        before = held
        held = np.empty(size, np.int64)
        held[old] = names
        held[new] = (active << 16) | j
        names = held
        place = new
    return names[m:] >> 16, names[m:] & 0xFFFF, common[m:-1]


def may_repeat(data: np.ndarray, offsets: np.ndarray, anchor: np.ndarray, distances: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Segments that can share a window with another of their anchor.

    Of the bytes that a window adds to its gram at least half stand on one side of it, so such a segment shares that
    many bytes before or after the gram with another one.
    """
    base, sizes = offsets[:-1], np.diff(offsets)
    h, side = RangeHash(data), (length - gram + 1) // 2
    group = np.unique(anchor, return_inverse=True)[1].astype(np.uint64)
    out = np.zeros(len(base), bool)
    at = base + distances
    for a, b in ((at - side, at + gram), (at, at + gram + side)):
        have = np.flatnonzero((a >= base) & (b <= base + sizes))
        code = mix(h(a[have], b[have]) ^ mix(group[have]))
        _, where, count = np.unique(code, return_inverse=True, return_counts=True)
        out[have] |= count[where] > 1
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Segments of a buffer of LONG bytes at most: document, first and last window, distance of the anchor, digests of
    its gram and two of the segment."""
    n = len(data)
    none, codes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n < length:
        return none, none, none, none, codes, codes, codes
    h = RangeHash(data)
    i = np.arange(n - gram + 1)
    g = h.fixed(gram) if gram % 8 == 0 else h(i, i + gram)
    low = (g & ~np.uint64(0xFFFFFF)) | i.astype(np.uint64)
    w, have = length - gram + 1, 1
    while have * 2 <= w:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < w:
        low = np.minimum(low[: have - w], low[w - have :])
    end = np.repeat(offsets[1:], np.diff(offsets))
    s = np.flatnonzero(np.arange(n - length + 1) + length <= end[: n - length + 1])
    if not len(s):
        return none, none, none, none, codes, codes, codes
    p = (low[s] & np.uint64(0xFFFFFF)).astype(np.int64)
    cut = np.flatnonzero((np.diff(p) != 0) | (np.diff(s) != 1)) + 1
    a, b, p = s[np.concatenate(([0], cut))], s[np.concatenate((cut - 1, [len(s) - 1]))], p[np.concatenate(([0], cut))]
    doc = np.searchsorted(offsets, a, "right") - 1
    shape = ((p - a) << 20 | (b - a)).astype(np.uint64)
    return doc, a - offsets[doc], b - offsets[doc], p - a, g[p] >> np.uint64(16), mix(h(a, b + length) + shape), h(a, b + length, 1)


def _ranges(k, u, a, b):
    """Flagged ranges of window starts with touching ones of a document joined."""
    o = np.lexsort((a, u, k))
    k, u, a, b = k[o], u[o], a[o], b[o]
    head = np.ones(len(k), bool)
    head[1:] = (k[1:] != k[:-1]) | (u[1:] != u[:-1]) | (a[1:] > b[:-1] + 1)
    cut = np.flatnonzero(head)
    return k[cut], u[cut], a[cut], np.maximum.reduceat(b, cut) if len(cut) else b[cut]


  #: A row of segments; place is the first window times 2**32, plus the last; shape the anchor's distance times 4, plus the kind.
FOUND = "gram long, seg long, more long, k long, u long, place long, shape int"


def _found(**c):
    n = len(c["k"])
    names = ["gram", "seg", "more", "k", "u"]
    columns = [pa.array(c[x] if x in c else np.zeros(n, np.int64), pa.int64()) for x in names]
    place, shape = (c["a"].astype(np.int64) << 32) + c["b"], (
        c["off"] * 4 if "off" in c else np.zeros(n, np.int64)
    ) + c["kind"]
    return pa.RecordBatch.from_arrays(
        [*columns, pa.array(place, pa.int64()), pa.array(shape.astype(np.int32))], names=[*names, "place", "shape"],
    )


def _unpacked(batch: pa.RecordBatch) -> dict:
    rows = {c: batch.column(i).to_numpy() for i, c in enumerate(batch.schema.names)}
    place, shape = rows.pop("place"), rows.pop("shape").astype(np.int64)
    return rows | {"a": place >> 32, "b": place & 0xFFFFFFFF, "off": shape >> 2, "kind": shape & 3}


def _first_of_each(rows: dict) -> tuple[dict, np.ndarray]:
    """Rows by gram, segment and place, each place once; which are the first of their segment."""
    o = np.lexsort(tuple(rows[x] for x in ("a", "u", "k", "more", "seg", "gram")))
    rows = {x: v[o] for x, v in rows.items()}
    equal = lambda *names: np.logical_and.reduce([rows[x][1:] == rows[x][:-1] for x in names])
    lead, once = np.ones(len(o), bool), np.ones(len(o), bool)
    lead[1:] = ~equal("gram", "seg", "more")
    once[1:] = ~equal("gram", "seg", "more", "k", "u", "a")
    return {x: v[once] for x, v in rows.items()}, lead[once]


#: A segment with its bytes; off is the distance of its gram, kind holds the bytes of its anchor before and behind the gram too
#: (see ``_state``). Rows of kind 1 are windows a to off that are known to be later.
PIECE = "gram long, k long, u long, a int, kind int, off int, x binary"
#: How often segments of frequent grams are cut before they are dealt: two cuts give anchors of four fifths of a window.
CUTS = 2


def _state(kind, left, right):
    """Kind and the bytes of the anchor before and behind the gram (under 2**14 each) as one number."""
    return kind + (left << 2) + (right << 16)


def _pieces(batch: pa.RecordBatch) -> dict:
    """PIECE rows as arrays: numbers, the bytes of all as x, and at (where each begins, and the end)."""
    names = batch.schema.names
    rows = {c: batch.column(names.index(c)).to_numpy().astype(np.int64) for c in ("gram", "k", "u", "a", "kind", "off")}
    rows["x"], rows["at"] = batch_bytes(batch.column(names.index("x")))
    return rows


def _taken(rows: dict, pick: np.ndarray) -> dict:
    """The rows at ``pick``, in that order."""
    out = {c: v[pick] for c, v in rows.items() if c not in ("x", "at")}
    sizes = np.diff(rows["at"])[pick]
    at = np.concatenate(([0], np.cumsum(sizes)))
    out["x"] = rows["x"][np.arange(at[-1]) + np.repeat(rows["at"][:-1][pick] - at[:-1], sizes)]
    return out | {"at": at}


def _joined(parts: list[dict]) -> dict:
    out = {c: np.concatenate([p[c] for p in parts]) for c in parts[0] if c != "at"}
    sizes = np.concatenate([np.diff(p["at"]) for p in parts])
    return out | {"at": np.concatenate(([0], np.cumsum(sizes)))}


def _firsts(rows: dict, length: int) -> tuple[dict, tuple]:
    """One row of those with the same anchor and bytes, the first by place, sorted by anchor; and the windows (k, u, from, to)
    of the others. A row that is listed twice is one."""
    h = RangeHash(rows["x"])(rows["at"][:-1], rows["at"][1:])
    rows = _taken(rows, np.lexsort((rows["a"], rows["u"], rows["k"], h, rows["gram"])))
    same = _copies(rows)
    listed = same.copy()
    for c in ("k", "u", "a"):
        listed[1:] &= np.diff(rows[c]) == 0
    again = np.flatnonzero(same & ~listed)
    k, u, first = (rows[c][again] for c in ("k", "u", "a"))
    return _taken(rows, np.flatnonzero(~same)), (k, u, first, first + np.diff(rows["at"])[again] - length)


def _passed(k, u, a, b) -> pa.RecordBatch:
    """Windows that are known to be later, on their way to the flags."""
    n = len(k)
    spread = mix(k.view(np.uint64) * np.uint64(31) + a.astype(np.uint64)).view(np.int64)
    rows = {"gram": spread, "k": k, "u": u, "a": a, "kind": np.ones(n, np.int64), "off": b}
    return _batch(rows | {"x": np.zeros(0, np.uint8), "at": np.zeros(n + 1, np.int64)})


def _batch(rows: dict) -> pa.RecordBatch:
    n = len(rows["gram"])
    x = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(rows["at"].astype(np.int32)), pa.py_buffer(rows["x"])])
    numbers = [pa.array(rows[c].astype(np.int64 if c in ("gram", "k", "u") else np.int32)) for c in ("gram", "k", "u", "a", "kind", "off")]
    return pa.RecordBatch.from_arrays([*numbers, x], names=["gram", "k", "u", "a", "kind", "off", "x"])


def _cut_in_two(rows: dict, length: int, gram: int) -> dict:
    """The segments cut by longer anchors, which take in half of the bytes that a window still has beside its anchor: those
    before it where they are half or more, else those behind. Anchors that differ before stay apart; one that is a whole
    window stays as it is."""
    left, right = rows["kind"] >> 2 & 0x3FFF, rows["kind"] >> 16
    rest = length - gram - left - right
    half = (rest + 1) // 2
    sizes = np.diff(rows["at"])
    split = np.where(rest > 0, np.clip(rows["off"] - left - half + 1, 0, sizes - length + 1), sizes - length + 1)  # windows of the first part
    first, second = np.flatnonzero(split > 0), np.flatnonzero(split <= sizes - length)
    head, tail = _taken(rows, first), _taken(rows, second)
    head = _sliced(head, np.zeros(len(first), np.int64), split[first] - 1 + length)
    head["kind"] = _state(2, (left + half)[first], right[first])
    tail = _sliced(tail, split[second], np.diff(tail["at"]) - split[second])
    tail["kind"] = _state(2, left[second], (right + rest - half + 1)[second])
    out = _joined([head, tail])
    left, right = out["kind"] >> 2 & 0x3FFF, out["kind"] >> 16
    p = out["at"][:-1] + out["off"]
    h = RangeHash(out["x"])(p - left, p + gram + right)
    out["gram"] = mix(out["gram"].view(np.uint64) ^ mix(h + out["kind"].view(np.uint64))).view(np.int64)
    return out


def _sliced(rows: dict, start: np.ndarray, size: np.ndarray) -> dict:
    """Segments from the window ``start`` on, of ``size`` bytes."""
    at = np.concatenate(([0], np.cumsum(size)))
    x = rows["x"][np.arange(at[-1]) + np.repeat(rows["at"][:-1] + start - at[:-1], size)]
    return rows | {"a": rows["a"] + start, "off": rows["off"] - start, "x": x, "at": at}


def _copies(rows: dict) -> np.ndarray:
    """Rows with the anchor and the bytes of the row before."""
    sizes = np.diff(rows["at"])
    same = np.zeros(len(sizes), bool)
    same[1:] = (np.diff(rows["gram"]) == 0) & (np.diff(sizes) == 0)
    i = np.flatnonzero(same)
    if len(i):
        n = sizes[i]
        ends = np.cumsum(n)
        inner = np.arange(ends[-1]) - np.repeat(ends - n, n)
        differs = rows["x"][np.repeat(rows["at"][i], n) + inner] != rows["x"][np.repeat(rows["at"][i - 1], n) + inner]
        same[i] = np.add.reduceat(differs, ends - n) == 0
    return same


def _flags(k, u, a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(k), pa.array(u), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["k", "u", "a", "b"],
    )


def remove_repeats(
    docs: DataFrame, length: int = 100, gram: int = 24, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts earlier (smaller key, or same row before).

    Returns ``key``, n_bytes, n_removed, n_spans, kept (the bytes that are left). Strings never cross rows and are
    judged on the input. Rows equal in key and text are one document and get the same result; null keys come last; keys
    may be of any type that sorts; null text is empty; texts shorter than ``length`` stay whole; an empty table gives an
    empty result. Copies of a segment are taken as equal by 128 bits of digest, all other windows by the order of suffixes.
    """
    bound_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    whole = Identified(docs, key, text, scratch).rows.select(F.col(f"row.`{key}`").alias("key"), "k", "u", "t")
    texts = whole.select("k", "u", "t")

    def segments(batches):
        held, n = [], 0
        for batch in batches:
            ids, us = (batch.column(i).to_numpy() for i in (0, 1))
            data, offsets = batch_bytes(batch.column(2))
            for x, y in slices(offsets, LONG // 2):
                for c, d in [(offsets[x], offsets[y])] if offsets[y] - offsets[x] < LONG else _long(offsets[x], offsets[y], length):
                    o = np.clip(offsets[x : y + 1] - c, 0, d - c)
                    doc, a, b, off, *codes = anchors(data[c:d], o, length, gram)
                    g, seg, more = (v.view(np.int64) for v in codes)
                    shift = int(c - offsets[x])
                    held.append(
                        {
                            "gram": g, "seg": seg, "more": more, "k": ids[x:y][doc], "u": us[x:y][doc], "a": a + shift,
                            "b": b + shift, "off": off,
                        }
                    )
                    n += len(doc)
            if n > 1_000_000:
                yield from once(held)
                held, n = [], 0
        yield from once(held)

    def _long(start, stop, length):
        """Overlapping parts of a text of LONG bytes or more; every window lies in one of them."""
        step = LONG - 2 * length
        at = start
        while at < stop:
            yield at, min(stop, at + step + length - 1)
            at += step

    def once(held):
        if not sum(len(x["k"]) for x in held):
            return
        rows = {c: np.concatenate([x[c] for x in held]) for c in held[0]}
        both = mix(rows["gram"].view(np.uint64) ^ mix(rows["seg"].view(np.uint64)))
        o = np.argsort(both)
        near = np.zeros(len(o), bool)
        near[1:] = both[o][1:] == both[o][:-1]
        near[:-1] |= near[1:]
        alone, multi = o[~near], o[near]
        again, lead = _first_of_each({c: v[multi] for c, v in rows.items()})
        for m, part in ((np.ones(len(alone), bool), {c: v[alone] for c, v in rows.items()}), (lead, again)):
            got = {c: v[m] for c, v in part.items()}
            for z in range(0, len(got["k"]), 25_000):
                sub = {c: v[z : z + 25_000] for c, v in got.items()}
                yield _found(kind=0, **sub)
        k, u, a, b = _ranges(*(again[c][~lead] for c in ("k", "u", "a", "b")))
        if len(k):
            spread = mix(k.view(np.uint64) * np.uint64(31) + a.astype(np.uint64)).view(np.int64)
            yield _found(gram=spread, kind=1, k=k, u=u, a=a, b=b)

    def firsts(batches):
        """Per gram: repeats of a segment are flagged (1); if it has several segments, their firsts go on: 2, and 3 where there
        are more than MOST. Of an unfinished gram one row a segment is held, and MOST of them at most."""
        tail, many = None, False
        for batch in batches:
            rows = _unpacked(batch)
            passed = rows["kind"] == 1
            if passed.any():
                yield _found(kind=1, **{c: rows[c][passed] for c in ("k", "u", "a", "b")})
            rows = {c: v[~passed] for c, v in rows.items()}
            if tail is not None:
                rows = {c: np.concatenate((tail[c], v)) for c, v in rows.items()}
            if not len(rows["k"]):
                continue
            last = int(np.searchsorted(rows["gram"], rows["gram"][-1]))
            done, tail = {c: v[:last] for c, v in rows.items()}, {c: v[last:] for c, v in rows.items()}
            if last:
                yield from judged(done, many)
                many = False
            if len(tail["k"]) > MOST:
                tail, lead = _first_of_each(tail)
                yield from repeated(tail, lead)
                tail = {c: v[lead] for c, v in tail.items()}
                if len(tail["k"]) > MOST:  # all but the last, which may have copies still to come
                    many = True
                    yield from judged({c: v[:-1] for c, v in tail.items()}, many)
                    tail = {c: v[-1:] for c, v in tail.items()}
        if tail is not None and len(tail["k"]):
            yield from judged(tail, many)

    def repeated(rows, lead):
        if not lead.all():
            k, u, a, b = _ranges(*(rows[c][~lead] for c in ("k", "u", "a", "b")))
            yield _found(kind=1, k=k, u=u, a=a, b=b)

    def judged(rows, many):
        """Rows of whole grams, but that ``many`` says the first gram had more rows before."""
        rows, lead = _first_of_each(rows)
        yield from repeated(rows, lead)
        heads = {c: v[lead] for c, v in rows.items()}
        g = heads["gram"]
        new = np.ones(len(g), bool)
        new[1:] = g[1:] != g[:-1]
        n = np.add.reduceat(np.ones(len(g), np.int64), np.flatnonzero(new))[np.cumsum(new) - 1]
        over = (n > MOST) | ((g == g[0]) & many)
        for pick, kind in (((n > 1) & ~over, 2), (over, 3)):
            if pick.any():
                yield _found(kind=kind, **{c: v[pick] for c, v in heads.items() if c in ("gram", "k", "u", "a", "b", "off")})

    found = texts.mapInArrow(segments, FOUND)
    sorted_in = found.repartition(F.col("gram")).sortWithinPartitions("gram", "seg", "more", "k", "u", "place")
    table = scratch.write(sorted_in.mapInArrow(firsts, FOUND))
    a, b = F.shiftright("place", 32).cast("int").alias("a"), F.col("place").bitwiseAND((1 << 32) - 1).cast("int").alias("b")
    kind, off = F.col("shape").bitwiseAND(3).alias("kind"), F.shiftright("shape", 2).alias("off")
    table = table.select("gram", "k", "u", a, b, kind, off)
    wanted = table.where("kind > 1").groupBy("k", "u").agg(
        F.collect_list(F.struct("gram", "a", "b", "kind", "off")).alias("wanted")
    )
    # the bytes of the segments, cut out where the texts are
    cut = lambda w: F.struct(
        w["gram"].alias("gram"), w["a"].alias("a"), w["kind"].alias("kind"), w["off"].alias("off"),
        F.substring(F.col("x"), w["a"] + 1, w["b"] - w["a"] + length).alias("x"),
    )
    met = texts.select("k", "u", F.encode(F.coalesce("t", F.lit("")), "UTF-8").alias("x")).join(wanted, ["k", "u"])
    pieces = met.select("k", "u", F.explode(F.transform("wanted", cut)).alias("w")).select("w.gram", "k", "u", "w.a", "w.kind", "w.off", "w.x")

    def spread(batches):
        """Segments of grams that have too many of them, cut; the others as they are."""
        for batch in batches:
            rows = _pieces(batch)
            many = rows["kind"] == 3
            if not many.all():
                yield _batch(_taken(rows, np.flatnonzero(~many)))
            if many.any():
                part = _taken(rows, np.flatnonzero(many))
                part["kind"] = np.full(len(part["k"]), 2)
                for _ in range(CUTS):
                    part = _cut_in_two(part, length, gram)
                part, later = _firsts(part, length)  # what the batch has more than once goes on once
                yield _batch(part)
                yield _passed(*_ranges(*later))

    def compare(batches):
        held, n, wait = [], 0, 4 * COLLECTION
        for batch in batches:
            rows = _pieces(batch)
            known = rows["kind"] == 1
            if known.any():
                yield _flags(*(rows[c][known] for c in ("k", "u", "a", "off")))
                rows = _taken(rows, np.flatnonzero(~known))
            held.append(rows)
            n += len(rows["gram"])
            if n > wait:
                rows = _joined(held)
                last = int(np.searchsorted(rows["gram"], rows["gram"][-1]))
                if last:
                    yield from flagged(_taken(rows, np.arange(last)))
                rows, later = _firsts(_taken(rows, np.arange(last, n)), length)
                yield _flags(*_ranges(*later))
                held, n = [rows], len(rows["gram"])
                wait = max(4 * COLLECTION, 2 * n)
        if n:
            yield from flagged(_joined(held))

    def flagged(rows):
        """Flags of copies, then of windows that a collection finds earlier."""
        rows, later = _firsts(rows, length)
        yield _flags(*_ranges(*later))
        rows = _taken(rows, np.flatnonzero(may_repeat(rows["x"], rows["at"], rows["gram"], rows["off"], length, gram)))
        if not len(rows["gram"]):
            return
        starts = np.flatnonzero(np.concatenate(([True], np.diff(rows["gram"]) != 0)))
        stops = np.append(starts[1:], len(rows["gram"]))
        first = 0
        for a, b in zip(starts.tolist(), stops.tolist()):
            if b - a > MOST:  # different segments, so their anchor isn't a whole window yet
                if a > first:
                    yield equal(_taken(rows, np.arange(first, a)))
                yield from flagged(_cut_in_two(_taken(rows, np.arange(a, b)), length, gram))
                first = b
            elif b - first >= COLLECTION or b == len(rows["gram"]):
                yield equal(_taken(rows, np.arange(first, b)))
                first = b
        if first < len(rows["gram"]):
            yield equal(_taken(rows, np.arange(first, len(rows["gram"]))))

    def equal(rows):
        """Flags windows that another row of the collection has earlier."""
        seg, left, common = collection(rows["x"], rows["at"])
        k, u, a = (rows[c] for c in ("k", "u", "a"))
        o = np.lexsort((u, k))
        rank = np.zeros(len(k), np.int64)
        rank[o] = np.cumsum(np.concatenate(([0], ((np.diff(k[o]) != 0) | (np.diff(u[o]) != 0)).astype(np.int64))))
        long = left >= length
        start = a[seg] + np.diff(rows["at"])[seg] - left
        place = (rank[seg] << 32) | start
        head = np.ones(len(seg), bool)
        head[1:] = ~((common[1:] >= length) & long[1:] & long[:-1])
        least = np.minimum.reduceat(place, np.flatnonzero(head))[np.cumsum(head) - 1]
        flag = long & (place > least)
        return _flags(*_ranges(k[seg[flag]], u[seg[flag]], start[flag], start[flag]))

    dealt = pieces.mapInArrow(spread, PIECE).repartition(F.col("gram")).sortWithinPartitions("gram")
    windows = scratch.write(dealt.mapInArrow(compare, "k long, u long, a int, b int"))
    flags = table.where("kind = 1").select("k", "u", "a", "b").union(windows)
    flags = flags.groupBy("k", "u").agg(F.collect_list(F.struct("a", "b")).alias("flags"))

    def strip(batches):
        for batch in batches:
            data, offsets = batch_bytes(batch.column(1))
            raw, kept, facts = data.tobytes(), [], []
            for i, marks in enumerate(batch.column(2).to_pylist()):
                o, at, out, spans, removed = int(offsets[i]), 0, [], 0, 0
                n, stop = int(offsets[i + 1]) - o, -1
                for a, b in sorted((m["a"], m["b"] + length) for m in marks or ()):
                    if a > stop:
                        out.append(raw[o + at : o + a])
                        spans, removed, at, stop = spans + 1, removed + b - a, b, b
                    elif b > stop:
                        removed, at, stop = removed + b - stop, b, b
                out.append(raw[o + at : o + n])
                kept.append(b"".join(out))
                facts.append((n, removed, spans))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), *(pa.array([f[q] for f in facts], pa.int64()) for q in range(3)),
                    pa.array(kept, pa.binary()),
                ],
                names=[key, "n_bytes", "n_removed", "n_spans", "kept"],
            )

    out = whole.join(flags, ["k", "u"], "left").select("key", "t", "flags")
    return out.mapInArrow(
        strip, f"`{key}` {dict(docs.dtypes)[key]}, n_bytes long, n_removed long, n_spans long, kept binary",
    )
