"""Fill-in-the-middle texts by ropes: a text is a balanced tree over slices of its bytes, rearranged by splits and joins.

A leaf is a slice that starts at a code point and caches how many units and code points start in it; an inner node
caches the sums. Cutting at a rank goes down one path and joins the pieces back into balanced trees, so a text is never
copied before its rearranged bytes are written once. Units are code points, or words with the space that follows them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .scratch import bound_batches
from .textbytes import NOT_SPACE, batch_bytes, slices, word_bounds

#: Bytes of a leaf.
LEAF = 1024
#: Marks of the prefix, the suffix and the middle (fixed values).
MARKS = ("<P>", "<S>", "<M>")
#: Order of the parts in each form.
ORDERS = {"psm": "PSM", "spm": "SPM"}


class Buffer:
    """Bytes that leaves refer to, and which of them start a code point and a unit."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit: str = "point"):
        self.data = data
        self.points = (data & 0xC0) != 0x80
        self.units = self.points
        if unit == "word":
            self.units = np.zeros(len(data), bool)
            self.units[word_bounds(NOT_SPACE[data], offsets)[0]] = True

    def ropes(self, offsets: np.ndarray) -> list:
        """A rope for each document, None for an empty one."""
        cuts, owner = [], []
        for d, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            more = range(a, b, LEAF)
            cuts.extend(more)
            owner.extend([d] * len(more))
        out: list = [None] * (len(offsets) - 1)
        if not cuts:
            return out
        at = np.array(cuts, np.int64)
        for _ in range(3):  # a leaf begins with a whole code point; a document's first byte begins one
            at -= ~self.points[at]
        units, points = (np.add.reduceat(x, at, dtype=np.int64).tolist() for x in (self.units, self.points))
        stops = np.append(at[1:], offsets[-1]).tolist()
        leaves = [Leaf(self, *x) for x in zip(at.tolist(), stops, units, points)]
        first = 0
        for i in range(1, len(owner) + 1):
            if i == len(owner) or owner[i] != owner[first]:
                out[owner[first]] = build(leaves, first, i)
                first = i
        return out


class Leaf:
    """Bytes a to b of a buffer."""

    __slots__ = ("buffer", "a", "b", "units", "points")
    height = 0

    def __init__(self, buffer: Buffer, a: int, b: int, units: int, points: int):
        self.buffer, self.a, self.b, self.units, self.points = buffer, a, b, units, points

    def cut(self, rank: int, by: str):
        """What comes before the unit (or code point) of that rank, and the rest."""
        at = self.a + int(np.flatnonzero(getattr(self.buffer, by)[self.a : self.b])[rank])
        if at == self.a:
            return None, self
        units, points = (int(np.count_nonzero(x[self.a : at])) for x in (self.buffer.units, self.buffer.points))
        return (
            Leaf(self.buffer, self.a, at, units, points),
            Leaf(self.buffer, at, self.b, self.units - units, self.points - points),
        )


class Node:
    __slots__ = ("left", "right", "units", "points", "height")

    def __init__(self, left, right):
        self.left, self.right = left, right
        self.units, self.points = left.units + right.units, left.points + right.points
        self.height = 1 + max(left.height, right.height)


def build(leaves: list, a: int, b: int):
    """A balanced tree over leaves a to b."""
    if b - a == 1:
        return leaves[a]
    mid = (a + b) // 2
    return Node(build(leaves, a, mid), build(leaves, mid, b))


def _level(left, right):
    """A node of two trees whose heights differ by two at most, turned so that they differ by one."""
    if left.height > right.height + 1:
        if left.left.height >= left.right.height:
            return Node(left.left, Node(left.right, right))
        return Node(Node(left.left, left.right.left), Node(left.right.right, right))
    if right.height > left.height + 1:
        if right.right.height >= right.left.height:
            return Node(Node(left, right.left), right.right)
        return Node(Node(left, right.left.left), Node(right.left.right, right.right))
    return Node(left, right)


def join(left, right):
    """One rope of two, of which either may be None."""
    if left is None or right is None:
        return right if left is None else left
    if left.height > right.height + 1:
        return _level(left.left, join(left.right, right))
    if right.height > left.height + 1:
        return _level(join(left, right.left), right.right)
    return Node(left, right)


def split(rope, rank: int, by: str = "units"):
    """The first ``rank`` units (or code points) with all bytes before the next one, and the rest."""
    if rope is None or rank <= 0:
        return None, rope
    return (rope, None) if rank >= getattr(rope, by) else _before(rope, rank, by)


def _before(rope, rank: int, by: str):
    """What comes before the unit number ``rank``, which the rope has, and the rest."""
    if isinstance(rope, Leaf):
        return rope.cut(rank, by)
    inside = getattr(rope.left, by)
    if rank < inside:
        a, b = _before(rope.left, rank, by)
        return a, join(b, rope.right)
    a, b = _before(rope.right, rank - inside, by)
    return join(rope.left, a), b


def leaves(rope):
    """The leaves from left to right."""
    stack = [rope] if rope is not None else []
    while stack:
        x = stack.pop()
        if isinstance(x, Leaf):
            yield x
        else:
            stack += (x.right, x.left)


def content(rope) -> bytes:
    return b"".join(x.buffer.data[x.a : x.b].tobytes() for x in leaves(rope))


def find(rope, mark: bytes) -> int:
    """Rank of the code point where ``mark`` (ASCII) begins, -1 if nowhere."""
    before, tail = 0, b""
    for x in leaves(rope):
        raw = tail + x.buffer.data[x.a : x.b].tobytes()
        at = raw.find(mark)
        if at >= 0:  # the tail's bytes that the mark holds are ASCII, one code point each
            return before + _points(raw[:at]) - _points(tail)
        before += x.points
        tail = raw[max(0, len(raw) - len(mark) + 1) :]
    return -1


def _points(raw: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))


def _sentinel(mark: str):
    data = np.frombuffer(mark.encode("ascii"), np.uint8)
    return Buffer(data, np.array([0, len(data)])).ropes(np.array([0, len(data)]))[0]


def rearranged(rope, first: int, second: int, form: str, marks=MARKS):
    """The rope of the form with its marks, and the code points of prefix and middle; cut after so many units."""
    rest, suffix = split(rope, second)
    prefix, middle = split(rest, first)
    parts = {"P": prefix, "S": suffix, "M": middle}
    out = None
    for k in ORDERS[form]:
        out = join(join(out, _sentinel(marks["PSM".index(k)])), parts[k])
    return out, prefix.points if prefix else 0, middle.points if middle else 0


def straightened(rope, form: str, marks=MARKS):
    """The rope of the text from a rearranged one: cut at each mark, put back in order."""
    parts = {}
    for k in reversed(ORDERS[form]):
        mark = marks["PSM".index(k)]
        rope, part = split(rope, find(rope, mark.encode()), "points")
        parts[k] = split(part, len(mark), "points")[1]
    return join(join(parts["P"], parts["M"]), parts["S"])


def _check(marks) -> None:
    """Marks must be found again whatever text surrounds them: none may begin with the end of another or of itself."""
    for a in marks:
        for b in marks:
            if not a.isascii() or not a or a != b and a in b or any(b.startswith(a[i:]) for i in range(1, len(a))):
                raise ValueError(f"marks {a!r} and {b!r} can be mistaken for each other")


def _texts(parts: list[bytes]) -> pa.Array:
    ends = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=ends[1:])
    return pa.Array.from_buffers(pa.string(), len(parts), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(parts))])


def transform(
    docs: DataFrame, key: str = "doc_id", text: str = "text", seed: str = "1", rate: int = 90, spm: int = 20,
    marks: tuple[str, str, str] = MARKS, unit: str = "point",
) -> DataFrame:
    """Every row's ``key``, n (code points), form, prefix_chars, middle_chars and output.

    The first four 8-digit groups of the hex SHA-256 of seed, colon and key are numbers h1 to h4. With u units, the
    prefix ends after the smaller of h1 % (u + 1) and h2 % (u + 1) of them, the middle after the larger. A text is plain
    if it is empty, holds a mark, or h3 % 100 >= ``rate``; else spm if h4 % 100 < ``spm``, else psm. ``unit`` is "point"
    or "word" (a word and the space after it; space before the first belongs to the part that holds the first unit). A map over rows without
    shuffle; memory is bounded by a batch of bytes or one text. A null text is empty, a null key is hashed as an empty
    one, rows that repeat a key and text give equal rows, an empty table gives none; other columns are not read.
    """
    _check(marks)
    bound_batches(docs.sparkSession)
    kind = docs.select(F.col(f"`{key}`")).schema[0].dataType.simpleString()
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256)
    raw = [m.encode() for m in marks]

    def one(rope, whole: bytes, digits: str):
        h1, h2, h3, h4 = (int(digits[8 * i : 8 * i + 8], 16) for i in range(4))
        if rope is None or h3 % 100 >= rate or any(m in whole for m in raw):
            return "plain", None, None, whole
        form = "spm" if h4 % 100 < spm else "psm"
        cuts = sorted((h1 % (rope.units + 1), h2 % (rope.units + 1)))
        out, prefix, middle = rearranged(rope, *cuts, form, marks)
        return form, prefix, middle, content(out)

    def run(batches):
        for batch in batches:
            data, offsets = batch_bytes(batch.column(2))
            for a, b in slices(offsets):
                at = offsets[a : b + 1] - offsets[a]
                low = data[offsets[a] : offsets[b]]
                ropes, whole = Buffer(low, at, unit).ropes(at), low.tobytes()
                digits = batch.column(1).slice(a, b - a).to_pylist()
                ends = at.tolist()
                got = [one(r, whole[ends[i] : ends[i + 1]], x) for i, (r, x) in enumerate(zip(ropes, digits))]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([r.points if r else 0 for r in ropes], pa.int64()),
                        pa.array([x[0] for x in got], pa.string()),
                        pa.array([x[1] for x in got], pa.int64()),
                        pa.array([x[2] for x in got], pa.int64()),
                        _texts([x[3] for x in got]),
                    ],
                    names=["k", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    rows = docs.select(F.col(f"`{key}`").alias("k"), h.alias("h"), F.col(f"`{text}`").cast("string").alias("t"))
    schema = f"k {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)


def restore(
    rows: DataFrame, output: str = "output", form: str = "form", name: str = "restored",
    marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """``rows`` with the text rebuilt from output and form alone, as column ``name``; null where the form is null.

    A null output counts as empty. A form other than plain whose marks are missing raises ValueError, and so does an
    unknown form. ``name`` must not be a column yet.
    """
    if name in rows.columns:
        raise ValueError(f"there is a column {name} already")
    bound_batches(rows.sparkSession)
    at_output, at_form = rows.columns.index(output), rows.columns.index(form)

    def one(rope, whole: bytes, kind):
        if kind is None or kind == "plain":
            return whole
        if kind not in ORDERS or any(m.encode() not in whole for m in marks):
            raise ValueError(f"no text of the form {kind}")
        return content(straightened(rope, kind, marks))

    def run(batches):
        for batch in batches:
            data, offsets = batch_bytes(batch.column(at_output))
            for a, b in slices(offsets):
                at = offsets[a : b + 1] - offsets[a]
                low = data[offsets[a] : offsets[b]]
                ropes, whole, part = Buffer(low, at).ropes(at), low.tobytes(), batch.slice(a, b - a)
                kinds, ends = part.column(at_form).to_pylist(), at.tolist()
                got = [one(r, whole[ends[i] : ends[i + 1]], x) for i, (r, x) in enumerate(zip(ropes, kinds))]
                yield pa.RecordBatch.from_arrays([*part.columns, _texts(got)], names=[*part.schema.names, name])

    schema = StructType([*rows.schema.fields, StructField(name, StringType())])
    out = rows.mapInArrow(run, schema)
    return out.withColumn(name, F.when(F.col(f"`{form}`").isNotNull(), F.col(name)))
