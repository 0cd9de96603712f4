"""Vectorised work on the UTF-8 bytes of a whole Arrow batch of texts.

A batch is one byte array with document offsets. Words, shingles and windows of any document are then ranges of that
array. The hash of a range is a sum over its 8-byte words, each mixed to 64 bits and multiplied by an odd constant of
its place: no power series, so no string family collides by its algebra.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: Odd constants of the places of a range, and of a second, independent hash; ranges of more words are digested whole.
PLACES = 64
_MULTIPLIERS = np.random.default_rng(20240229).integers(
    1, 1 << 63, (2, PLACES + 2), dtype=np.uint64,
) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply); a bijection, so it adds no collisions."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def batch_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n + 1 offsets, starting at 0. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[
        column.offset : column.offset + len(column) + 1
    ].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def slices(offsets: np.ndarray, limit: int = 4 << 20):
    """Row ranges of at most ``limit`` bytes each (one row at least): what is worked on at a time."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


#: Bytes worked on at a time: temporaries stay small and in the processor's cache, however long a text is.
AT_ONCE = 1 << 17


def blocks(n: int):
    """Ranges of AT_ONCE places."""
    for a in range(0, n, AT_ONCE):
        yield a, min(n, a + AT_ONCE)


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place on as one number (little-endian), zeros beyond the end."""
    x = data.astype(np.uint64)
    for width in (1, 2, 4):
        x[:-width] |= x[width:] << np.uint64(8 * width)
    return x


class RangeHash:
    """64-bit hashes of byte ranges [s, e) of one buffer; ``salt`` 0 or 1 picks one of two independent ones."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.words = np.empty(len(data), np.uint64)
        for a, b in blocks(len(data)):
            self.words[a:b] = mix(eight_bytes(data[a : b + 7])[: b - a])

    def fixed(self, length: int) -> np.ndarray:
        """Hashes of every range of ``length`` bytes, a multiple of 8."""
        out = np.empty(max(len(self.data) - length + 1, 0), np.uint64)
        for a, b in blocks(len(out)):
            x = np.full(b - a, length, np.uint64) * _MULTIPLIERS[0, PLACES]
            for j in range(length // 8):
                x += self.words[a + 8 * j : b + 8 * j] * _MULTIPLIERS[0, j]
            out[a:b] = mix(x)
        return out

    def __call__(self, s: np.ndarray, e: np.ndarray, salt: int = 0) -> np.ndarray:
        size = e - s
        by = _MULTIPLIERS[salt]
        out = size.astype(np.uint64) * by[PLACES]
        live = np.flatnonzero((size >= 8) & (size <= 8 * PLACES))
        for j in range(PLACES):
            live = live[size[live] >= 8 * j + 8]
            if not len(live):
                break
            out[live] += self.words[s[live] + 8 * j] * by[j]
        last = np.flatnonzero((size & 7 > 0) & (size <= 8 * PLACES))
        if len(last):  # the last 8 bytes, or all of a shorter range
            r, stop = np.minimum(size[last], 8), e[last]
            w = np.zeros(len(last), np.uint64)
            for k in range(1, 9):
                w = (w << np.uint64(8)) | np.where(r >= k, self.data[np.maximum(stop - k, 0)], 0).astype(np.uint64)
            out[last] += mix(w) * by[PLACES + 1]
        out = mix(out)
        for i in np.flatnonzero(size > 8 * PLACES).tolist():
            digest = hashlib.blake2b(self.data[s[i] : e[i]], digest_size=8, salt=bytes([salt])).digest()
            out[i] = np.frombuffer(digest, np.uint64)[0]
        return out


def word_bounds(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` that don't cross documents, and each document's first run."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    head = np.zeros(n + 1, bool)
    head[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | head[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | head[1:n]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


#: An odd multiplier between the words of a short text.
PAIR = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that separate words: space and 0x09 to 0x0D (fixed values).
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Each document's distinct hashes of ``size`` consecutive lower-cased words, sorted; all words as one if fewer."""
    low = LOWER[data]
    s, e, first = word_bounds(NOT_SPACE[low], offsets)
    h = RangeHash(low)(s, e)
    roll = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        roll += mix(h[k : len(h) - size + 1 + k] + np.uint64(k + 1)) * np.uint64(2 * k + 3) if len(roll) else roll
    roll = mix(roll)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            x = np.sort(roll[a : b - size + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif b > a:
            x = np.array([b - a], np.uint64)
            for k in range(a, b):
                x = mix(x * PAIR + h[k : k + 1])
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
