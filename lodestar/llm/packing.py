"""Packing by minimum bin slack.

Documents are cut into full windows and one remainder. Remainders only matter by length, so the packing is planned on a
histogram of at most ``window`` lengths, whatever the corpus: a bitset subset-sum picks the multiset of remaining
lengths that fills a window closest to its capacity, backtracking gives the counts, and the pattern is applied as
often as the counts allow. Slack that no multiset closes is filled by cutting one more remainder. The n-th remainder
of a length then finds its place in the plan; n is a prefix sum over the parts of a written table.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, bound_batches


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Counts of lengths, no more than there are, whose sum is as close below ``capacity`` as any: bitset subset-sum."""
    items: list[tuple[int, int]] = []
    for length in sorted(counts, reverse=True):
        left, k = min(counts[length], capacity // length if length else 0), 1
        while left > 0:
            take = min(k, left)
            items.append((length, take))
            left, k = left - take, 2 * k
    mask, reach, states = (1 << (capacity + 1)) - 1, 1, []
    for length, take in items:
        states.append(reach)
        reach |= (reach << (length * take)) & mask
        if reach >> capacity & 1:
            items = items[: len(states)]
            break
    at, used = reach.bit_length() - 1, defaultdict(int)
    for (length, take), before in zip(reversed(items), reversed(states)):
        if not before >> at & 1:
            used[length] += take
            at -= length * take
    return dict(used)


def plan(histogram: dict[int, int], window: int) -> tuple[dict, int]:
    """Where the remainders go: {(length, cut): sorted (first rank, end rank, size, first sequence, offset)}, sequences.

    A remainder of ``length`` with rank r starts at (length, 0); the entry that holds r says how many tokens lie at
    which offset of which sequence, and the rest goes on at (length, cut + size). Every sequence is full but for the
    last tokens of all, which go to sequences of powers of two, so no padding is needed.
    """
    runs: dict[int, list[list[int]]] = defaultdict(list)  # current length: [original length, cut, first rank, count]
    for length, n in sorted(histogram.items()):
        if n and length:
            runs[length].append([length, 0, 0, n])
    counts = {k: sum(r[3] for r in v) for k, v in runs.items()}
    places: dict[tuple[int, int], list[tuple[int, int, int, int, int]]] = defaultdict(list)
    sequence = 0

    def take(length: int, m: int, size: int, offset: int, first: int) -> None:
        """Put ``size`` tokens of ``m`` pieces of ``length`` at ``offset`` of the sequences from ``first`` on."""
        counts[length] -= m
        if not counts[length]:
            del counts[length]
        while m:
            original, cut, rank, n = run = runs[length][-1]
            k = min(m, n)
            places[original, cut].append((rank, rank + k, size, first, offset))
            if size < length:
                runs[length - size].append([original, cut + size, rank, k])
                counts[length - size] = counts.get(length - size, 0) + k
            run[2], run[3] = rank + k, n - k
            if not run[3]:
                runs[length].pop()
            m, first = m - k, first + k

    while counts:
        total = sum(k * n for k, n in counts.items())
        if total < window:
            size = 1 << (total.bit_length() - 1)  # the tail: powers of two
            offset = 0
            while offset < size:
                length = max(counts)
                part = min(length, size - offset)
                take(length, 1, part, offset, sequence)
                offset += part
            sequence += 1
            continue
        seed = max(counts)
        rest = {k: n - (k == seed) for k, n in counts.items() if n - (k == seed)}
        used = fill(rest, window - seed)
        used[seed] = used.get(seed, 0) + 1
        slack = window - sum(k * n for k, n in used.items())
        cut = 0
        if slack:  # every remainder that is left is longer than the slack
            cut = max((k for k in counts if k > slack and counts[k] > used.get(k, 0)), key=lambda k: (counts[k], k))
        need = dict(used)
        if cut:
            need[cut] = need.get(cut, 0) + 1
        m = min(counts[k] // n for k, n in need.items())
        offset = 0
        for length, n in sorted(used.items(), reverse=True):
            for _ in range(n):
                take(length, m, length, offset, sequence)
                offset += length
        if cut:
            take(cut, m, slack, offset, sequence)
        sequence += m
    return {k: sorted(v) for k, v in places.items()}, sequence


def encoder(path: str):
    """text -> ids of the tokenizer file at ``path``: a tokenizers JSON, or a rank file with the same split pattern."""
    if path.endswith(".tiktoken"):
        import base64

        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding(
            "ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)},
        )
        return lambda text: own.encode_to_numpy(text, allowed_special="all")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    return lambda text: np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)


def pack(
    docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Pieces of all rows in sequences of at most ``window`` tokens, without padding.

    Returns per piece ``key``, start, length, ids_crc32, doc_tokens, sequence_id, offset. Tokens of a row are the ids of
    its text and ``end_id``; null and empty texts are that one id. Rows that repeat a key are packed each. Equal
    lengths are interchangeable, so ties need no rule. Full windows are numbered after the planned sequences.
    """
    bound_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    kind = docs.select(key).schema[0].dataType.simpleString()

    def tokens(batches):
        encode, part, ranks, full = encoder(tokenizer), TaskContext.get().partitionId(), defaultdict(int), 0
        for batch in batches:
            out = {x: [] for x in ("n", "crcs", "full", "rest", "rank", "ids")}
            for t in batch.column(1):
                ids = np.append(encode(t.as_py() or ""), end_id).astype("<u4")
                k, rest = divmod(len(ids), window)
                out["n"].append(len(ids))
                out["crcs"].append(
                    np.array(
                        [zlib.crc32(ids[i * window : (i + 1) * window].tobytes()) for i in range(k)], "<u4",
                    ).tobytes()
                )
                out["full"].append(full)
                out["rest"].append(rest)
                out["rank"].append(ranks[rest])
                tail = ids[k * window :]
                out["ids"].append((tail.astype("<u2") if tail.max(initial=0) < 65536 else tail).tobytes())
                full += k
                ranks[rest] += 1
            n = len(out["n"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([part] * n, pa.int32()), pa.array(out["n"], pa.int64()),
                    pa.array(out["crcs"], pa.binary()), pa.array(out["full"], pa.int64()),
                    pa.array(out["rest"], pa.int32()), pa.array(out["rank"], pa.int64()),
                    pa.array(out["ids"], pa.binary()),
                ],
                names=["k", "part", "n", "crcs", "full", "rest", "rank", "ids"],
            )

    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    table = scratch.write(
        rows.mapInArrow(tokens, f"k {kind}, part int, n long, crcs binary, full long, rest int, rank long, ids binary")
    )
    cells = scratch.write(
        table.groupBy("part", "rest").agg(F.count("*").alias("c"), F.sum(F.floor(F.col("n") / window)).alias("fulls"))
    )
    places, sequences = plan(
        {r["rest"]: r["c"] for r in cells.groupBy("rest").agg(F.sum("c").alias("c")).collect()}, window,
    )
    earlier = lambda *by: Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cells.groupBy("part").agg(F.sum("fulls").alias("fulls"))
    bases = cells.select("part", "rest", F.coalesce(F.sum("c").over(earlier("rest")), F.lit(0)).alias("base"))
    bases = bases.join(
        parts.select("part", F.coalesce(F.sum("fulls").over(earlier()), F.lit(0)).alias("full_base")), "part",
    )
    lookup = {k: ([x[0] for x in v], v) for k, v in places.items()}

    def place(batches):
        for batch in batches:
            out = {x: [] for x in ("k", "start", "length", "crc", "n", "seq", "off")}
            cols = [
                batch.column(x).to_pylist() for x in (
                    "k", "n", "crcs", "full", "rest", "rank", "ids", "base", "full_base",
                )
            ]
            for k, n, crcs, full, rest, rank, ids, base, full_base in zip(*cols):
                for i, crc in enumerate(np.frombuffer(crcs, "<u4").tolist()):
                    for x, v in zip(out, (k, i * window, window, crc, n, sequences + full_base + full + i, 0)):
                        out[x].append(v)
                tail = np.frombuffer(ids, "<u2" if len(ids) == 2 * rest else "<u4").astype("<u4")
                r, cut = base + rank, 0
                while cut < rest:
                    firsts, entries = lookup[rest, cut]
                    a, _, size, seq, off = entries[bisect_right(firsts, r) - 1]
                    for x, v in zip(out, (k, n - rest + cut, size, zlib.crc32(tail[cut : cut + size].tobytes()), n, seq + r - a, off)):
                        out[x].append(v)
                    cut += size
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, batch.schema.field("k").type if x == "k" else pa.int64()) for x, v in out.items()],
                names=[key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return table.join(bases, ["part", "rest"]).mapInArrow(
        place,
        f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
