"""License scans: exact phrase places, and bounded-error search for short notices around pigeonhole seeds."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bound_batches
from .textbytes import LOWER, batch_bytes, slices, word_bounds

#: Phrase: label (fixed values of the query's contract).
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
  #: Notices of the fuzzy search: notice, label, most edits. What stands before ``~`` must be exact: an edit of a short word
#: is another word ("emit", "kit").
NOTICES = [
    ("gnu general public license", "gpl", 3),
    ("gnu lesser general public license", "lgpl", 3),
    ("apache license", "apache", 1),
    ("mit~ license", "mit", 1),
    ("mozilla public license", "mpl", 2),
    ("creative commons attribution", "cc-by", 2),
    ("permission is hereby granted, free of charge", "mit", 4),
    ("redistribution and use in source and binary forms", "bsd", 4),
]
#: Bytes of words after lower-casing: all but 0x00-0x2F, 0x3A-0x60 and 0x7B-0x7F (fixed values).
IN_WORD = np.ones(256, bool)
IN_WORD[0x00:0x30] = IN_WORD[0x3A:0x61] = IN_WORD[0x7B:0x80] = False
GAP = rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
EDGES = b"(?<![0-9a-z\\x80-\\xff])%s(?![0-9a-z\\x80-\\xff])"
#: Most that a document without an exact place scores.
FUZZY = 0.99


def pieces(notice: bytes, edits: int) -> list[tuple[int, bytes]]:
    """``edits`` + 1 disjoint pieces with their places: an occurrence with that many edits leaves one of them whole."""
    cuts = [round(i * len(notice) / (edits + 1)) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    def __init__(self, phrases: dict[str, str], notices: Iterable[tuple[str, str, int]]):
        words = lambda p: [re.escape(w.encode()) for w in p.split()]
        self.phrases = [(re.compile(GAP.join(words(p))), label) for p, label in phrases.items()]
        self.seeds = []
        for notice, label, edits in notices:
            exact, _, loose = notice.rpartition("~")
            n = (exact + loose).encode()
            literal = lambda t: regex.escape(t.encode(), literal_spaces=True)
            pattern = EDGES % (b"%s(?:%s){e<=%d}" % (literal(exact), literal(loose), edits))
            self.seeds.append((n, label, edits, pieces(n, edits), regex.compile(b"(?b)" + pattern)))

    def places(self, low: bytes, ends: np.ndarray):
        """(start, end, document, label) of every place where a phrase's words stand consecutively."""
        for pattern, label in self.phrases:
            at = 0
            while m := pattern.search(low, at):
                s, e = m.span()
                doc = int(np.searchsorted(ends, s, "right"))
                a = int(ends[doc - 1]) if doc else 0
                if e <= ends[doc] and (s == a or not IN_WORD[low[s - 1]]) and (e == ends[doc] or not IN_WORD[low[e]]):
                    yield s, e, doc, label
                at = s + 1

    def fuzzy(self, low: bytes, ends: np.ndarray):
        """(start, end, document, label, edits) of the best matches of whole words around seeds, none overlapping another
        of its notice."""
        for notice, label, edits, parts, pattern in self.seeds:
            found = set()
            for guess in sorted({(p - off) for off, piece in parts for p in _all(low, piece)}):
                near = min(max(guess, 0), len(low) - 1)
                doc = int(np.searchsorted(ends, near, "right"))
                for d in {doc, min(doc + 1, len(ends) - 1)}:
                    a, b = (int(ends[d - 1]) if d else 0), int(ends[d])
                    # a byte more on either side shows whether a word goes on there
                    s, e = max(a, guess - edits - 1), min(b, guess + len(notice) + edits + 1)
                    if e - s < len(notice) - edits:
                        continue
                    around = low[s:e]
                    # from every word's edge: a search would never begin with an inserted byte
                    for at in range(max(a, guess - edits), min(b, guess + edits + 1)):
                        if at == a or not IN_WORD[low[at - 1]]:
                            m = pattern.match(around, at - s)
                            if m and (m.end() < e - s or e == b):
                                found.add((sum(m.fuzzy_counts), at, s + m.end(), d))
            taken: list[tuple[int, int]] = []
            for n, s, e, d in sorted(found):
                at = bisect_left(taken, (s, e))
                if (not at or taken[at - 1][1] <= s) and (at == len(taken) or taken[at][0] >= e):
                    taken.insert(at, (s, e))
                    yield s, e, d, label, n


def _all(low: bytes, piece: bytes):
    at = low.find(piece)
    while at >= 0:
        yield at
        at = low.find(piece, at + 1)


def scan_licenses(
    docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: list[tuple[str, str, int]] = NOTICES,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Every row's ``key``, n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    ``spans`` lists (start, end, label, edits) in bytes of the lower-cased text, exact places first. Notices match whole
    words; of matches of a notice that overlap the one with the fewest edits counts. ``score`` is 1 with an exact place of
    a phrase, else FUZZY times the share of the best notice's bytes that match, else 0. A map over rows: no shuffle, and
    memory bounded by a batch of bytes. Null and empty texts have no words and empty labels; repeated rows are scanned
    each; an empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    schema = "k %s, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<s:long,e:long,label:string,edits:int>>" % docs.select(key).schema[0].dataType.simpleString()

    def run(batches):
        scanner = Scanner(phrases, notices)
        for batch in batches:
            data, offsets = batch_bytes(batch.column(1))
            for a, b in slices(offsets):
                yield one(
                    scanner, batch.column(0).slice(a, b - a), LOWER[data[offsets[a] : offsets[b]]],
                    offsets[a : b + 1] - offsets[a],
                )

    def one(scanner, keys, low, offsets):
        starts, _, first = word_bounds(IN_WORD[low], offsets)
        raw, n = low.tobytes(), len(offsets) - 1
        ends = offsets[1:]
        found: dict[int, dict] = {}
        for s, e, d, label in scanner.places(raw, ends):
            x = found.setdefault(d, {"at": [], "base": set(), "all": set(), "score": 1.0, "spans": []})
            x["at"].append(int(np.searchsorted(starts, s)) - int(first[d]))
            x["base"].add(label)
            x["all"].add(label)
            x["spans"].append({"s": s - int(offsets[d]), "e": e - int(offsets[d]), "label": label, "edits": 0})
        for s, e, d, label, edits in scanner.fuzzy(raw, ends):
            x = found.setdefault(d, {"at": [], "base": set(), "all": set(), "score": 0.0, "spans": []})
            x["all"].add(label)
            x["score"] = max(x["score"], FUZZY * (1.0 - edits / max(1, e - s)))
            x["spans"].append({"s": s - int(offsets[d]), "e": e - int(offsets[d]), "label": label, "edits": edits})
        get = lambda f, none: [f(found[d]) if d in found else none for d in range(n)]
        return pa.RecordBatch.from_arrays(
            [
                keys,
                pa.array(np.diff(first), pa.int64()),
                pa.array(get(lambda x: len(x["at"]), 0), pa.int64()),
                pa.array(get(lambda x: min(x["at"], default=None), None), pa.int64()),
                pa.array(get(lambda x: max(x["at"], default=None), None), pa.int64()),
                pa.array(get(lambda x: ",".join(sorted(x["base"])), ""), pa.string()),
                pa.array(get(lambda x: ",".join(sorted(x["all"])), ""), pa.string()),
                pa.array(get(lambda x: x["score"], 0.0), pa.float64()),
                pa.array(
                    get(lambda x: x["spans"], []),
                    pa.list_(
                        pa.struct([("s", pa.int64()), ("e", pa.int64()), ("label", pa.string()), ("edits", pa.int32())])
                    ),
                ),
            ],
            names=["k", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
        )

    return docs.select(
        F.col(key).alias("k"), F.col(text).cast("string").alias("t"),
    ).mapInArrow(run, schema).withColumnRenamed("k", key)
