"""The corpus pipeline, stage by stage, against brute force on small tables, and its stages on odd ones."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from lodestar.llm import packing, quality
from lodestar.llm.scratch import Scratch
from test_pair_ops import groups_of, shingles

LABELS = "doc_id long, quality int, toxic int"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def corpus():
    """Clean prose, junk, copies exact and near, passages that repeat, odd texts; sources of unequal size."""
    rng = random.Random(11)
    passage = prose(rng, 70)
    rows = [(i, prose(rng, rng.randrange(40, 160))) for i in range(120)]
    rows += [(200 + i, " ".join([prose(rng, 1)] * 60) + " !! $$$ ||") for i in range(60)]
    for i in range(20):
        words = rows[i][1].split()
        words[3:4] = [] if i % 2 else ["inserted"]
        rows.append((300 + i, " ".join(words)))
        rows.append((340 + i, rows[i][1]))
    rows += [(400 + i, prose(rng, 60) + " " + passage + " " + prose(rng, 60)) for i in range(10)]
    rows += [(500, None), (501, ""), (502, " \n"), (503, prose(rng, 9000)), (7, rows[7][1])]
    sources = {i: rng.choice(["a", "a", "a", "b", None]) for i, _ in rows}
    labels = [(i, int(i < 200), 0) for i, _ in rows if i < 260 and i % 3]
    return [(i, t, "en", s, None if t is None else len(t)) for i, t in rows for s in [sources[i]]], labels


def accepted(rows, labels):
    x = {r: quality.statistics(np.frombuffer((r[1] or "").encode(), np.uint8), np.array([0, len((r[1] or "").encode())]))[0] for r in set(rows)}
    train = {i: y for i, y, _ in labels if zlib.crc32(str(i).encode()) % 4 != 2}
    known = [(x[r], train[r[0]]) for r in rows if r[0] in train]
    center = np.mean([v for v, _ in known], axis=0)

    def drawn(v):
        w = math.expm1(v[0])
        return np.concatenate((v[:1], center[1:] + (v[1:] - center[1:]) * w / (w + quality.PRIOR_WORDS)))

    sides = [np.array([drawn(v) for v, y in known if y == side]) for side in (0, 1)]
    d, scatter = len(center), [np.cov(s.T, bias=True) for s in sides]
    pooled = sum(len(s) * c for s, c in zip(sides, scatter)) / len(known)
    density = []
    for s, c in zip(sides, scatter):
        w = 0.15 + 0.85 * d / (d + len(s))
        c = (1 - w) * c + w * pooled
        c = 0.9 * c + 0.1 * np.diag(np.maximum(np.diag(c), 1e-4)) + 1e-6 * np.eye(d)
        inverse, det = np.linalg.inv(c), np.linalg.slogdet(c)[1]
        density.append(lambda v, m=s.mean(axis=0), inverse=inverse, det=det, n=len(s): math.log(n) - det / 2 - (v - m) @ inverse @ (v - m) / 2)
    odds = {r: density[1](drawn(v)) - density[0](drawn(v)) for r, v in x.items()}
    return [r for r in rows if odds[r] >= math.log(0.7 / 0.3)]


def one_each(rows):
    sets = {r[0]: shingles(r[1], 5) for r in rows}
    ids = list(sets)
    low = groups_of(ids, [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])])
    return [r for r in dict.fromkeys(rows) if low[r[0]] == r[0]]


def without_repeats(rows):
    """Runs of 128 bytes or more of whole characters, all of whose bytes lie in 32 bytes that occur earlier."""
    seen, left = set(), {}
    for r in sorted(set(rows), key=lambda r: r[0]):
        data = (r[1] or "").encode()
        mark = bytearray(len(data))
        for a in range(len(data) - 31):
            if data[a : a + 32] in seen:
                mark[a : a + 32] = b"\1" * 32
            seen.add(data[a : a + 32])
        kept = bytearray(data)
        for m in reversed(list(re.finditer(b"\1+", bytes(mark)))):
            a, b = m.span()
            while a < b and data[a] & 0xC0 == 0x80:
                a += 1
            while a < b < len(data) and data[b] & 0xC0 == 0x80:
                b -= 1
            if b - a >= 128:
                del kept[a:b]
        left[r] = None if r[1] is None else kept.decode()
    return [(r[0], left[r], *r[2:]) for r in rows]


def mixed(rows):
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total = {s: sum(size[r[0]] for r in by[s]) for s in order}
    target, free = {}, set(order)
    while True:
        room = sum(total.values()) - sum(target.values())
        over = {s for s in free if weight[s] * room / sum(weight[x] for x in free) > 3 * total[s]}
        if not over:
            break
        target |= {s: 3 * total[s] for s in over}
        free -= over
    target |= {s: weight[s] * room / sum(weight[x] for x in free) for s in free}
    out = []
    for s in order:
        whole = int(target[s] // total[s]) if total[s] else 0
        extra = math.floor(target[s] + 0.5) - whole * total[s]
        for r in sorted(by[s], key=lambda r: hashlib.md5(f"mix-1|{r[0]}|{hashlib.md5((r[1] or '').encode()).hexdigest()}".encode()).hexdigest()):
            n = size[r[0]]
            out += [r] * (whole + (extra > 0) if n else 1)
            extra -= n
    return out


def test_stages_against_brute_force(spark, tmp_path):
    rows, labels = corpus()
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kind).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    docs, scratch, want = spark.read.parquet(f"{tmp_path}/documents.parquet"), Scratch(spark), rows
    steps = [lambda r: accepted(r, labels), one_each, without_repeats, mixed]
    assert len(corpus_pipeline.STAGES) == len(steps) + 1
    for (name, stage), brute in zip(corpus_pipeline.STAGES, steps):
        docs = scratch.write(stage(spark, docs, str(tmp_path)))
        before, want = want, brute(want)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        got = list(map(tuple, docs.collect()))
        if brute is without_repeats:  # what equals the first text with a window may end some bytes before what equals any
            assert Counter(r[:1] + r[2:] for r in got) == Counter(r[:1] + r[2:] for r in want), name
            most = {r[0]: r[1] for r in want}
            for r in got:
                rest = iter(r[1] or "")
                assert all(c in rest for c in most[r[0]] or "") and len(r[1] or "") <= len(most[r[0]] or "") + 8, r[0]
            want = got
        assert Counter(got) == Counter(want), name
        assert Counter(want) != Counter(before), name
    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r[0]: np.append(encode(r[1] or ""), 0).astype("<u4") for r in want}
    copies = Counter(r[0] for r in want)
    covered, sequences = Counter(), defaultdict(list)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes()) and p.doc_tokens == len(ids[p.doc_id])
        covered.update((p.doc_id, i) for i in range(p.start, p.start + p.length))
        sequences[p.sequence_id].append((p.offset, p.length))
    assert covered == Counter({(d, i): n for d, n in copies.items() for i in range(len(ids[d]))})
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024 and at & (at - 1) == 0


@pytest.mark.parametrize("n", [0, 1, 40])
def test_stages_take_odd_rows_and_clashing_columns(spark, tmp_path, n):
    """Nulls in any column, repeated rows, no rows, and columns named like those that operators use inside."""
    rng = random.Random(n)
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, n, 2)] + [(None, None, None)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    extra = ["k", "_k", "row", "t", "size", "_times", "_key", "_copy", "_n", "h", "marks", "times", "copy", "node"]
    rows = [(None if i == 7 else i, None if i % 9 == 8 else prose(rng, 30), None, None if i % 3 else "s", None, *[f"{c}{i}" for c in extra]) for i in range(n)]
    rows += rows[:3]
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    docs = spark.createDataFrame(rows, kind)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        for r in out.collect():
            assert r.doc_id is None or [r[c] for c in extra] == [f"{c}{r.doc_id}" for c in extra]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert sum(p.start == 0 for p in packed.collect()) == len(rows)
