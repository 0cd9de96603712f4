"""Brute-force comparisons for the Jaccard join, embeddings, suffix order and components."""

import random
import re

import numpy as np
import pytest

from lodestar.llm import chunks, components, hnsw, ngramjoin, suffixes
from lodestar.llm.scratch import Scratch


def groups_of(ids, links):
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def shingles(t, w):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + w]) for i in range(len(words) - w + 1)) if len(words) >= w else frozenset([tuple(words)])


def near_rows(rng, bases, copies, vocabulary, edits):
    rows, i = [], 0
    for _ in range(bases):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 8, 12, 20, 45, 90, 200]))]
        for _ in range(rng.randrange(1, copies)):
            words = list(base)
            for _ in range(rng.randrange(0, edits)):
                p = rng.randrange(len(words))
                words[p : p + 1] = rng.choice([[], [rng.choice(vocabulary)], [words[p], rng.choice(vocabulary)]]) or words[p : p + 1]
            rows.append((i, (" " if i % 3 else "\n").join(words).upper() if i % 5 == 0 else " ".join(words)))
            i += 1
    return rows + [(9000, None), (9001, ""), (9002, " \t"), (3, rows[3][1]), (9003, "x " * 4000), (9004, "x " * 4001)]


@pytest.mark.parametrize("words,num,den,rows,block", [(3, 90, 100, None, 1000), (5, 8, 10, None, 3), (3, 8, 10, 10**12, 1000), (2, 6, 10, 10**12, 2), (3, 95, 100, 10**12, 1000)])
def test_jaccard_against_all_pairs(docs_of, monkeypatch, words, num, den, rows, block):
    monkeypatch.setattr(ngramjoin, "BLOCK_NODES", block)
    rng = random.Random(words * num)
    data = near_rows(rng, 25, 14, [f"w{i}" for i in range(400)], 8)
    sets = {i: shingles(t, words) for i, t in data}
    ids = list(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = groups_of(ids, links)
    got = ngramjoin.jaccard_components(docs_of(data), words=words, num=num, den=den, rows=rows).collect()
    assert len(got) == len(data)
    for r in got:
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id]), r


def test_jaccard_tiles_of_a_large_group(docs_of, monkeypatch):
    monkeypatch.setattr(ngramjoin, "BLOCK_NODES", 7)
    rng = random.Random(4)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for p in rng.sample(range(120), rng.randrange(0, 6)):
            words[p] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    sets = {i: shingles(t, 3) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    assert {r.doc_id: r.component_id for r in ngramjoin.jaccard_components(docs_of(rows), words=3, num=90, den=100).collect()} == groups_of(sets, links)


def test_allocation_prefers_deletions_only_where_they_pay():
    few, many = ngramjoin.Scheme(90, 100, 1000), ngramjoin.Scheme(90, 100, 10**13)
    band = few.bands(300)[0]
    assert few.part(band)[1] == 0 and many.part(band)[1] > 0
    for scheme in (few, many):
        ones, twos, spare = scheme.part(band)
        assert ones + 2 * twos > spare + (scheme.low[band + 1] - 1 + scheme.top(band)) * 10 // 190


def test_keep_one_each(docs_of):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(5, text), (2, text), (2, text), (7, text + " more"), (8, None), (9, "other words here"), (None, "a b c d e f")]
    out = ngramjoin.keep_one_each(docs_of(rows), words=5, num=8, den=10)
    assert out.columns == docs_of(rows).columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["2", "8", "9", "None"]
    assert ngramjoin.keep_one_each(docs_of([])).count() == 0


def test_components_of_a_chain_a_hub_and_pairs(spark):
    links = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 4999), (5000, 5000)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()}
    assert got == groups_of({x for p in links for x in p}, links)
    assert components.components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def vectors(rng, n, dim=16):
    out = []
    for i in range(n):
        if i % 3 == 0 or i < 10:
            out.append(rng.normal(size=dim))
        else:
            out.append(out[int(rng.integers(0, i))] + rng.normal(size=dim) * rng.choice([0, 0.05, 0.2]))
    return out


@pytest.mark.parametrize("shard", [8192, 120])
def test_near_duplicates_against_all_pairs(spark, shard):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.float32(v)], int(i % 2)) for i, v in enumerate(vectors(rng, 500))]
    rows += [(600, rows[3][1], 1), (601, rows[3][1], 0), (601, rows[3][1], 0), (602, None, 1), (603, [0.0] * 16, 1), (604, [float("nan")] * 16, 1), (605, [None] * 16, 0), (606, rows[3][1], None), (607, [float("inf")] * 16, 0), (608, [1.0, 0.0], 1), (609, [2.0, 0.0], 1), (610, [], 1)]
    got = {r.vec_id: r for r in hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), shard=shard).collect()}
    ok = {i: (np.array(v, float), g) for i, v, g in rows if v and None not in v and np.isfinite(v).all() and any(v) and g is not None}
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    ids = sorted(ok)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and cos(ok[a][0], ok[b][0]) >= 0.98]
    want = groups_of({i for i, _, _ in rows}, links)
    n = {i: 0 for i in want}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    assert len(links) > 100
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (n[i], want[i], want[i] == i) for i in want}


def test_graph_recall_with_beams_alone():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(3000, 32)).astype(np.float32)
    v[1500:] = v[:1500] + 0.05 * rng.normal(size=(1500, 32)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph = hnsw.Graph.build(v)
    _, _, (q, n) = graph.search(v, 32, radius=0.97)
    want = set(zip(*map(np.ndarray.tolist, np.nonzero(v @ v.T >= 0.97))))
    assert len(want) > 4500 and len(want & set(zip(q.tolist(), n.tolist()))) >= 0.97 * len(want)


def test_near_duplicates_empty(spark):
    assert hnsw.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_collection_order_and_common_prefixes(seed):
    rng = random.Random(seed)
    for _ in range(15):
        segments = [bytes(rng.choice(b"ab\x00\xf4") for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 12))]
        data = np.frombuffer(b"".join(segments), np.uint8)
        seg, left, common = suffixes.collection(data, np.concatenate(([0], np.cumsum([len(x) for x in segments]))))
        got = [segments[a][len(segments[a]) - b :] for a, b in zip(seg, left)]
        assert got == sorted(x[i:] for x in segments for i in range(len(x)))
        for i in range(1, len(got)):
            k = 0
            while k < min(len(got[i]), len(got[i - 1])) and got[i][k] == got[i - 1][k]:
                k += 1
            assert common[i] == k


def removed(rows, length):
    seen, marks = {}, {}
    order = sorted({(i is None, i or 0, t or "") for i, t in rows})
    for none, i, t in order:
        b = t.encode()
        mark = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                mark[s : s + length] = b"\1" * length
            else:
                seen[w] = 1
        marks[None if none else i, t] = mark
    return marks


@pytest.mark.parametrize("most,cuts,together,long", [(500, 2, 1000, 1 << 21), (3, 2, 4, 1000), (1, 0, 1, 1 << 21), (2, 9, 5, 1 << 21)])
def test_remove_repeats_against_all_windows(docs_of, monkeypatch, most, cuts, together, long):
    for name, value in (("MOST", most), ("CUTS", cuts), ("COLLECTION", together), ("LONG", long)):
        monkeypatch.setattr(suffixes, name, value)
    rng = random.Random(9)
    prose = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = [prose(n) for n in (30, 60, 100, 101, 150, 400)]
    rows = []
    for i in range(150):
        rows.append((i, "".join(rng.choice([prose(rng.randrange(0, 90)), rng.choice(shared), rng.choice(shared)[rng.randrange(30) :]]) for _ in range(rng.randrange(0, 6)))))
    rows += [(200, rows[7][1]), (200, rows[7][1]), (201, None), (202, ""), (203, "z" * 3000), (204, "ab" * 700), (None, shared[5]), (205, "y" * 99), (206, "q" * 100), (207, "q" * 101)]
    base = prose(300)
    for i in range(70):  # near copies: most anchors have many different segments
        at = rng.randrange(300)
        rows.append((300 + i, base[:at] + prose(rng.randrange(0, 3)) + base[at + 1 :]))
    rng.shuffle(rows)
    marks = removed(rows, 60)
    got = suffixes.remove_repeats(docs_of(rows), length=60, gram=20).collect()
    assert len(got) == len(rows)
    by_id = {i: t or "" for i, t in rows}
    for r in got:
        t = by_id[r.doc_id].encode()
        mark = marks[r.doc_id, by_id[r.doc_id]]
        kept = bytes(b for b, m in zip(t, mark) if not m)
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (len(t), sum(mark), len(re.findall(b"\1+", bytes(mark))), kept), r.doc_id


def test_remove_repeats_empty(docs_of):
    assert suffixes.remove_repeats(docs_of([])).count() == 0


def test_keep_one_each_judges_rows_by_their_own_text(docs_of):
    """Null ids are separate rows, and of rows that repeat an id each stays or goes by its own text."""
    rng = random.Random(8)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    base, alone, other = text(), text(), text()
    near = " ".join(base.split()[:-1] + ["changed"])
    nulls = [(None, text()) for _ in range(8)]
    rows = [(3, base), (7, near), (7, alone), (8, other), (8, text()), (None, near), *nulls, (None, nulls[0][1]), (None, None), (None, ""), (9, ""), (9, " ")]
    got = ngramjoin.keep_one_each(docs_of(rows), words=5, num=8, den=10)
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, [(3, base), (7, alone), *rows[3:5], *nulls, *rows[-4:]]))


def test_jaccard_groups_whose_centre_links_few(docs_of, monkeypatch):
    """Rings of texts: neighbours are linked, others only share a signature; tiles are small, so most nodes stand apart."""
    monkeypatch.setattr(ngramjoin, "BLOCK_NODES", 4)
    rng = random.Random(6)
    ring = [f"r{i}" for i in range(400)]
    rows = [(i, " ".join((ring + ring)[4 * i : 4 * i + 60 + rng.randrange(3)])) for i in range(100)]
    sets = {i: shingles(t, 3) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 9 * len(sets[a] | sets[b])]
    extra = [(200 + i, " ".join(ring[4 * i : 4 * i + 59])) for i in range(0, 80, 9)]
    sets |= {i: shingles(t, 3) for i, t in extra}
    links = [(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in ngramjoin.jaccard_components(docs_of(rows + extra), words=3, num=8, den=10).collect()}
    assert got == groups_of(sets, links)


THUE = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))


def test_texts_made_to_collide_in_power_sums_stay_apart(docs_of):
    """A Thue-Morse string and its opposite collide in every polynomial hash modulo 2**64."""
    flip = THUE.translate(str.maketrans("ab", "ba"))
    rows = [(1, THUE), (2, flip), (3, THUE[:1024]), (4, flip[:1024]), (5, THUE[:1024])]
    got = {r.doc_id: r.component_id for r in ngramjoin.jaccard_components(docs_of(rows), words=3, num=90, den=100).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3}
    marks = removed(rows, 100)
    for r in suffixes.remove_repeats(docs_of(rows), length=100).collect():
        assert r.n_removed == sum(marks[r.doc_id, dict(rows)[r.doc_id]])
    for r in chunks.dedup_chunks(docs_of(rows)).collect():
        seen = b"\0".join(t.encode() for i, t in rows if i < r.doc_id)
        text = dict(rows)[r.doc_id].encode()
        assert r.n_removed <= sum(any(text[max(0, i - j) : i - j + 32] in seen or text[max(0, i - j) : i - j + 32] in text[: i] for j in range(32)) for i in range(len(text)))


@pytest.mark.parametrize("kind", ["string", "long"])
def test_keys_of_any_kind_and_the_largest_number(spark, kind):
    """String keys order as strings; the largest number isn't taken for a null key."""
    rng = random.Random(12)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    a, b, c = text(), text(), text()
    ids = ["doc-1", "doc-10", "doc-2", "x"] if kind == "string" else [1, 10, 20, 2**63 - 1]
    rows = [(ids[1], a), (ids[0], b), (ids[2], a), (ids[3], c), (None, c), (None, b), (ids[3], b)]
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3)
    key = lambda x: (x is None, x or 0)
    want = sorted(((i, min((j for j, u in rows if u == t), key=key)) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.component_id) for r in ngramjoin.jaccard_components(df, words=3, num=90, den=100).collect()), key=str) == want
    kept = sorted(((r.doc_id, r.text) for r in ngramjoin.keep_one_each(df).collect()), key=str)
    assert kept == sorted([(ids[1], a), (ids[0], b), (ids[3], c)], key=str)
    for out in (chunks.dedup_chunks(df), suffixes.remove_repeats(df)):
        n = {(r.doc_id, r.n_bytes - r.n_removed) for r in out.collect()}
        assert {i for i, left in n if left} == {ids[1], ids[0], ids[3]} and (None, 0) in n and len(n) == 6


@pytest.mark.parametrize("spread", [0.05, 0.0])
def test_near_pairs_of_large_shards_by_audited_beams(spread):
    """Shards of 6000: the beams are audited and meet nearly all links, without scans where links are few."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(12000, 32)).astype(np.float32)
    v[6000:] = v[:6000] + rng.normal(size=(6000, 32)).astype(np.float32) * 0.05
    if not spread:  # links of few vectors only
        v[6200:] = rng.normal(size=(5800, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph = hnsw.Graph.build(v[:6000])
    q, n, (audited, met, scanned) = hnsw.near_pairs(graph, v[6000:], 0.98)
    want = set(zip(*map(np.ndarray.tolist, np.nonzero(v[6000:] @ v[:6000].T >= 0.98))))
    got = set(zip(q.tolist(), n.tolist()))
    assert got <= want and len(want) >= 150 and len(got) >= 0.97 * len(want)
    assert met >= 0.99 * audited > 0 and scanned < 1500


def test_near_pairs_widen_full_beams_and_scan_where_audits_fail():
    rng = np.random.default_rng(4)
    v = np.repeat(rng.normal(size=(4, 16)), 300, axis=0).astype(np.float32) + 0.01 * rng.normal(size=(1200, 16)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    q, n, facts = hnsw.near_pairs(hnsw.Graph.build(v), v, 0.98)
    assert set(zip(q.tolist(), n.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(v @ v.T >= 0.98)))) and facts[2] == 1200


def test_near_duplicates_of_string_keys_repeated_keys_and_clashing_columns(spark):
    rows = [("b", [1.0, 0.0], "en", 1, 2), ("b", [1.0, 0.01], "en", 1, 2), ("a", [0.0, 1.0], "en", 1, 2), ("c", [0.0, 2.0], "de", 1, 2), ("d", [0.001, 5.0], "en", 1, 2), ("d", [0.001, 5.0], "en", 1, 2), (None, [1.0, 0.0], "en", 1, 2)]
    audits = []
    df = spark.createDataFrame(rows, "vec_id string, embedding array<float>, label string, h int, rows int")
    got = sorted(map(str, map(tuple, hnsw.near_duplicates(df, audits=audits).collect())))
    assert got == sorted(map(str, [("b", 1, "b", True), ("b", 1, "b", True), ("a", 1, "a", True), ("c", 0, "c", True), ("d", 1, "a", False), ("d", 1, "a", False), (None, 0, None, False)]))
    assert audits[0].count() == 2


def test_a_large_group_of_mostly_unlinked_sets_costs_no_square(spark, monkeypatch):
    """Sets that share a few elements and hardly a link: rows dealt to tiles stay near their number, links are found."""
    monkeypatch.setattr(ngramjoin, "BLOCK_NODES", 40)
    rng = np.random.default_rng(8)
    common = rng.integers(1, 1 << 62, 8).astype(np.uint64)
    sets = [np.unique(np.concatenate((common, rng.integers(1, 1 << 62, 42).astype(np.uint64)))) for _ in range(1500)]
    for i in range(0, 300, 3):  # near copies of sets that are far from the centre
        sets.append(np.unique(np.concatenate((sets[i][1:], rng.integers(1, 1 << 62, 1).astype(np.uint64)))))
    for i in range(60):  # and of the centre, in steps that lead away from it
        sets.append(np.unique(np.concatenate((sets[0][i % 9 :], rng.integers(1, 1 << 62, i % 9).astype(np.uint64)))))
    node = lambda i: i.to_bytes(12, "big")
    data = [(node(i), (i, 0), x.tobytes()) for i, x in enumerate(sets)]
    groups = spark.createDataFrame([(node(0), node(i)) for i in range(len(sets))], "lead binary, node binary")
    table = spark.createDataFrame(data, f"node binary, label {ngramjoin.LABEL}, x binary")
    met = []
    scratch = ngramjoin.Scratch(spark)
    links = ngramjoin._linked(scratch.write(groups), scratch.write(table), 8, 10, scratch, met=met)
    parts = {r.node.k: r.component.k for r in ngramjoin.components(links, scratch).collect()}
    held = [set(x.tolist()) for x in sets]
    pairs = [(i, j) for i, a in enumerate(held) for j in range(i) if 10 * len(a & held[j]) >= 8 * len(a | held[j])]
    want = groups_of(list(range(len(sets))), pairs)
    assert {i: parts.get(i, i) for i in want} == want and len(pairs) > 150
    assert sum(met) < 6 * len(sets), met
