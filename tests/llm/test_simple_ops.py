"""Brute-force comparisons for packing, mixing, chunks, licences, top-k, URLs and quality."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestar.llm import chunks, licenses, mixing, packing, quality, scratch, skew, textbytes, topk, urls
from lodestar.llm.queries import URL_RULES, tokenizer_path

TEXTS = [None, "", " \n ", "word", "It's  a\ttest <|endoftext|> of 483 things. " * 40, "é ñ ü 漢字 " * 600, "x" * 5000, "same text", "same text", " " * 3000]


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 30), max_size=12), st.integers(1, 64))
@settings(max_examples=80, deadline=None)
def test_fill_is_the_best_bounded_sum(counts, capacity):
    best = {0}
    for k, n in counts.items():
        best = {x + i * k for x in best for i in range(n + 1) if x + i * k <= capacity}
    used = packing.fill(counts, capacity)
    assert sum(k * n for k, n in used.items()) == max(best)
    assert all(n <= counts[k] for k, n in used.items())


@given(st.dictionaries(st.integers(1, 31), st.integers(1, 40), max_size=10))
@settings(max_examples=80, deadline=None)
def test_plan_places_every_token_once_and_leaves_no_padding(histogram):
    places, n = packing.plan(histogram, 32)
    seen = defaultdict(list)
    for (length, cut), entries in places.items():
        for a, b, size, seq, off in entries:
            for r in range(a, b):
                seen[seq + r - a].append((off, size))
                assert r < histogram[length] and cut + size <= length
    assert sum(k * c for k, c in histogram.items()) == sum(s for v in seen.values() for _, s in v)
    for pieces in seen.values():
        at = 0
        for off, size in sorted(pieces):
            assert off == at
            at += size
        assert at & (at - 1) == 0 and at <= 32
    assert set(seen) == set(range(n))


def test_pack_round_trip(docs_of):
    rows = list(enumerate(TEXTS)) + [(7, "same text"), (50, "long text " * 3000)] + [(100 + i, "words " * (i % 7 * 30)) for i in range(60)]
    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(np.append(encode(t or ""), 0).astype("<u4"))
    got = packing.pack(docs_of(rows), tokenizer_path()).collect()
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        by_seq[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for pieces in by_seq.values():
        at = 0
        for off, n in sorted(pieces):
            assert off == at
            at += n
        assert at <= 1024 and at & (at - 1) == 0
    for i, ids in want.items():
        expected = Counter(len(x) for x in ids)
        assert sum(n for _, n, _, _ in by_doc[i]) == sum(k * c for k, c in expected.items())
        for start, n, crc, total in by_doc[i]:
            assert any(len(x) == total and zlib.crc32(x[start : start + n].tobytes()) == crc for x in ids)


def test_encoders_agree():
    a, b = packing.encoder(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder(tokenizer_path())
    for t in TEXTS:
        assert list(a(t or "")) == list(b(t or ""))


def test_encoders_agree_on_all_documents():
    """The rank file gives the ids that ``tokenizers`` gives with the contract's JSON."""
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    fast = packing.encoder(tokenizer_path())
    for t in texts:
        assert whole.encode(t or "", add_special_tokens=False).ids == list(fast(t or ""))


def test_pack_empty(docs_of):
    assert packing.pack(docs_of([]), tokenizer_path()).count() == 0


def test_mix_totals_caps_and_reruns(docs_of):
    rng = random.Random(3)
    rows = [(i, None if i % 50 == 0 else "w " * rng.randrange(0, 40)) for i in range(600)]
    sources = [["hot"] * 3 + ["b", None, "c", "tiny"][: 4 if i % 97 == 0 else 3] for i in range(600)]
    df = docs_of(rows, [rng.choice(s) for s in sources])
    got = mixing.mix_sources(df)
    a, b = sorted(map(tuple, got.collect())), sorted(map(tuple, got.collect()))
    assert a == b and len(a) == 600
    total = sum(r[1] for r in a)
    by = {}
    for i, size, source_size, target, taken in a:
        assert 0 <= taken <= 3 * size and size == len(re.findall(r"[^\x20\x09-\x0D]+", dict(rows)[i] or ""))
        by.setdefault((source_size, target), []).append(taken)
    for (source_size, target), taken in by.items():
        assert abs(sum(taken) - target) <= 0.5 and target <= 3 * source_size + 1e-9
    assert abs(sum(t for _, t in by) - total) < 1e-6
    assert mixing.mix_sources(docs_of([])).count() == 0
    assert [tuple(r) for r in mixing.mix_sources(docs_of([(1, None)])).collect()] == [(1, 0, 0, 0.0, 0)]


def test_repeat_rows_keeps_columns(docs_of):
    df = docs_of([(i, "a b c") for i in range(30)], ["a"] * 3 + ["b"] * 27)
    out = mixing.repeat_rows(df)
    assert out.columns == df.columns and out.count() >= 30


def _prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_chunks_remove_repeats_and_leave_the_rest(docs_of):
    rng = random.Random(5)
    passage = _prose(rng, 60)
    rows = [(i, _prose(rng, 120)) for i in range(40)]
    shared = [(100 + i, _prose(rng, 80) + " " + passage + " " + _prose(rng, 80)) for i in range(12)]
    rows += shared + [(200, rows[0][1]), (200, rows[0][1]), (201, None), (202, ""), (203, "a" * 20000), (None, rows[1][1])]
    got = {r.doc_id: r for r in chunks.dedup_chunks(docs_of(rows)).collect()}
    assert chunks.dedup_chunks(docs_of(rows)).count() == len(rows)
    for i, t in rows[:40] + [shared[0]]:
        assert got[i].text == t and got[i].n_removed == 0
    for i, t in shared[1:]:
        assert passage not in got[i].text and got[i].n_removed >= 128
        assert got[i].text.startswith(t[:300]) and got[i].text.endswith(t[-300:])
    assert got[200].n_removed == got[200].n_bytes and got[None].text == "" and got[201].text is None and got[202].text == ""
    out = chunks.dedup_chunks(docs_of(rows), columns=True)
    assert out.columns == docs_of(rows).columns
    assert {r.doc_id: r.text for r in out.collect()} == {i: r.text for i, r in got.items()}
    assert chunks.dedup_chunks(docs_of([])).count() == 0


def test_blocks_change_nothing(monkeypatch):
    """Hashes, cuts and windows are the same whatever the size of the blocks that they are computed in."""
    rng = random.Random(3)
    texts = [_prose(rng, n).encode() for n in (0, 3, 200, 1, 90, 60, 0)]
    data, o = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    s = np.array([rng.randrange(len(data)) for _ in range(200)])
    e = np.minimum(s + np.array([rng.randrange(700) for _ in range(200)]), len(data))
    of = lambda: (*chunks.cut(data, o, 6, 100), textbytes.RangeHash(data).fixed(24), textbytes.RangeHash(data)(s, e), textbytes.RangeHash(data)(s, e, 1))
    whole = of()
    assert textbytes.RangeHash(data)(np.arange(50), np.arange(50) + 24).tolist() == whole[2][:50].tolist()
    monkeypatch.setattr(textbytes, "AT_ONCE", 50)
    assert all((x == y).all() for x, y in zip(whole, of()))


@given(st.lists(st.text("ab é漢", max_size=90), max_size=6), st.integers(4, 12), st.integers(14, 60))
@settings(max_examples=150, deadline=None)
def test_cuts_are_the_least_hashes_nearby(texts, near, most):
    raw = [t.encode() for t in texts]
    data, o = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in raw]))).astype(np.int64)
    ends, first = chunks.cut(data, o, near, most)
    for d, t in enumerate(raw):
        h = [None] * len(t)
        for i in range(15, len(t)):
            x = 0
            for b in t[i - 15 : i + 1]:
                x = (x << 1) + int(chunks.GEAR[b]) & 0xFFFFFFFF
            h[i] = (x, i)
        free = lambda i: h[i] is None
        cuts = {i + 1 for i in range(len(t)) if not free(i) and all(free(j) or h[i] <= h[j] for j in range(max(0, i - near), min(len(t), i + near + 1)))}
        forward = set()
        for c in cuts:
            while c < len(t) and t[c] & 0xC0 == 0x80:
                c += 1
            forward.add(c)
        want, last = [], 0
        for c in sorted(forward | ({len(t)} if t else set())):
            while c - last > most:
                last += most
                while last < c and t[last] & 0xC0 == 0x80:
                    last += 1
                if last < c:
                    want.append(last)
            want.append(c)
            last = c
        assert (ends[first[d] : first[d + 1]] - o[d]).tolist() == want


def test_gear_hash_is_the_rolling_one():
    data = np.frombuffer(random.Random(1).randbytes(300), np.uint8)
    want = [sum(int(chunks.GEAR[data[i - j]]) << j for j in range(min(i + 1, 16))) & 0xFFFFFFFF for i in range(300)]
    assert chunks.gear_hashes(data).tolist() == want


def test_chunks_alone_find_repeats_whatever_surrounds_them(docs_of):
    """Passages of 20 words and more, in two documents each; shorter ones than min_bytes stay."""
    rng = random.Random(21)
    for words, least in ((20, 0.97), (25, 1.0), (51, 1.0), (60, 1.0)):
        passages = [_prose(rng, words) for _ in range(60)]
        passages = [p if len(p.encode()) >= 130 else p + _prose(rng, 6) for p in passages]
        rows = [(2 * i + j, _prose(rng, 60) + " " + p + " " + _prose(rng, 60)) for i, p in enumerate(passages) for j in range(2)]
        got = {r.doc_id: r for r in chunks.dedup_chunks(docs_of(rows)).collect()}
        gone = [got[2 * i + 1].n_removed >= len(p.encode()) for i, p in enumerate(passages)]
        assert sum(gone) >= least * 60 and all(got[2 * i].n_removed == 0 for i in range(60)), words


def _license_brute(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode()
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == [w.encode() for w in p.split()]]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_licenses_base_is_exact_and_fuzzy_adds(docs_of):
    rng = random.Random(2)
    parts = ["GNU General  Public\nLicense", "apache-license", "CC BY", "cc by-nc", "MIT License", "emit license", "mit licenses", "éMIT license", "mit", "license", "gnu", "the", "ñ", "9", "\x00", "general public"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(0, 12))) for _ in range(200)] + [None, "", "mit", "license", "MIT LICENSE", "a" * 50000]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in licenses.scan_licenses(docs_of(rows)).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == _license_brute(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    fuzzy = {r.doc_id: r for r in licenses.scan_licenses(docs_of([(1, "see the Gnu Generel Publik License now"), (2, "Permission is hereby granted free of charge to"), (3, "nothing here")])).collect()}
    assert fuzzy[1].labels == "gpl" and fuzzy[1].n_base == 0 and 0 < fuzzy[1].score < 1
    assert fuzzy[2].labels == "mit" and fuzzy[3].labels == "" and fuzzy[3].score == 0
    s = fuzzy[1].spans[0]
    assert (s.s, s.e, s.edits) == (8, 34, 2)


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 8) / 16], 1) for i in range(700)] + [(0, [0.1] * 8, 1)]
    rows += [(1000, None, 0), (1100, [None] * 8, 0), (1200, [float("nan")] * 8, 1), (1300, [float("inf")] * 8, 1), (1400, [0.5] * 3, 1), (1401, [0.5] * 3, 1)]
    df = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 100 == 0, block=64).collect()))
    v = [(i, np.floor(1024 * np.array(np.array(e, np.float32), float)).astype(int)) for i, e, _ in rows if e and None not in e and np.isfinite(e).all()]
    want = []
    for m, (i, q) in enumerate(v):  # every row but the query's own, rows that repeat its id included
        if i % 100 == 0:
            best = sorted((-int(np.dot(q, c)), j) for n, (j, c) in enumerate(v) if n != m and len(c) == len(q))[:10]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_urls_rules_and_trees(spark):
    cases = ["http://a.example.com/en/7", "http://example.com/en/6?x", "HTTP://EXAMPLE.NET/de/8/x", "x://sub.b.net/de/1", "x://net/de/", "x://notnet.xnet/de/", "x://c.org/es/#", "x://c.org/fr/a.b", None, "", "no scheme", "://", "a://b?c://d/e", "a://É.com/en/é"]
    rows = [(i, u, "h") for i, u in enumerate(cases)] + [(90, "http://" + "a." * 30000 + "com/en/x?" + "y=1&" * 20000, "h"), (91, cases[0], "h"), (91, cases[0], "h")] + [(100 + i, f"http://h{i % 7}.{'com' if i % 2 else 'net'}/{'en' if i % 2 else 'de'}/{i}", "h") for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = {r.page_id: r for r in urls.judge_urls(df, URL_RULES, trees=2).collect()}
    assert urls.judge_urls(df, URL_RULES, trees=2).count() == len(rows)
    for i, u, _ in rows:
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match("[^/?#]*", rest)[0]
            path = re.match("[^?#]*", rest[len(host) :])[0]
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(r, v) for v, r in URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (verdict or ("block" if got[i].score >= 0.5 else "allow"))
    again = {r.page_id: r for r in urls.judge_urls(df, URL_RULES, trees=2).collect()}
    assert again == got
    assert urls.judge_urls(df.limit(0), URL_RULES).count() == 0
    assert urls.judge_urls(spark.createDataFrame([(1, "x://y/z")], "page_id long, url string"), URL_RULES).first().verdict == "allow"


def test_trees_learn_a_lexical_rule(spark):
    rows = [(f"u{i}", "h.com" if i % 3 else "h.net", int(i % 7 > 3), float(i % 7), float(i % 5)) for i in range(700)]
    df = spark.createDataFrame(rows, "url_key string, suffix string, label int, a double, b double")
    model = urls.fit_boosted(df, ["a", "b"], trees=4)
    cols = {"a": F.col("a"), "b": F.col("b"), "suffix_rate": F.lit(0.5)}
    scored = df.withColumns({"b_" + f: c for f, c in model.binned(cols).items()}).withColumn("m", model.margin())
    assert scored.where((F.col("m") > 0) != (F.col("label") == 1)).count() == 0


def test_quality_learns_and_handles_odd_rows(spark, docs_of):
    rng = random.Random(1)
    rows = [(i, _prose(rng, 80) if i % 3 else " ".join([_prose(rng, 1)] * 80) + "!! $$$") for i in range(300)] + [(900, None), (901, ""), (902, "x" * 60000), (903, " ")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 300, 2)] + [(None, 1, 0), (5000, 0, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.score_quality(docs_of(rows), labels).collect()}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out.values())
    assert np.mean([out[i].predicted == int(i % 3 > 0) for i in range(1, 300, 2)]) > 0.97
    kept = quality.score_quality(docs_of(rows), labels, keep=True)
    assert kept.columns == docs_of(rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in out.items() if r.predicted)
    assert {r.score for r in quality.score_quality(docs_of(rows), labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(docs_of([]), labels).count() == 0


@pytest.mark.parametrize("y", [0, 1])
def test_quality_with_one_class(docs_of, spark, y):
    labels = spark.createDataFrame([(1, y)], "doc_id long, quality int")
    assert [r.score for r in quality.score_quality(docs_of([(1, "a b"), (2, "c")]), labels).collect()] == [float(y)] * 2


def test_chunks_remove_short_passages_to_their_borders(docs_of):
    """Passages of 51 to 60 words that stand in two documents with other surroundings, many of them."""
    rng = random.Random(51)
    rows, passages = [], []
    for n in range(300):
        passage = _prose(rng, 51 + n % 10)
        texts = [(_prose(rng, rng.randrange(20, 60)), _prose(rng, rng.randrange(20, 60))) for _ in range(2)]
        rows += [(2 * n + i, f"{a} {passage} {b}") for i, (a, b) in enumerate(texts)]
        passages.append((passage, texts[1]))
    got = {r.doc_id: r for r in chunks.dedup_chunks(docs_of(rows)).collect()}
    for n, (passage, (before, after)) in enumerate(passages):
        assert got[2 * n].text == rows[2 * n][1]
        left = got[2 * n + 1]
        assert left.n_spans == 1 and left.n_removed >= len(passage.encode()) + 2
        assert len(before + after) - 8 <= len(left.text) <= len(before + after)


def test_trees_score_as_brute_force_says(spark):
    """The scores of CASE expressions are those of boosting by the book on the same binned rows."""
    rng = random.Random(7)
    rows = [(f"u{i}", rng.choice(["com", "net", "org"]), int(rng.random() < 0.5), float(rng.randrange(9)), float(rng.randrange(5))) for i in range(900)]
    df = spark.createDataFrame(rows, "url_key string, suffix string, label int, a double, b double")
    model = urls.fit_boosted(df, ["a", "b"], trees=3, depth=2)
    p0 = sum(r[2] for r in rows) / len(rows)
    rates = {s: (sum(r[2] for r in rows if r[1] == s) + 10 * p0) / (sum(r[1] == s for r in rows) + 10) for s in ("com", "net", "org")}
    x = [{"a": r[3], "b": r[4], "suffix_rate": rates[r[1]]} for r in rows]
    binned = [{f: sum(v[f] > e for e in model.edges[f]) for f in v} for v in x]
    margin = [np.log(p0 / (1 - p0))] * len(rows)
    for _ in range(3):
        p = [1 / (1 + np.exp(-m)) for m in margin]
        g, h = [r[2] - q for r, q in zip(rows, p)], [q * (1 - q) for q in p]
        leaves = [list(range(len(rows)))]
        for _ in range(2):
            grown = []
            for leaf in leaves:
                total = lambda i: (sum(g[k] for k in i), sum(h[k] for k in i) + 1)
                best = (1e-9, None)
                for f in ("a", "b", "suffix_rate"):
                    for b in range(16):
                        left, right = [k for k in leaf if binned[k][f] <= b], [k for k in leaf if binned[k][f] > b]
                        if left and right:
                            gain = sum(a * a / c for a, c in (total(left), total(right))) - total(leaf)[0] ** 2 / total(leaf)[1]
                            if gain > best[0] * (1 + 1e-9):
                                best = (gain, (left, right))
                grown += best[1] or (leaf,)
            leaves = grown
        for leaf in leaves:
            for k in leaf:
                margin[k] += 0.4 * total(leaf)[0] / total(leaf)[1]
    cols = {"a": F.col("a"), "b": F.col("b"), "suffix_rate": urls._rate(F.col("suffix"), model.suffix_rate, 0.5)}
    scored = df.withColumns({"b_" + f: c for f, c in model.binned(cols).items()}).withColumn("m", model.margin())
    got = {r.url_key: r.m for r in scored.collect()}
    assert max(abs(got[r[0]] - m) for r, m in zip(rows, margin)) < 1e-9


def test_quality_scores_as_brute_force_says(spark, docs_of):
    """Shrunk class covariances and log densities, by the book."""
    rng = random.Random(21)
    rows = [(i, _prose(rng, rng.randrange(5, 90)) if i % 2 else " ".join([_prose(rng, 2)] * 20) + " $$ ||") for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(90)], "doc_id long, quality int")
    x = {i: quality.statistics(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for i, t in rows}
    center = np.mean([x[i] for i in range(90)], axis=0)
    words = lambda v: np.expm1(v[0]) / (np.expm1(v[0]) + quality.PRIOR_WORDS)
    z = {i: np.append(v[:1], center[1:] + (v[1:] - center[1:]) * words(v)) for i, v in x.items()}
    side = [np.array([z[i] for i in range(90) if i % 2 == y]) for y in (0, 1)]
    scatter = [np.cov(s.T, bias=True) for s in side]
    pooled, d = sum(len(s) * c for s, c in zip(side, scatter)) / 90, len(center)
    got = {r.doc_id: r.score for r in quality.score_quality(docs_of(rows), labels).collect()}
    for i, v in z.items():
        density = []
        for s, c in zip(side, scatter):
            w = 0.15 + 0.85 * d / (d + len(s))
            c = (1 - w) * c + w * pooled
            c = 0.9 * c + 0.1 * np.diag(np.maximum(np.diag(c), 1e-4)) + 1e-6 * np.eye(d)
            density.append(np.log(len(s)) - np.linalg.slogdet(c)[1] / 2 - (v - s.mean(0)) @ np.linalg.solve(c, v - s.mean(0)) / 2)
        assert abs(got[i] - 1 / (1 + np.exp(-np.clip(density[1] - density[0], -30, 30)))) < 1e-6


def test_licenses_need_whole_words_and_take_the_best_match(docs_of):
    texts = ["please submit license forms today", "a permit license", "the hermit license", "commit license", "emit license", "kit license", "mit licence", "the mit licenses", "apache licence apache license", "gnu general publik licensegnu general public licensing gnu general public licenses", "MOZILLA PUBLIC LICENCE", "mozila publc license"]
    got = {r.doc_id: r for r in licenses.scan_licenses(docs_of(list(enumerate(texts)))).collect()}
    assert [got[i].labels for i in range(12)] == ["", "", "", "", "", "", "mit", "mit", "apache", "gpl", "mpl", "mpl"]
    assert got[8].score == 1 and got[8].n_base == 1 and sorted(s.edits for s in got[8].spans) == [0, 0, 1]
    assert all(got[i].score < 1 for i in range(12) if not got[i].n_base) and len(got[9].spans) == 1
    rows = docs_of([(1, texts[6]), (1, texts[6]), (None, texts[6]), (2, "mit licence " * 30000)])
    assert sorted((str(r.doc_id), len(r.spans)) for r in licenses.scan_licenses(rows).collect()) == [("1", 1), ("1", 1), ("2", 30000), ("None", 1)]


def test_scratch_tables_restore_settings_and_go(spark):
    before = {k: spark.conf.get(k, None) for k in scratch.WRITING}
    s = scratch.Scratch(spark)
    table = s.write(spark.range(5))
    assert {k: spark.conf.get(k, None) for k in scratch.WRITING} == before and table.count() == 5
    s.drop(table)
    with pytest.raises(Exception):
        spark.read.parquet(table._scratch).count()


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda k, d=None: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session())


def test_joins_split_at_frequent_keys_lose_nothing(spark):
    rng = random.Random(4)
    keys = [0] * 3000 + [rng.randrange(1, 4000) for _ in range(2500)] + [None] * 5
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, i int")
    facts = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("w"), F.min("i").alias("first"))
    got = skew.join_split(rows, facts, ["k"], "w", len(keys))
    assert got.columns == ["k", "i", "first"]
    first = {k: keys.index(k) for k in set(keys) if k is not None}
    assert sorted(map(tuple, got.collect())) == sorted((k, i, first[k]) for i, k in enumerate(keys) if k is not None)


def test_topk_ignores_other_columns_and_urls_nulls(spark):
    rows = [(i, [float(i % 3), 1.0], i, "x") for i in range(120)]
    df = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>, g int, rank string"))
    plain = topk.quantised(spark.createDataFrame([r[:2] for r in rows], "vec_id long, embedding array<float>"))
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 100 == 0).collect())) == sorted(map(tuple, topk.top_k(plain, F.col("vec_id") % 100 == 0).collect()))
    pages = spark.createDataFrame([(None, "http://a.com/en/x", "s", 1.0), (2, None, None, None)], "page_id long, url string, suffix string, score double")
    assert sorted(str(r.page_id) for r in urls.judge_urls(pages, URL_RULES).collect()) == ["2", "None"]


def test_topk_scores_beyond_64_bits_saturate(spark):
    big = 2**62
    rows = [(0, [big, big]), (1, [big, big]), (2, [-big, -big]), (3, [1, 0]), (4, [big, 0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, vector array<long>"), F.col("vec_id") == 0, k=4).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 2**63 - 1), (4, 2**63 - 1), (3, big), (2, 1 - 2**63)]


def _edits(notice, text):
    """Edits of ``notice`` against every prefix of ``text``."""
    row = list(range(len(text) + 1))  # of the empty notice
    for i, c in enumerate(notice, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != t)))
        row = new
    return row


def _best_spans(low, notices):
    """label: the fewest edits of a notice over all spans that words don't go on around, and the lengths of such spans."""
    inside = [c.isdigit() or "a" <= c <= "z" for c in low]
    edge = [i == 0 or i == len(low) or not (inside[i - 1]) for i in range(len(low) + 1)]
    stop = [i == len(low) or not inside[i] for i in range(len(low) + 1)]
    found = {}
    for notice, label, most in notices:
        exact, _, loose = notice.rpartition("~")
        for s in range(len(low)):
            if not edge[s] or not low.startswith(exact, s):
                continue
            at = s + len(exact)
            for j, n in enumerate(_edits(loose, low[at : at + len(loose) + most])):
                if n <= most and stop[at + j] and at + j > s:
                    found.setdefault(label, []).append((n, at + j - s))
    return {label: (min(x)[0], {size for n, size in x if n == min(x)[0]}) for label, x in found.items()}


def test_fuzzy_licenses_against_every_span(docs_of):
    rng = random.Random(31)
    notices = [("apache license", "apache", 1), ("mit~ license", "mit", 1), ("mozilla public license", "mpl", 2), ("general public", "gp", 3)]

    def damaged(t):
        t = list(t)
        for _ in range(rng.randrange(0, 4)):
            i, kind = rng.randrange(len(t) or 1), rng.randrange(3)
            t[i : i + (kind < 2)] = [rng.choice("abcelit  .")] if kind else []
        return "".join(t)

    parts = [n.replace("~", "") for n, _, _ in notices] + ["the", "commit", "a", "license", "x.", "apache", "publ"]
    texts = []
    for _ in range(160):
        text = rng.choice([" ", ", ", ""]).join(damaged(rng.choice(parts)) for _ in range(rng.randrange(1, 4)))
        texts.append(text.upper() if rng.random() < 0.2 else text)
    got = {r.doc_id: r for r in licenses.scan_licenses(docs_of(list(enumerate(texts))), phrases={}, notices=notices).collect()}
    seen = Counter()
    for i, t in enumerate(texts):
        low, r = t.lower(), got[i]
        want = _best_spans(low, notices)
        assert r.labels == ",".join(sorted(want)) and r.base_labels == "" and r.n_base == 0, (t, want)
        best = Counter()
        for s in r.spans:
            notice = next(n for n, label, _ in notices if label == s.label)
            exact, _, loose = notice.rpartition("~")
            assert low[s.s : s.e].startswith(exact) and _edits(loose, low[s.s + len(exact) : s.e])[-1] <= s.edits, (t, s)
            best[s.label] = min(best.get(s.label, 99), s.edits)
        for label, (n, sizes) in want.items():
            assert best[label] == n, (t, label, n, r.spans)
            seen[label, n] += 1
        scores = [0.99 * (1 - s.edits / (s.e - s.s)) for s in r.spans]
        assert r.score == max(scores, default=0.0)
        assert max(scores, default=0.0) <= max((0.99 * (1 - n / max(sizes)) for n, sizes in want.values()), default=0.0) + 1e-9
        for a in r.spans:
            assert not any(a != b and a.label == b.label and a.s < b.e and b.s < a.e for b in r.spans)
    assert len(seen) >= 9, seen
