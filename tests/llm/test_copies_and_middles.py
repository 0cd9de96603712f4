"""Block naming and fill-in-the-middle texts against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import fim, naming

ODD = [(None, "a b"), (None, None), (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "a b"), (4, "ab"), (4, "ab"), (5, "a b"), (6, "ab ")]


def _groups(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for t, group in by.items():
        keep = min(group)[3]
        group.sort()
        digest = hashlib.sha256(t.encode()).hexdigest()
        out += [(x[3], keep, len(group), x is group[0], digest) for x in group]
    return sorted(map(str, out))


def _named(docs, **how):
    cols = ("keep_id", "group_size", "kept", "text_sha256")
    return sorted(str((r.doc_id, *(r[c] for c in cols))) for r in naming.exact_groups(docs, **how).collect())


@pytest.mark.parametrize("block", [3, 8, 1024])
def test_groups_against_brute_force(docs_of, block):
    rng = random.Random(block)
    base = ["".join(rng.choice("ab c\né漢") for _ in range(rng.randrange(0, 90))) for _ in range(25)]
    rows = [(i, rng.choice(base)) for i in range(150)]
    rows += [(200 + i, base[0][:40] + "x" * i + base[1]) for i in range(20)]  # equal first blocks, other ends
    rows += [(300 + i, ("  " if i % 3 else " ") + "hot text, a third of all rows" + " " * (i % 5)) for i in range(90)]
    rows += [(400 + i, "long " * 4000 + ("" if i < 3 else str(i))) for i in range(6)] if block > 3 else []
    assert _named(docs_of(rows + ODD), block=block) == _groups(rows + ODD)


def test_no_two_texts_share_a_name_by_a_digest(docs_of):
    """Pairs of names in another order, or names of another level, are other texts."""
    rows = [(i, t) for i, t in enumerate(["aabb", "bbaa", "abab", "aabba", "aabbaa", "aaaa", "aaaaaaaa", "aabbaabb", "bbaabbaa", "aabb"])]
    assert _named(docs_of(rows), block=1) == _groups(rows) and _named(docs_of(rows), block=2) == _groups(rows)


def test_groups_of_an_empty_table_and_clashing_columns(docs_of, spark):
    assert naming.exact_groups(docs_of([])).count() == 0
    rows = spark.createDataFrame([("b", "x y", 1, 2, "r"), ("a", "xy ", 3, 4, "s"), ("c", "z", 5, 6, "t")], "id string, body string, k int, name int, row string")
    got = sorted(tuple(r)[:4] for r in naming.exact_groups(rows, "id", "body").collect())
    assert got == [("a", "a", 2, True), ("b", "a", 2, False), ("c", "c", 1, True)]
    kept = naming.drop_copies(rows, "id", "body")
    assert kept.columns == rows.columns and sorted(map(tuple, kept.collect())) == [("a", "xy ", 3, 4, "s"), ("c", "z", 5, 6, "t")]


def test_a_task_remembers_blocks_that_recur(monkeypatch):
    monkeypatch.setattr(naming, "REMEMBER", 2000)
    seen, hits = naming.Seen(), 0
    for i in range(500):
        assert seen.first(b"often", (0, 0)) in (None, (0, 0))
        hits += seen.first(b"often", (1, i)) == (0, 0)
        seen.first(b"%d" % i, (2, i))
    assert hits == 500 and len(seen.new) + len(seen.old) < 60


ALPHABET = "ab <>PSM\n漢é😀"


@given(st.text(ALPHABET, max_size=60), st.integers(0, 99), st.integers(0, 99), st.sampled_from(["psm", "spm"]), st.sampled_from(["point", "word"]))
@settings(max_examples=300, deadline=None)
def test_ropes_cut_and_restore(text, x, y, form, unit):
    if any(m in text for m in fim.MARKS) or not text:
        return
    before, fim.LEAF = fim.LEAF, 5
    try:
        raw = np.frombuffer(text.encode(), np.uint8)
        rope = fim.Buffer(raw, np.array([0, len(raw)]), unit).ropes(np.array([0, len(raw)]))[0]
        assert rope.points == len(text) and rope.units == (len(text) if unit == "point" else len(re.findall(r"[^ \n]+", text)))
        assert rope.height <= 1.45 * np.log2(len(raw) / 5 + 2) + 1
        a, b = sorted((x % (rope.units + 1), y % (rope.units + 1)))
        out, prefix, middle = fim.rearranged(rope, a, b, form)
        starts = [m.start() for m in re.finditer("(?s)." if unit == "point" else r"[^ \n]+", text)] + [len(text)]
        cut = lambda r: 0 if r == 0 else starts[r]
        p, m, s = text[: cut(a)], text[cut(a) : cut(b)], text[cut(b) :]
        done = fim.content(out).decode()
        assert done == (f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}") and (prefix, middle) == (len(p), len(m))
        raw = np.frombuffer(done.encode(), np.uint8)
        back = fim.Buffer(raw, np.array([0, len(raw)])).ropes(np.array([0, len(raw)]))[0]
        assert fim.content(fim.straightened(back, form)).decode() == text
    finally:
        fim.LEAF = before


def _expected(i, t):
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    t = t or ""
    n = len(t)
    if not t or any(m in t for m in fim.MARKS) or h3 % 100 >= 90:
        return i, n, "plain", None, None, t, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return i, n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}", t
    return i, n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}", t


def test_middles_against_brute_force(docs_of):
    rng = random.Random(8)
    rows = ODD + [(i, "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 4000 if i % 9 == 0 else 80)))) for i in range(10, 300)]
    rows += [(300, "x<P>y"), (301, "<M>"), (302, "<S"), (303, "漢" * 200000), (-7, "minus"), (2**62, "large")]
    got = fim.restore(fim.transform(docs_of(rows)))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    assert Counter(map(tuple, got.collect())) == Counter(_expected(*r) for r in rows)
    assert {r.form for r in got.select("form").collect()} == {"plain", "psm", "spm"}
    assert fim.transform(docs_of([])).count() == 0


def test_units_of_words_and_other_marks(docs_of):
    rows = [(i, " one two  three\nfour " * (i % 4)) for i in range(40)]
    got = fim.restore(fim.transform(docs_of(rows), unit="word", marks=("[p]", "[s]", "[m]")), marks=("[p]", "[s]", "[m]"))
    assert all(r.restored == dict(rows)[r.doc_id] for r in got.collect())
    for r in got.where("form = 'psm'").collect():
        at = [r.output.index(m) for m in ("[p]", "[s]", "[m]")]
        assert at == sorted(at) and r.output[at[1] + 3 :][:1] in ("o", "t", "f", "[", "") + (" ",)
    for marks in (("a", "ab", "c"), ("aa", "b", "c"), ("xy", "yz", "c"), ("", "b", "c")):
        with pytest.raises(ValueError, match="mistaken"):
            fim.transform(docs_of(rows), marks=marks)


def test_restore_keeps_columns_and_tells_wrong_rows(spark):
    rows = spark.createDataFrame([(1, "plain", "t", "x"), (2, "psm", "<P>a<S>c<M>b", "y"), (3, None, "z", None), (4, "plain", None, "")], "n int, form string, output string, t string")
    got = fim.restore(rows)
    assert sorted(map(tuple, got.collect())) == [(1, "plain", "t", "x", "t"), (2, "psm", "<P>a<S>c<M>b", "y", "abc"), (3, None, "z", None, None), (4, "plain", None, "", "")]
    with pytest.raises(ValueError, match="already"):
        fim.restore(got)
    with pytest.raises(Exception, match="no text of the form"):
        fim.restore(spark.createDataFrame([("spm", "<S>a<P>b")], "form string, output string")).collect()
