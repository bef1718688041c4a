from __future__ import annotations

import hashlib
import random

import pyarrow as pa
import pytest
from tests.llm.conftest import ODD
from tests.llm.test_substring import passages

from tracemill.llm import suffix_sort as ss
from tracemill.llm import textarrays as ta


def brute(rows, window, version=lambda text: 0):
    """Each distinct row, windows by their bytes; version orders different texts of one doc_id."""
    first, out = {}, []
    held = sorted({(i, version(t), t) for i, t in rows if i is not None and t is not None})
    for i, v, t in held:
        b = t.encode()
        for p in range(len(b) - window + 1):
            first.setdefault(b[p : p + window], (i, v, p))
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - window + 1):
            if i is not None and t is not None and first[b[p : p + window]] < (i, version(t), p):
                gone[p : p + window] = [True] * window
        spans = [p for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1])]
        out.append((i, len(b), sum(gone), len(spans), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def result(df, window):
    return sorted((tuple(r)[:5] for r in ss.remove_repeats(df, window).collect()), key=repr)


def test_agrees_with_brute_force(make_docs):
    for window in (2, 9, 40, 100):
        rows = passages(window)
        assert result(make_docs(rows), window) == brute(rows, window)


def test_edges_of_passages_that_many_hold(make_docs):
    """Passages cut anywhere, changed in one place, twice in one text, with different texts around them."""
    r = random.Random(5)
    base = "".join(r.choice("abcdefgh ") for _ in range(600))
    rows = []
    for i in range(80):
        a, b = sorted(r.sample(range(600), 2))
        text = base[a:b]
        if text and i % 3 == 0:
            k = r.randrange(len(text))
            text = text[:k] + "é" + text[k + 1 :]
        pad = "".join(r.choice("xyz") for _ in range(r.randrange(30)))
        rows.append((i, pad + text + pad[::-1] + (text if i % 4 == 0 else "")))
    for window in (10, 51, 100):
        assert result(make_docs(rows), window) == brute(rows, window)


def test_periodic_texts(make_docs):
    rows = [(0, "a" * 300), (1, "ab" * 200), (2, "x" * 20 + "ab" * 100), (3, "a" * 99), (4, "a" * 100), (5, "-" * 70 + "head" + "-" * 150), (6, "b" + "a" * 120)]
    for window in (7, 50, 100):
        assert result(make_docs(rows), window) == brute(rows, window)


def test_rows_of_one_id(make_docs, spark):
    r = random.Random(9)
    shared = "".join(r.choice("abcdef") for _ in range(150))
    rows = [(2, shared + "one"), (2, shared + "two"), (2, "three" + shared), (1, "b" * 40), (2, "b" * 40), (2, shared + "one"), (3, shared)]
    df = make_docs(rows)
    version = {x.text: x.v for x in df.selectExpr("text", "xxhash64(text) as v").collect()}
    got = result(df, 30)
    assert len(got) == len(rows)
    assert got == brute(rows, 30, version.get)


def test_odd_rows(make_docs):
    rows = [x if x[0] != 6 else (6, "mit license " * 300) for x in ODD]
    for window in (5, 100):
        assert result(make_docs(rows), window) == brute(rows, window)


def test_long_texts_come_in_parts(make_docs, monkeypatch):
    monkeypatch.setattr(ta, "RUN_BYTES", 500)
    r = random.Random(3)
    long = "".join(r.choice("abc") for _ in range(4000))
    table = pa.record_batch([pa.array([long])], names=["text"])
    parts = list(ss.segments(iter([table]), 100))
    seen = [x for _, _, data, at, before in parts for x in (before + p for p in range(len(data) - 99))]
    assert len(parts) > 5 and seen == list(range(3901))
    assert all(data.tobytes().decode() == long[before : before + len(data)] for _, _, data, _, before in parts)


def test_one_long_text_against_its_pieces(make_docs):
    r = random.Random(4)
    long = "".join(r.choice("abcdefghij") for _ in range(2_600_000))
    rows = [(1, long), (2, long[1_048_000:1_049_300]), (3, "zz" + long[2_097_000:2_097_300] + "zz")]
    got = {x.doc_id: x for x in ss.remove_repeats(make_docs(rows)).collect()}
    assert (got[1].n_removed, got[2].n_removed) == (0, 1300)
    assert [(x.start, x.end) for x in got[3].spans] == [(2, 302)]


def test_empty_table(make_docs):
    assert ss.remove_repeats(make_docs([])).count() == 0


def test_bad_window(make_docs):
    with pytest.raises(ValueError):
        ss.remove_repeats(make_docs([]), 1)


def test_parts_stay_small_and_ties_cost_their_own_runs_alone(monkeypatch):
    """Texts are hashed in parts that fit a cache; a digit that repeats within a window doesn't slow the rest of its part."""
    r = random.Random(6)
    texts = ["".join(r.choice("abcdefghijklmnop ") for _ in range(3000)) for _ in range(200)]
    texts[7] = texts[7][:500] + "ab" * 60 + texts[7][500:]
    batch = pa.record_batch([pa.array(texts)], names=["text"])
    parts = list(ss.segments(iter([batch]), 100))
    assert max(len(data) for _, _, data, _, _ in parts) <= 1 << 18
    seen = [texts[i + k] for _, i, data, at, _ in parts for k in range(len(at) - 1)]
    assert seen == texts
    assert all(data.tobytes().decode() == "".join(texts[i : i + len(at) - 1]) for _, i, data, at, _ in parts)

    def all_anew(g, span):
        raise AssertionError("anchors of a whole part found one by one")

    monkeypatch.setattr(ss, "_leftmost", all_anew)
    for _, _, data, at, _ in parts:
        ss.anchors(data, at, 100)


def test_runs_hold_each_window_once_by_its_anchor():
    r = random.Random(8)
    for alphabet in ("a", "ab", "abcdefgh"):
        texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(90))) for _ in range(30)]
        data, at = ta.raw(pa.array(texts))
        for window in (2, 7, 30):
            size = ss.digit_size(window)
            total, first, last, anchor = ss.anchors(data, at, window)
            held = {p: a for f, e, a in zip(first.tolist(), last.tolist(), anchor.tolist(), strict=True) for p in range(f, e + 1)}
            assert len(held) == int((last - first + 1).sum())
            assert sorted(held) == [int(at[i]) + p for i, t in enumerate(texts) for p in range(len(t) - window + 1)]
            offset, digit = {}, {}
            for p, a in held.items():  # equal windows have their anchor at the same place, and it lies within them
                assert p <= a <= p + window - size
                assert offset.setdefault(data[p : p + window].tobytes(), a - p) == a - p
            for a, h in zip(anchor.tolist(), ss.hashes(total, anchor, size).tolist(), strict=True):
                assert digit.setdefault(data[a : a + size].tobytes(), h) == h
            assert len(set(digit.values())) == len(digit)
