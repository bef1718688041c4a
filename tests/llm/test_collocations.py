from __future__ import annotations

import random
import re
from collections import Counter

import pyarrow as pa
from tests.llm.conftest import DOCS, ODD

from tracemill.llm import collocations as cc

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, longest, least, top, contained):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    by = {}
    for (lang, w), a in found.items():
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        inside = any(x == lang and len(v) > len(w) and 100 * b >= contained * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (x, v), b in found.items())
        if not inside:
            by.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, r, p.decode(), -a, left, right, n[lang], -s) for lang, xs in by.items() for r, (s, a, p, left, right) in enumerate(sorted(xs)[:top], 1))


def result(df, **how):
    return sorted(tuple(r) for r in cc.collocations(df, **how).collect())


def texts(seed, n=120):
    r = random.Random(seed)
    words = ["the", "The", "new", "york", "city", "é", "ÉCOLE", "école", "a", "b", "\x00", "x" * 40, "日本"]
    marks = [" ", "  ", "\t", ". ", ",", "\n", "\r\n", " ; ", "?!", "\x0b", "\xa0"]
    return [(r.choice(["en", "de", None, ""]), "".join(r.choice(words) + r.choice(marks) for _ in range(r.randrange(40)))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0) for i, (lang, t) in enumerate(rows)], DOCS)


def test_agrees_with_brute_force(spark):
    for seed, longest, least, top, contained in ((1, 5, 4, 2000, 100), (2, 3, 2, 7, 100), (3, 4, 3, 50, 60)):
        rows = texts(seed)
        want = brute(rows, longest, least, top, contained)
        assert want and result(frame(spark, rows), longest=longest, min_count=least, top=top, contained=contained) == want


def test_a_full_sketch_changes_nothing(spark):
    rows = texts(4)
    assert result(frame(spark, rows), min_count=5, cells=64) == brute(rows, 5, 5, 2000, 100)


def test_overlaps_count(spark):
    rows = [("en", "a a a a a a. b a a")]
    got = {x[2]: x[3] for x in result(frame(spark, rows), min_count=1, contained=1000)}
    assert got["a a"] == 6 and got["a a a a a"] == 2


def test_products_beyond_64_bits(spark):
    rows = [(3 * 10**13, 10**15, 7 * 10**13, 10**14), (10**16, 9 * 10**16, 10**16, 10**16), (100, 5, 100, 100)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long").selectExpr("a", "n", "l", "r", f"{cc.SCORE} as score")
    assert all(x.score == 1000 * x.a * x.n // (x.l * x.r) for x in df.collect())


def test_odd_rows(make_docs):
    rows = [x for x in ODD if x[0] != 6] + [(6, "mit license " * 3000)]
    langs = [("en" if i is None or i % 2 else "fr", t) for i, t in rows]
    assert result(make_docs(rows), min_count=2) == brute(langs, 5, 2, 2000, 100)


def test_empty_table(make_docs):
    assert result(make_docs([])) == []


def test_long_texts_are_cut_at_breaks(monkeypatch):
    monkeypatch.setattr(cc, "PART_BYTES", 50)
    text = ". ".join(f"word{i} more{i}" for i in range(200)) + " " + "x y " * 100
    batch = pa.record_batch([pa.array(["en"]), pa.array([text])], names=["lang", "text"])
    parts = [x for _, part in cc.shards(iter([batch])) for x in part.to_pylist()]
    assert "".join(parts) == text and len(parts) > 50 and all(p.endswith(".") for p in parts[:-1])


def test_phrases_beyond_one_automaton(monkeypatch):
    monkeypatch.setattr(cc, "PATTERNS", 3)
    every = lambda h: h == h  # noqa: E731  a sketch whose cells are all full
    batch = pa.record_batch([pa.array(["en", "en"]), pa.array(["a b a b", "c, a b"])], names=["lang", "text"])
    (rows,) = cc._count(iter([batch]), 2, every, every)
    (packed,) = cc._packed(iter([rows, rows]), 7)
    (back,) = cc._unpacked(iter([packed, packed]), 5)
    assert set(zip(*(back.column(k).to_pylist() for k in range(3)), strict=True)) == {("en", None, 28), ("en", "a", 12), ("en", "b", 12), ("en", "a b", 12)}
    assert dict(zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True)) == {None: 7, "a": 3, "b": 3, "c": 1, "a b": 3, "b a": 1}
