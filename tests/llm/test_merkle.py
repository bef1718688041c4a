from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from tests.llm.conftest import DOCS, ODD

from tracemill.llm import merkle

UPPER = bytes(range(65, 91))


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    out = []
    for value in (row.doc_id, row.source, row.lang, row.n_chars, text):
        b = None if value is None else str(value).encode()
        out.append("-" if b is None else f"{len(b)}:{b.decode()}")
    return H(*out)


def tree(nodes):
    """(root, for each node its siblings level by level as (before, after))."""
    places, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, p in enumerate(places):
            run = nodes[8 * (p // 8) : 8 * (p // 8) + 8]
            paths[k].append((run[: p % 8], run[p % 8 + 1 :]))
            places[k] = p // 8
        nodes = [H(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r.lang, []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for x in langs:
        by[x].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
    trees = {x: tree([leaf(r, r.text) for r in by[x]]) for x in langs}
    if not langs:
        return []
    root, over = tree([trees[x][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for r, path in zip(by[x], trees[x][1], strict=True):
            text = r.text
            if r.doc_id is not None and text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0:
                text = text.encode().translate(bytes(range(256)).replace(UPPER, UPPER.lower())).decode()
            node, whole = leaf(r, text), path + over[k]
            for before, after in whole:
                node = H(*before, node, *after)
            out.append((r.doc_id, leaf(r, r.text), trees[x][0], root, H(*(s for a, b in whole for s in a + b)), node, node == root))
    return sorted(out, key=repr)


def check(df):
    rows = df.select("doc_id", "source", "lang", "n_chars", "text").collect()
    got = merkle.manifest(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 513, 700])
def test_trees_of_any_size(spark, n):
    r = random.Random(n)
    rows = [(i * 7, f"Text {r.random()}", "en" if r.random() < 0.9 else "de", "s", i) for i in range(n)]
    r.shuffle(rows)
    check(spark.createDataFrame(rows, DOCS))


def test_many_trees(spark):
    rows = [(i, f"T{i}", None if i % 5 == 0 else ("é" if i % 7 == 0 else f"l{i % 61}"), None, None) for i in range(300)]
    check(spark.createDataFrame(rows, DOCS))


def test_odd_rows(make_docs):
    check(make_docs(ODD))


def test_repeated_and_null_ids(spark):
    rows = [(1, "A", "en", "s", 1), (1, "A", "en", "s", 1), (1, "B", "en", "s", 1), (None, "A", "en", None, None), (None, None, None, None, None), (None, "", None, None, 0)] * 4
    check(spark.createDataFrame(rows, DOCS))


def test_empty_table(make_docs):
    assert merkle.manifest(make_docs([])).count() == 0


def test_null_and_empty_have_leaves_of_their_own(spark):
    got = {r.leaf for r in merkle.manifest(spark.createDataFrame([(1, None, "en", "s", 0), (1, "", "en", "s", 0)], DOCS)).collect()}
    assert len(got) == 2
