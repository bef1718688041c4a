from __future__ import annotations

import random

import numpy as np
import pytest
from tests.conftest import DATA
from tests.llm.conftest import ODD

from tracemill.llm import ngram_join as nj

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def brute(rows, n, percent):
    """doc_id -> (set size, smallest doc_id reachable), over all pairs with a token in common."""
    sets, ids, inverted = [], [], {}
    for i, t in rows:
        w = (t or "").encode().translate(LOWER).split()
        s = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
        sets.append(s)
        ids.append(i)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, s in enumerate(sets):
        seen = {}
        for g in s:
            for j in inverted.setdefault(g, []):
                seen[j] = seen.get(j, 0) + 1
            inverted[g].append(k)
        for j, common in seen.items():
            if 100 * common >= percent * (len(s) + len(sets[j]) - common) and None not in (ids[j], ids[k]):
                a, b = root(ids[j]), root(ids[k])
                parent[max(a, b)] = min(a, b)
    return sorted((i, len(s), root(i)) for i, s in zip(ids, sets) if i is not None)


def result(df, n, percent):
    return sorted(tuple(r) for r in nj.ngram_classes(df, n, percent).collect() if r.doc_id is not None)


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_agrees_with_brute_force_on_documents(spark, n, percent):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    assert result(df, n, percent) == brute([(r.doc_id, r.text) for r in df.collect()], n, percent)


def near_copies(seed, groups, words):
    """Groups of edited copies, some of which only link through others, in mixed order."""
    r, out = random.Random(seed), []
    for g in range(groups):
        base = [f"w{r.randrange(60)}" for _ in range(words)]
        for _ in range(40):
            text = base[:]
            for _ in range(r.randrange(0, max(2, words // 12))):
                text[r.randrange(words)] = f"x{r.randrange(10**6)}"
            out.append(" ".join(text))
    r.shuffle(out)
    return list(enumerate(out))


def test_agrees_with_brute_force_on_large_buckets(make_docs, monkeypatch):
    for name, value in (("PAIRS", 4), ("BLOCK", 8), ("TEXTS", 5)):
        monkeypatch.setattr(nj, name, value)
    rows = near_copies(1, 4, 60) + [(10_000 + i, t) for i, t in near_copies(2, 3, 14)]
    assert result(make_docs(rows), 4, 85) == brute(rows, 4, 85)


def test_linked_sets_share_a_signature_whatever_is_frequent():
    r = np.random.default_rng(0)
    for _ in range(400):
        n = int(r.integers(1, 300))
        universe = r.integers(0, 2**63, n + 60).astype(np.uint64)
        often = r.random(len(universe)) < r.choice([0.1, 0.6, 0.9, 1.0])
        a = np.unique(universe[:n])
        lost = int(r.integers(0, max(1, n // 8)))
        b = np.unique(np.concatenate([a[lost:], universe[n : n + int(r.integers(0, 20))]]))
        if not len(a) or not len(b):
            continue
        common = len(np.intersect1d(a, b))
        if 100 * common < 85 * (len(a) + len(b) - common):
            continue
        flag = dict(zip(universe.tolist(), often))
        sa, sb = (nj.signatures(s, np.array([flag[x] for x in s.tolist()], dtype=bool), 85) for s in (a, b))
        assert len(np.intersect1d(sa, sb))
        assert nj.may_link([nj.profile(a)], [nj.profile(b)], np.array([len(a)]), np.array([len(b)]), 85).all()


def test_odd_rows(make_docs):
    got = nj.ngram_classes(make_docs(ODD), 4, 85).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert [by[i].n_shingles for i in (0, 1, 2, 3, 4, 6)] == [0, 0, 0, 1, 5, 2]
    assert by[0].component_id == 0 and by[1].component_id == 1 and by[2].component_id == 2
    assert by[4].component_id == 4 and by[5].component_id == 4 and by[None].component_id is None
    assert sum(r.doc_id == 5 for r in got) == 2


def test_empty_table(make_docs):
    assert nj.ngram_classes(make_docs([]), 4, 85).count() == 0
