from __future__ import annotations

import hashlib
import os
import random
import time

from tests.llm.conftest import ODD

from tracemill.llm import substring_dedup as sd
from tracemill.llm.shared import SHUFFLES_GO, Scratch


def brute(rows, window):
    low = {}
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        if i is None:
            continue
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            low[key] = min(low.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and low[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def result(df, window):
    return sorted((tuple(r)[:4] for r in sd.remove_repeats(df, window).collect()), key=repr)


def passages(seed):
    r = random.Random(seed)
    shared = [[f"p{r.randrange(40)}" for _ in range(r.randrange(5, 60))] for _ in range(5)]
    rows = []
    for i in range(60):
        w = [f"u{r.randrange(400)}" for _ in range(r.randrange(0, 80))]
        for p in r.sample(shared, r.randrange(0, 3)):
            at = r.randrange(len(w) + 1)
            cut = r.randrange(0, 3)
            w[at:at] = p[cut:]
        rows.append((i, " ".join(w)))
    r.shuffle(rows)
    return rows


def test_agrees_with_brute_force(make_docs):
    for window in (2, 7, 10, 25):
        rows = passages(window)
        assert result(make_docs(rows), window) == brute(rows, window)


def test_odd_rows(make_docs):
    for window in (4, 50):
        assert result(make_docs(ODD), window) == brute(ODD, window)


def test_empty_table(make_docs):
    assert sd.remove_repeats(make_docs([]), 50).count() == 0


def test_doubling_goes_on_until_no_candidate_survives(make_docs):
    text = " ".join(f"w{i}" for i in range(100))
    got = {(r.window, r.doc_id): r.n_windows for r in sd.grow(make_docs([text, text + " more"]), 10).collect()}
    assert got == {(10, 1): 91, (20, 1): 81, (40, 1): 61, (80, 1): 21}


def test_places(make_docs, spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = make_docs([text, text]).select("doc_id", "text")
    found = sd.repeated_windows(docs, Scratch(spark), 50).collect()
    assert [(r.doc_id, sorted(r.places)) for r in found] == [(1, list(range(11)))]


def test_rows_of_one_id(make_docs):
    """Each row loses its own windows alone, and there are as many rows as before."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (2, a + " x"), (2, a + " y"), (2, b), (2, a + " x"), (3, b + " z"), (1, "c"), (None, a)]
    for window in (7, 50):
        assert result(make_docs(rows), window) == brute(rows, window)
    got = {(r.doc_id, r.kept) for r in sd.remove_repeats(make_docs(rows), 50).collect()}
    assert got == {(1, None), (2, "x"), (2, "y"), (2, None), (3, "z"), (None, None)}


def crossed(seed):
    """Texts cut from few passages with words changed here and there, copies of all sizes, loops of words, ids that repeat."""
    r = random.Random(seed)
    base = [[f"b{k}_{i}" for i in range(90)] for k in range(3)] + [(["x", "y", "z"][: r.randrange(1, 4)] * 40)[:70]]
    rows = []
    for i in range(120):
        w = []
        for p in r.choices(base, k=r.randrange(1, 4)):
            a, b = sorted(r.randrange(len(p) + 1) for _ in range(2))
            w += p[a:b]
            if r.random() < 0.3:
                w.append(f"u{r.randrange(5)}")
        for _ in range(r.choice((0, 0, 1, 3)) if w else 0):
            w[r.randrange(len(w))] = f"c{r.randrange(3)}"
        rows += [(r.randrange(80), " ".join(w))] * r.choice((1, 1, 1, 2))
    r.shuffle(rows)
    return rows


def test_runs_that_agree_in_part(make_docs):
    for window in (10, 50):
        rows = crossed(window)
        assert result(make_docs(rows), window) == brute(rows, window)


def test_copies_move_by_runs(make_docs, spark, monkeypatch):
    """Of 3,000 words in each of 12 copies, no step writes a row for each window."""
    wrote = {}
    save = Scratch.save

    def counted(self, df, name):
        table = save(self, df, name)
        wrote[name] = table.count()
        return table

    monkeypatch.setattr(Scratch, "save", counted)
    text = " ".join(f"w{i}" for i in range(3000))
    docs = make_docs([text] * 12).select("doc_id", "text")
    found = {r.doc_id: len(r.places) for r in sd.repeated_windows(docs, Scratch(spark), 50).collect()}
    assert found == dict.fromkeys(range(1, 12), 2951)
    assert max(wrote.values()) < 12 * 2951 / 4


def shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for top in manager.localDirs() for _, _, files in os.walk(top.getPath()) for f in files if f.startswith("shuffle_")}


def test_shuffle_files_of_a_step_go_with_it(make_docs, spark, monkeypatch):
    left = []
    save = Scratch.save

    def watched(self, df, name):
        before, setting = shuffle_files(spark), spark.conf.get(SHUFFLES_GO, None)
        table = save(self, df, name)
        until = time.time() + 10
        while shuffle_files(spark) - before and time.time() < until:  # they go in the background
            time.sleep(0.1)
        left.append((name, len(shuffle_files(spark) - before)))
        assert spark.conf.get(SHUFFLES_GO, None) == setting
        return table

    monkeypatch.setattr(Scratch, "save", watched)
    text = " ".join(f"w{i}" for i in range(200))
    assert sorted(r.n_removed for r in sd.remove_repeats(make_docs([text] * 3), 50).collect()) == [0, 200, 200]
    assert len(left) > 9 and not any(n for _, n in left)
