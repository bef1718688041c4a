from __future__ import annotations

import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tests.llm.conftest import ODD

from tracemill.llm import decontaminate, language, toxicity
from tracemill.llm import textarrays as ta


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_gradients_agree_with_differences():
    r = np.random.default_rng(0)
    net = language.Network.new(3, hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    length = np.array([5, 1, 3, 4])
    x = r.integers(97, 105, (4, 5)).astype(np.uint8)
    x[np.arange(5) >= length[:, None]] = 0
    y = np.array([0, 1, 2, 1])
    _, grad = net.gradients(x, length, y)
    for name, value in net.p.items():
        for _ in range(6):
            at = tuple(int(x[0, 0]) if name[0] == "t" and d == 0 else int(r.integers(0, n)) for d, n in enumerate(value.shape))
            keep, step = value[at], 1e-2
            value[at] = keep + step
            up = net.gradients(x, length, y)[0]
            value[at] = keep - step
            down = net.gradients(x, length, y)[0]
            value[at] = keep
            assert abs((up - down) / (2 * step) - grad[name][at]) < 2e-3


def test_language_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    rows = [r for r in docs.select("doc_id", "lang").collect() if held(r.doc_id)]
    assert all(got[r.doc_id].held_out for r in rows)
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_a_document_gets_the_mean_over_its_letters():
    net = language.Network.new(2)
    texts = ["ab 1 CDé, ab", "", "1 !"]
    row, sums, letters = language._labels(net, 123, language.chunks(pa.array(texts)))
    b = np.frombuffer("ab cdé ab".encode(), dtype=np.uint8)[None]
    labels = net.label(b, np.array([b.shape[1]]))[:, :, 0]
    want = labels[[i for i, x in enumerate(b[0]) if x != 32]].sum(axis=0)
    assert np.allclose(sums[row == 0].sum(axis=0), want, atol=1e-5) and letters.sum() == 8 and set(row) == {0}


def test_labels_are_those_of_the_network_that_is_trained():
    r = np.random.default_rng(3)
    net, length = language.Network.new(3), np.array([9, 4, 7])
    x = r.integers(97, 123, (3, 9)).astype(np.uint8)
    x[np.arange(9) >= length[:, None]] = 0
    both = np.concatenate([net.states(x, length, w) for w in "fb"], axis=2)
    want = language._softmax(both @ net.p["v"] + net.p["c"]).transpose(0, 2, 1)
    got = net.label(x, length)
    assert all(np.allclose(got[: length[i], :, i], want[: length[i], :, i], atol=1e-5) for i in range(3))


def test_chunks_tile_texts_at_the_edges_of_characters():
    r = np.random.default_rng(4)
    texts = ["".join(r.choice(list("aé日😀 1"), int(n))) for n in r.integers(0, 900, 40)] + ["", "x" * language.CHUNK, "日" * 500]
    c = language.chunks(pa.array(texts))
    for i, text in enumerate(texts):
        cores = []
        for k in np.flatnonzero(c.row == i):
            c.data[c.start[k] : c.start[k] + c.length[k]].tobytes().decode()  # whole characters
            cores.append(c.data[c.start[k] + c.low[k] : c.start[k] + c.high[k]].tobytes().decode())
            assert c.length[k] <= language.CHUNK + 2 * language.CONTEXT + 6
        assert "".join(cores) == re.sub("[\0-@\\[-`{-\x7f]+", " ", text.translate({k: k + 32 for k in range(65, 91)})).lstrip(" ")


def test_a_label_depends_on_what_stands_beyond_the_word():
    net = language.Network.new(2)
    sums = [language._labels(net, k, language.chunks(pa.array([f"{w} and so on"])))[1] for k, w in enumerate(("abc", "xyz"))]
    b = [np.frombuffer(f"{w} and so on".encode(), dtype=np.uint8)[None] for w in ("abc", "xyz")]
    far = [net.label(x, np.array([x.shape[1]]))[6, :, 0] for x in b]
    assert not np.allclose(sums[0], sums[1], atol=1e-6) and not np.allclose(far[0], far[1], atol=1e-7)


def test_languages_without_spaces_told_by_the_order_of_characters(spark):
    """Both languages use the same characters as often; only what follows on what tells them apart."""
    r, rows = np.random.default_rng(5), []
    for i in range(240):
        text, lang = "", i % 2
        for _ in range(60):
            text += ("日月火", "月日火")[lang] if r.random() < 0.8 else ("月日火", "日月火")[lang]
        rows.append((i, text, "xy"[lang]))
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert np.mean([x.lang_pred == "xy"[x.doc_id % 2] for x in got if x.held_out]) > 0.9


def test_language_query_agrees_with_a_plain_network(spark, sf_dir):
    """All documents, byte by byte: the trained weights, one step and one chunk at a time."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known, packed = language.train(docs)
    p = {k: v.astype(np.float64) for k, v in language.Network.load(packed).p.items()}
    hidden = p["uf"].shape[0]

    def states(x, way):
        h, out = np.zeros(hidden), []
        for byte in x if way == "f" else x[::-1]:
            g, a = p[f"t{way}"][byte], h @ p[f"u{way}"]
            z, r = (1 / (1 + np.exp(-(g[i * hidden : (i + 1) * hidden] + a[i * hidden : (i + 1) * hidden]))) for i in (0, 1))
            n = np.tanh(g[2 * hidden :] + r * a[2 * hidden :])
            h = n + z * (h - n)
            out.append(h)
        return np.array(out if way == "f" else out[::-1])

    got = {r.doc_id: r for r in language.identify(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        c = language.chunks(pa.array([text or ""], pa.large_string()))
        total, letters = np.zeros(len(known)), 0
        for start, length, low, high in zip(c.start, c.length, c.low, c.high, strict=True):
            x = c.data[start : start + length]
            y = np.concatenate([states(x, "f"), states(x, "b")], axis=1) @ p["v"] + p["c"]
            y = np.exp(y - y.max(axis=1, keepdims=True))
            counted = [t for t in range(low, high) if chr(x[t]).isalpha() or x[t] >= 128]
            total += (y / y.sum(axis=1, keepdims=True))[counted].sum(axis=0)
            letters += len(counted)
        if not any(map(str.isalpha, text or "")):
            assert (got[doc_id].lang_pred, got[doc_id].score) == ("und", 0.0)
            continue
        mean = total / letters
        assert abs(got[doc_id].score - mean.max()) < 1e-3 and mean[known.index(got[doc_id].lang_pred)] > mean.max() - 1e-3


def test_every_language_is_learned_however_many_there_are(spark):
    rows = [(i, f"{chr(0x4E00 + i % 600)}{chr(0x5E00 + i % 600)} " * 12, f"l{i % 600:03d}") for i in range(2400)]
    rows += [(3000 + i, "common words of the largest language", "big") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    known = model[0]
    assert known == sorted({r.lang for r in language.labelled(docs).select("lang").distinct().collect()}) and len(known) > 590
    got = language.identify(docs.where("doc_id < 5 or doc_id >= 3590"), model=model).collect()
    assert len(got) == 15 and {r.lang_pred for r in got} <= set(known)


def test_language_of_odd_rows(make_docs):
    rows = language.identify(make_docs(ODD)).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert {i for i, r in by.items() if r.lang_pred == "und"} == {0, 1, 2, 8}
    assert all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert language.identify(make_docs([])).count() == 0
    assert {r.lang_pred for r in language.identify(make_docs(ODD).selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}


@pytest.fixture(scope="module")
def labelled(spark):
    r = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(1500):
        w = [words[k] for k in r.integers(0, 300, 60)]
        toxic = bool(r.random() < 0.2)
        if toxic:
            for bad in r.choice(["vilex", "vilest", "nastyone", "grr ugh"], 3):
                w.insert(int(r.integers(0, 60)), str(bad))
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_toxicity_held_out_accuracy(labelled):
    docs, labels, truth = labelled
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    rows = [i for i in truth if held(i)]
    assert all(got[i].held_out for i in rows) and all(r.predicted == (r.score >= 0.5) for r in got.values())
    assert np.mean([got[i].predicted == truth[i] for i in rows]) > 0.98
    at, w, _ = toxicity.train(docs, labels)
    assert 0 < len(at) < 2000  # sparse: the documents have over 100,000 n-grams


def test_toxicity_agrees_with_brute_force(spark, sf_dir):
    """Plain loops over dictionaries, on the supplied labels: the same scores."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    u = np.uint64

    def hashed(word):
        b = np.frombuffer(word, dtype=np.uint8)
        return ta.hashes(b, np.array([0]), np.array([len(b)]))[0]

    def cells(text):
        w = [x.lower().encode() for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        h = [hashed(x) for x in w]
        out = {int(ta.mix(np.array([x ^ u(1)]))[0]) for x in h}
        out |= {int(ta.mix(np.array([hashed(x[:n]) ^ u(n)]))[0]) for x in w for n in toxicity.STEMS if len(x) > n}
        for gap, salt in ((1, 12), (2, 13)):
            out |= {int(ta.mix(np.array([h[i]]) * u(3) + ta.mix(np.array([h[i + gap] ^ u(salt)])))[0]) for i in range(len(h) - gap)}
        return sorted({x % toxicity.CELLS for x in out})

    texts, marks = {d.doc_id: cells(d.text) for d in docs.collect()}, {}
    for x in labels.collect():
        if x.toxic is not None and not held(x.doc_id) and x.doc_id in texts:
            marks[x.doc_id] = max(marks.get(x.doc_id, 0), int(x.toxic == 1))
    z, n, order = {}, {}, sorted(marks)

    def weight(k):
        l1 = 0.0 if k == "bias" else toxicity.L1
        zk = z.get(k, 0.0)
        return 0.0 if abs(zk) <= l1 else -(zk - np.sign(zk) * l1) / ((toxicity.BETA + n.get(k, 0.0) ** 0.5) / toxicity.ALPHA + toxicity.L2)

    score = lambda own: 1 / (1 + np.exp(-np.clip(sum(map(weight, [*own, "bias"])), -35, 35)))
    r = np.random.default_rng(3)
    for _ in range(toxicity.EPOCHS):
        for i in r.permutation(len(order)):
            own = texts[order[i]]
            g = score(own) - marks[order[i]]
            for k, w in [(k, weight(k)) for k in [*own, "bias"]]:
                z[k] = z.get(k, 0.0) + g - ((n.get(k, 0.0) + g * g) ** 0.5 - n.get(k, 0.0) ** 0.5) / toxicity.ALPHA * w
                n[k] = n.get(k, 0.0) + g * g
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(texts) and all(abs(x.score - score(texts[x.doc_id])) < 1e-6 for x in got)


def test_toxicity_reads_all_documents_in_parallel(labelled):
    docs, labels, _ = labelled
    rows = toxicity.training_texts(docs.repartition(7), labels.union(labels))
    assert rows.count() == rows.select("doc_id").distinct().count()
    plan = rows.repartition(1)._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan and plan.index("Exchange SinglePartition") < plan.index("BroadcastHashJoin")
    twice = docs.union(docs.selectExpr("doc_id", "text || ' more'"))
    assert toxicity.training_texts(twice, labels).count() == rows.count()


def test_toxicity_doesnt_learn_from_held_out_labels(labelled):
    docs, labels, _ = labelled
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    a, b = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1]) and a[2] == b[2]


def test_toxicity_of_odd_rows(make_docs, spark):
    labels = spark.createDataFrame([(4, 1), (3, 0), (None, 1), (6, None), (99, 1)], "doc_id long, toxic int")
    rows = toxicity.toxicity(make_docs(ODD), labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    none = labels.where("false")
    assert {r.score for r in toxicity.toxicity(make_docs(ODD), none).collect()} == {0.5}
    assert toxicity.toxicity(make_docs([]), labels).count() == 0


def norm(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").lower())


def test_leaks_hold_all_verbatim_items(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    want = set()
    for d in docs.collect():
        text = " " + " ".join(norm(d.text)) + " "
        want |= {(d.doc_id, b.item_id) for b in items.collect() if " " + " ".join(norm(b.text)) + " " in text}
    assert want and want <= got
    assert len(got) <= len(want) + max(2, len(want) // 10)


def corpus(seed=3):
    r = np.random.default_rng(seed)
    words = np.array([f"t{i}" for i in range(3000)])
    p = 1 / np.arange(1, 3001)
    text = lambda n: words[r.choice(3000, n, p=p / p.sum())].tolist()
    items = [text(int(r.integers(15, 60))) for _ in range(40)]
    docs, want, clean = [], set(), set()
    for i in range(300):
        w = text(int(r.integers(40, 400)))
        if i % 3 == 0:
            k = int(r.integers(0, 40))
            own = list(items[k])
            for _ in range(i % 5 * len(own) // 30):  # up to about one word in eight is changed
                own[int(r.integers(0, len(own)))] = f"new{r.integers(0, 99)}"
            at = int(r.integers(0, len(w)))
            w[at:at] = own
            want.add((i, k))
        else:
            clean.add(i)
        docs.append((i, " ".join(w)))
    return docs, [(k, " ".join(x)) for k, x in enumerate(items)], want, clean


def test_leaks_with_changed_words_are_found_and_clean_documents_left(spark):
    docs, items, want, clean = corpus()
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert len(want & got) >= 0.97 * len(want)
    assert not {i for i, _ in got} & clean


def test_cosine_candidates_reach_the_recall_of_all_windows():
    """The latent space against plain TF-IDF cosines of every window and item: at least 0.9 of the pairs over the threshold."""
    docs, items, _, _ = corpus(5)
    idf = np.ones(decontaminate.CELLS)
    parts, _ = decontaminate.passages([(k, t, None) for k, t in items])
    a = []
    for p in parts:
        at, n = np.unique(p, return_counts=True)
        v = n * idf[at]
        a.append((at, v / np.sqrt((v * v).sum())))
    used = np.unique(np.concatenate([at for at, _ in a]))
    dense = np.zeros((len(a), len(used)))
    for k, (at, v) in enumerate(a):
        dense[k, np.searchsorted(used, at)] = v
    z = dense.T @ (dense @ decontaminate._signs(used, decontaminate.RANK))
    basis = np.linalg.svd(z, full_matrices=False)[0]
    z = dense.T @ (dense @ basis)
    basis = np.linalg.svd(z, full_matrices=False)[0]
    hit = total = 0
    for _, t in docs[:100]:
        c = decontaminate.cells(ta.tokens(pa.array([t])))
        for s in range(0, len(c), decontaminate.STEP):
            at, n = np.unique(c[s : s + decontaminate.WINDOW], return_counts=True)
            v = np.zeros(len(used))
            inside = np.isin(at, used)
            v[np.searchsorted(used, at[inside])] = n[inside]
            size = np.sqrt((n * n).sum())
            exact, latent = dense @ v / size, (dense @ basis) @ (basis.T @ v) / size
            over = exact >= decontaminate.COSINE
            total += over.sum()
            hit += (over & (latent >= decontaminate.COSINE - 1e-9)).sum()
    assert total > 50 and hit >= 0.9 * total


def test_answers_are_asked_for_where_words_were_changed(spark):
    item = " ".join(f"q{i}" for i in range(30))
    changed = item.replace("q7", "other").replace("q12", "words").replace("q20", "here").replace("q25", "too")
    docs = spark.createDataFrame([(0, item), (1, changed), (2, changed + " it is forty two"), (3, "forty two")], "doc_id long, text string")
    items = spark.createDataFrame([(0, item, "Forty two")], "item_id long, text string, answer string")
    assert {r.doc_id for r in decontaminate.leaks(docs, items, answer="answer").collect()} == {0, 2}
    assert {r.doc_id for r in decontaminate.leaks(docs, items).collect()} == {0, 1, 2}


def test_leaks_of_odd_rows(make_docs, spark):
    items = spark.createDataFrame([(0, None), (1, ""), (2, "a b c d e f g h"), (2, "a b c d e f g h"), (None, "one"), (3, "mit license mit"), (4, "123 456")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(make_docs(ODD), items).collect()}
    assert got == {(4, 2), (5, 2), (None, 2), (3, None), (6, 3), (8, 4)}
    assert decontaminate.leaks(make_docs([]), items).count() == 0
    assert decontaminate.leaks(make_docs(ODD), items.where("false")).count() == 0


def many_items(n=2000, seed=11):
    r = np.random.default_rng(seed)
    words = np.array([f"t{i}" for i in range(3000)])
    p = 1 / np.arange(1, 3001)
    text = lambda n: words[r.choice(3000, n, p=p / p.sum())].tolist()
    items = [text(int(r.integers(16, 60))) for _ in range(n)]
    docs, want = [], set()
    for i in range(0, n, 4):
        w = text(120)
        w[50:50] = items[i]
        docs.append((i, " ".join(w)))
        want.add((i, i))
    return docs, [(k, " ".join(x)) for k, x in enumerate(items)], want


def test_a_benchmark_of_many_more_passages_than_dimensions_loses_no_verbatim_leak(spark):
    docs, items, want = many_items()
    assert len(items) > 4 * decontaminate.RANK
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): r for r in found}
    assert len(want & got.keys()) >= 0.99 * len(want)
    assert len(got.keys() - want) <= len(want) // 50


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8, 10, 12, 15, 24, 33, 65, 100])
def test_short_items_among_rare_words_are_found(spark, n):
    r = np.random.default_rng(n)
    common, item = [f"c{i}" for i in range(40)], [f"c{i}" for i in r.integers(0, 40, n)]
    docs = []
    for i in range(200):  # words of one text only around the item, common words in most texts
        w = [f"own{i}x{k}" for k in range(60)] + [common[k] for k in r.integers(0, 40, 30)]
        r.shuffle(w)
        if i % 4 == 0:
            w[30:30] = item
        docs.append((i, " ".join(w)))
    changed = [*item[: n // 2], "else", *item[n // 2 + 1 :]]
    docs.append((999, " ".join(f"z{k}" for k in range(40)) + " " + " ".join(changed) + " " + " ".join(f"y{k}" for k in range(40))))
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")).collect()
    got, text = {r.doc_id for r in found}, " ".join(item)
    want = {i for i, t in docs if f" {text} " in f" {t} "}
    assert want <= got
    if 1 < n < decontaminate.WINDOW + decontaminate.STEP:  # one that a window lies within is left to the cosine, which words of all texts hardly move
        assert (n < decontaminate.SHORT) == (999 not in got)
    assert all(r.score < 1.0 for r in found if r.doc_id not in want)


def test_passages_that_keep_too_little_are_looked_up_by_rare_words(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "RANK", 4)
    r = np.random.default_rng(12)
    text = lambda n: [f"t{i}" for i in r.integers(0, 900, n)]
    items = [text(1500), text(1200)]  # many passages of one item: more than the dimensions of its group
    docs = []
    for i, x in enumerate(items):
        own = list(x)
        for k in range(3, len(own), 8):
            own[k] = "changed"
        docs += [(2 * i, " ".join(text(200) + x + text(100))), (2 * i + 1, " ".join(text(50) + own + text(300)))]
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(0, 0), (1, 0), (2, 1), (3, 1)}


def test_windows_left_out_cant_reach_the_least_cosine():
    r = np.random.default_rng(8)
    counts = [int(x) for x in r.integers(0, 90, 30)]
    first = np.concatenate([[0], np.cumsum(counts)])
    c = r.integers(0, 40, first[-1])
    known = np.where(c < 25, c, -1)
    square = r.random(25) * 9
    n = -(-np.array(counts) // decontaminate.STEP)
    text = np.repeat(np.arange(30), n)
    begin = first[text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * decontaminate.STEP
    end = np.minimum(begin + decontaminate.WINDOW, first[text + 1])
    want = [sum(k * k * square[w] for w, k in zip(*np.unique(known[b:e][known[b:e] >= 0], return_counts=True), strict=True)) for b, e in zip(begin, end, strict=True)]
    assert np.allclose(decontaminate._squares(known, square, begin, end), want)


def test_an_item_of_a_hundred_thousand_words(spark):
    """Its passages are many groups; it is found unchanged, and with a word in ten changed, in time and memory that grow with its length."""
    r = np.random.default_rng(21)
    item = [f"t{i}" for i in r.integers(0, 5000, 100_000)]
    changed = list(item)
    for k in range(5, len(item), 10):
        changed[k] = f"new{k % 77}"
    other = [f"t{i}" for i in r.integers(0, 5000, 3000)]
    docs = [(0, " ".join(other + item)), (1, " ".join(changed + other)), (2, " ".join(other)), (3, " ".join(item[:40_000]))]
    began = time.perf_counter()
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item)), (8, "t1 t2 t3 never met")], "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in found} == {(0, 7), (1, 7)}
    assert {x.doc_id: x.first_word for x in found}[0] == 3000 and time.perf_counter() - began < 240


def test_the_latent_space_comes_from_all_passages_and_frequencies_from_all_documents(spark):
    docs, items, _, _ = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    of = lambda t: np.unique(decontaminate.cells(ta.tokens(pa.array([t]))))
    weights, groups, *_ = next(iter(decontaminate.models(frame, spark.createDataFrame(items, "item_id long, text string")))).value
    df = np.bincount(np.concatenate([of(t) for _, t in docs]), minlength=decontaminate.CELLS)
    assert np.allclose(weights, np.maximum(0.05, np.log((len(docs) + 1.0) / (df + 1.0)) - decontaminate.COMMON))
    parts, _ = decontaminate.passages([(k, t, None) for k, t in items])
    (used, basis, latent, of_item), = groups
    # no word of a document alone has a part in it, and no passage is left out: all of each lies in the space
    assert np.array_equal(used, np.unique(np.concatenate(parts))) and len(of_item) == len(parts) >= basis.shape[1]
    assert ((latent * latent).sum(axis=1) > 0.999).all()
