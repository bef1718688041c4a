from __future__ import annotations

import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.conftest import DATA
from tests.llm.conftest import ODD
from tests.llm.test_ngram_join import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_over_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, DATA).persist()
        assert docs.columns == columns
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert seen["language_id"].keys() == {r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if any(map(str.isalpha, r.text or ""))}
    classes = brute(sorted(seen["language_id"].items()), 5, 80)
    assert seen["near_duplicates"].keys() == {i for i, _, c in classes if i == c}
    norm = lambda t: " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").lower())) + " "
    items = [norm(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert seen["decontamination"].keys() == {i for i, t in seen["near_duplicates"].items() if not any(x in norm(t) for x in items)}
    # the mix by plain sums: each source's words near its target, no row more than three times
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    size = Counter()
    for i, t in seen["decontamination"].items():
        size[source[i]] += words(t)
    target, weight = {}, {s: k % 3 + 1 for k, s in enumerate(sorted(size))}
    while open_ := [s for s in size if s not in target]:
        left = sum(size.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * size[s]]
        target |= {s: 3 * size[s] for s in over} if over else share
    got, copies = Counter(), Counter(r.doc_id for r in docs.collect())
    for i, n in copies.items():
        got[source[i]] += n * words(seen["decontamination"][i])
    assert max(copies.values()) <= 3
    longest = max(words(t) for t in seen["decontamination"].values())
    assert all(abs(got[s] - target[s]) <= longest for s in size)
    out = cp.STAGES[-1][1](spark, docs, DATA)
    assert out.count() == docs.count()
    rows = sorted(map(tuple, out.collect()))
    assert sorted(map(tuple, cp.run(spark, DATA).collect())) == rows


def test_each_stage_on_odd_rows(make_docs):
    """Nulls in each column, empty and long texts, ties and repeated rows: what each stage keeps of them."""
    docs = make_docs(ODD)
    kept = lambda df: Counter((r.doc_id, (r.text or "")[:20]) for r in df.collect())
    spark, all_rows = docs.sparkSession, kept(docs)
    run = {name: lambda df, stage=stage: stage(spark, df, DATA) for name, stage in cp.STAGES}
    letters = Counter({k: n for k, n in all_rows.items() if any(map(str.isalpha, k[1]))})
    assert kept(run["language_id"](docs)) == letters
    linked = {(4, "a b c d e f g h"): 1, (None, "a b c d e f g h"): 1}  # 5, in two rows, is linked with 4; a row without id with nothing
    others = {k: n for k, n in all_rows.items() if k[1] != "a b c d e f g h"}
    assert kept(run["near_duplicates"](docs)) == Counter(others | linked)
    assert kept(run["decontamination"](docs)) == all_rows
    words = Counter({k: n for k, n in all_rows.items() if k[1].split()})
    assert set(kept(run["mixing"](docs))) <= set(words)
    assert run["sharding"](docs).count() == len(ODD)
    for name, stage in run.items():
        assert stage(docs.where("false")).count() == 0, name


def test_a_repeated_doc_id_stays_in_one_row(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (2, text), (3, "other words"), (3, "another text"), (4, ""), (4, ""), (None, text), (None, text)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    got = sorted((r.doc_id or 0, r.text) for r in cp.near_duplicates(spark, docs, DATA).collect())
    assert got == sorted([(0, text), (0, text), (1, text), (3, "another text"), (4, "")])


def test_mixing_takes_rows_one_by_one(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(None if i % 2 else 7, text(i), "en", "s", 100) for i in range(60)]  # one source: all is taken once
    got = cp.mixing(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), DATA).collect()
    assert Counter(map(tuple, got)) == Counter(rows)


def test_mixing_keeps_a_hot_id_to_its_target(spark):
    rows = [(1, " ".join(["w"] * 32), "en", "a", 64)] * 300 + [(1000 + i, " ".join(["v"] * 32), "en", "b", 64) for i in range(300)]
    got = Counter(r.source for r in cp.mixing(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), DATA).collect())
    assert got == {"a": 200, "b": 400}  # weights 1 and 2 of all words


def test_decontamination_drops_rows_without_id(spark):
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    rows = [(None, f"before {item} after"), (None, "clean words here"), (3, f"{item} more"), (3, "other clean words")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id or 0, r.text) for r in cp.decontamination(spark, docs, DATA).collect()) == [(0, "clean words here"), (3, "other clean words")]


def test_language_stage_without_a_row_to_learn_from_keeps_letters(spark):
    rows = [(i, f"some words {i}", "en" if zlib.crc32(str(i).encode()) % 5 == 0 else None, "s", 9) for i in range(40)] + [(50, "123", None, "s", 3), (51, None, "en", "s", 0)]
    got = {r.doc_id for r in cp.language_id(spark, spark.createDataFrame(rows, DOCS), DATA).collect()}
    assert any(r[2] for r in rows[:40]) and got == set(range(40))


def test_language_stage_rejects_by_score(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(cp.DOCUMENT)
    score = {r.doc_id: r.score for r in cp.identify(docs).where("lang_pred <> 'und'").collect()}
    for sure in (cp.SURE, 0.8):
        monkeypatch.setattr(cp, "SURE", sure)
        least = cp.least_score(docs.where("lang is not null").select("lang").distinct().count())
        got = {r.doc_id for r in cp.language_id(spark, docs, DATA).collect()}
        assert got == {i for i, s in score.items() if s >= least}
    assert got != score.keys()


def test_least_score_lies_between_chance_and_certainty():
    assert cp.least_score(1) == 0.0
    assert abs(cp.least_score(4) - 0.375) < 1e-12
    assert all(1 / n < cp.least_score(n) < 1 for n in range(2, 600))


def test_language_stage_names_what_has_no_language(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(cp.DOCUMENT)
    some = docs.withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.col("lang")))
    predicted = {r.doc_id: r.lang_pred for r in cp.identify(some).collect()}
    rows = cp.language_id(spark, some, DATA).collect()
    assert any(r.doc_id % 3 == 0 for r in rows)
    true = {r.doc_id: r.lang for r in docs.collect()}
    assert all(r.lang == (predicted if r.doc_id % 3 == 0 else true)[r.doc_id] for r in rows)


def test_what_executors_hold(spark):
    """Workers and their batches stay through all stages: a Python process holds no large table, and the stages lower the session's batches to one run."""
    import numpy as np

    from tracemill.llm import textarrays as ta

    assert sum(x.nbytes for x in vars(ta).values() if isinstance(x, np.ndarray)) < 1 << 20
    for name, stage in cp.STAGES[:3]:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{8 << 20}b")
        stage(spark, spark.createDataFrame([(1, "some words", "en", "a", 10)], DOCS), DATA)
        assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= ta.RUN_BYTES, name


def test_hashes_of_words_of_any_length():
    """The sum of (hash of a byte) * base ** place, over bytes 1 and on, scaled, plus the length: also beyond the segments that are hashed at once."""
    import numpy as np
    import pyarrow as pa

    from tracemill.llm import textarrays as ta

    base, texts = int(ta._BASE) | 1, ["ab " * 30000 + "c", "x" * 65535, "y" * 65536 + " z", "z" * 65537, "w" * 200000 + " ab"]
    w = ta.words(pa.array(texts))
    for k in [0, 21844, 21845, 21846, 29999, 30000, *range(30001, len(w.hash))]:
        total = 0
        for b in reversed(w.data[w.start[k] : w.end[k]].tolist()):
            total = (total + int(ta._BYTE[b])) * base % (1 << 64)
        n = int(w.end[k] - w.start[k])
        value = (total * pow(base, ta._SCALE + 1, 1 << 64) + n) % (1 << 64)
        assert w.hash[k] == ta.mix(np.array([value], dtype=np.uint64))[0]
