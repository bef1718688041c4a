from __future__ import annotations

import math
import zlib
from fractions import Fraction

import pytest
from tests.conftest import same_rows
from tests.llm.conftest import ODD

from tracemill.llm import license_texts, licenses, mixing, sharding


@pytest.mark.parametrize("name", ["op3_mtree_top_k", "op4_source_mix", "op7_license_scan", "op8_substring_dedup", "op9_rendezvous_shards"])
def test_agrees_with_sql(spark, duck, sf_dir, name):
    import __spark_entry__ as entry

    same_rows(entry.queries()[name](spark, sf_dir).toPandas(), duck.execute(entry.oracle_sql()[name]).fetchdf())


def webster(weights, seats):
    """Seats one by one to the highest quotient, ties to the first."""
    got = [0] * len(weights)
    for _ in range(seats):
        k = max(range(len(weights)), key=lambda i: (Fraction(weights[i], 2 * got[i] + 1), -i))
        got[k] += 1
    return got


def test_apportionment_gives_each_seat_to_the_highest_quotient(spark):
    cases = [([5, 3, 1], 7), ([1, 1, 1], 2), ([1000, 1, 1, 1, 1, 1, 1, 1], 5), ([7, 0, 3], 4), ([0, 0], 0), ([10**6, 3, 17, 99, 10**5], 113)]
    rows = [(g, i, float(w), n) for g, (ws, n) in enumerate(cases) for i, w in enumerate(ws)]
    df = spark.createDataFrame(rows, "g int, i int, w double, seats long")
    got = {}
    for r in mixing.sainte_lague(df, "w", "seats", ["g"], "i", "won").collect():
        got[r.g, r.i] = r.won
    for g, (ws, n) in enumerate(cases):
        assert [got[g, i] for i in range(len(ws))] == webster(ws, n)


def test_targets_reshare_the_excess(spark):
    sizes = {"0a": 10, "0b": 1000, "0c": 1, "0d": 500, "1": 40}
    got = {r.source_key: r for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source_key string, source_size long")).collect()}
    want, weights, open_, left = {}, {k: i % 3 + 1 for i, k in enumerate(sorted(sizes))}, set(sizes), float(sum(sizes.values()))
    while True:
        share = {k: left * weights[k] / sum(weights[x] for x in open_) for k in open_}
        over = {k for k in open_ if share[k] > 3 * sizes[k]}
        if not over:
            want |= share
            break
        for k in over:
            want[k] = 3.0 * sizes[k]
            left -= want[k]
        open_ -= over
    for k, v in want.items():
        assert math.isclose(got[k].target, v)


def test_mix_of_odd_rows(make_docs):
    rows = mixing.mix(make_docs(ODD)).collect()
    assert len(rows) == len(ODD)
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix(make_docs(ODD)).collect()), key=repr)
    assert mixing.mix(make_docs([])).count() == 0
    assert [r.taken for r in mixing.mix(make_docs([None, ""])).collect()] == [0, 0]


def test_mix_comes_near_its_targets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    by = {}
    for r in mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect():
        s = by.setdefault(r.source, [r.target, 0])
        s[1] += r.taken
    assert all(abs(t - k) <= 2 * mixing.BLOCK for t, k in by.values())


def test_shards_of_odd_rows(make_docs):
    rows = sharding.assign(make_docs(ODD), 3).collect()
    assert len(rows) == len(ODD)
    for shard in range(3):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    texts = sorted((i is None, i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ODD)
    assert sorted((r.doc_id is None, r.doc_id, r["size"], r.text_crc32) for r in rows) == texts
    assert sharding.assign(make_docs([]), 3).count() == 0


def test_a_new_shard_takes_rows_only_into_itself_and_weights_hold(spark):
    from pyspark.sql import functions as F

    keys = spark.range(40_000).select(sharding.key_digest(F.col("id")).alias("d"))
    rows = keys.select(sharding.rendezvous(F.col("d"), [1.0, 1.0, 2.0]).alias("a"), sharding.rendezvous(F.col("d"), [1.0, 1.0, 2.0, 1.0]).alias("b")).collect()
    assert all(r.a == r.b or r.b == 3 for r in rows)
    share = [sum(r.a == k for r in rows) / len(rows) for k in range(3)]
    assert all(abs(s - w) < 0.02 for s, w in zip(share, (0.25, 0.25, 0.5)))
    assert abs(sum(r.b == 3 for r in rows) / len(rows) - 0.2) < 0.02


def test_licenses_of_odd_rows(make_docs):
    rows = licenses.scan(make_docs(ODD)).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert (by[6].n_base, by[6].first_word, by[6].last_word, by[6].base_labels) == (30000, 0, 59998, "mit")
    assert (by[7].n_words, by[7].n_base, by[7].first_word) == (4, 1, 2)
    assert (by[0].n_words, by[0].n_base, by[0].first_word, by[0].labels, by[0].score) == (0, 0, None, "", 0.0)
    assert licenses.scan(make_docs([])).count() == 0


def test_notices_with_changes_are_found_and_others_not(make_docs):
    texts = [
        "This file: licensed under the Apache-License, Version 2.0!",
        "licensed under the old Apache License, version 2.0",
        "Licensed under CC BY-NC 4.0.",
        "under the license of version 2",
        "the General Public Licence",
    ]
    got = {r.doc_id: (r.base_labels, r.labels) for r in licenses.scan(make_docs(texts)).collect()}
    assert got == {0: ("apache", "apache"), 1: ("apache", "apache"), 2: ("", "cc-by-nc"), 3: ("", ""), 4: ("", "")}


def edited(text, seed, every):
    """A license with one word in `every` replaced, dropped or doubled, in other case and punctuation."""
    import random

    r, out = random.Random(seed), []
    for i, w in enumerate(text.split()):
        kind = r.randrange(3) if i % every == every - 1 else None
        out += [] if kind == 1 else [w.upper(), w] if kind == 2 else ["changed"] if kind == 0 else [w]
    return " * ".join(out)


def test_whole_licenses_are_found_when_edited_and_told_apart(make_docs):
    filler = "the terms of the software and of the use of any work are those of the author in the case of a copy " * 30
    texts = [f"{filler} {edited(t, k, 14)} {filler}" for k, (t, _) in enumerate(license_texts.TEXTS)]
    got = {r.doc_id: r for r in licenses.scan(make_docs([*texts, filler])).collect()}
    for k, (t, label) in enumerate(license_texts.TEXTS):
        assert label in got[k].labels.split(","), label
        own = [x for x in got[k].spans.split(",") if x.startswith(f"{label}:")]
        low, high = map(int, own[0].split(":")[1].split("-"))
        n, before = len(licenses.Template(t, label).words()), len(licenses.Template(filler, "").words())
        assert before <= low <= before + 0.3 * n and high <= before + 1.2 * n
    assert [set(got[k].labels.split(",")) - {label} for k, (_, label) in enumerate(license_texts.TEXTS)] == [set()] * len(license_texts.TEXTS)
    assert got[len(texts)].labels == ""


def test_grams_of_other_lengths(make_docs):
    for k in (2, 3, 6):
        own = [licenses.Template(license_texts.ZLIB, "zlib", k=k, cover=0.5)]
        got = licenses.scan(make_docs([license_texts.ZLIB, "nothing of the kind", edited(license_texts.ZLIB, 1, 30)]), own).collect()
        assert {r.doc_id: r.labels for r in got} == {0: "zlib", 1: "", 2: "zlib"}
