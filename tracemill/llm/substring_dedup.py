"""Removal of word windows that an earlier document holds, found by level-wise doubling.

The lengths double up to that of the windows (13, 25 and 50 words). At each length below it a text marks only those of
its short windows that have the smallest hash within some full window that is still a candidate: equal full windows
mark equal short ones, so one mark stands for each full window. Marks that only one document holds drop out, and with
them their full windows; the others are extended to the next length. At the last one, the full windows that remain are
looked at themselves, and the smallest document of each is found. Consecutive ones that share a mark move as one row, a
run: runs that are equal as a whole need no look at their windows, and of those that share a mark and differ elsewhere,
only the first document's go window by window. grow() doubles further, for reports of how long the repeats are: the
windows that repeat at one length are extended to twice that length, until no candidate survives.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .shared import Scratch, keep_ids

WINDOW = 50
#: No level below so many words, but for one.
LEAST = 12
_U = np.uint64
_MOST = _U(0xFFFFFFFFFFFFFFFF)
_OTHER = _U(0xD1B54A32D192ED03)


def window_hash(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of h[i : i + size] for each i, by prefix sums; windows may cross texts, the caller drops those."""
    if len(h) < size:
        return np.zeros(0, _U)
    out = np.empty(len(h) - size + 1, dtype=_U)
    power = ta.powers()
    step = len(power) - 1 - size
    for lo in range(0, len(out), step):
        part = h[lo : lo + step + size - 1]
        total = np.zeros(len(part) + 1, dtype=_U)
        np.cumsum(part * power[: len(part)], out=total[1:])
        n = len(part) - size + 1
        out[lo : lo + n] = (total[size:] - total[:n]) * power[len(power) - 1 - np.arange(n)]
    return ta.mix(out)


def sliding(x: np.ndarray, size: int, pick=np.minimum) -> np.ndarray:
    """pick over x[i : i + size] for each i, in a logarithmic number of passes."""
    have, out = 1, x
    while have < size:
        step = min(have, size - have)
        out = pick(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def levels(window: int) -> list[int]:
    """Lengths up to the window's, each half of the next, rounded up."""
    out = [window]
    while len(out) == 1 or out[0] > 2 * LEAST:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _alive(run: pa.RecordBatch, w: ta.Words, h: np.ndarray) -> np.ndarray:
    """Hashes where `places` says that a window is repeated, the largest value elsewhere."""
    alive = np.full(len(h), _MOST, dtype=_U)
    for i, places in enumerate(ta.column(run, "places")):
        at = places.values.to_numpy() + w.first[i]
        at = at[at < min(len(h), w.first[i + 1])]
        alive[at] = h[at]
    return alive


def _full(w: ta.Words, window: int) -> np.ndarray:
    """Which places start a window that lies within one text."""
    row = w.row
    return row[: len(row) - window + 1] == row[window - 1 :]


def _marked(run: pa.RecordBatch, w: ta.Words, h: np.ndarray, span: int) -> np.ndarray:
    """Whether the smallest of h[i : i + span] is that of a repeated mark, for each i."""
    return sliding(_alive(run, w, h), span) == sliding(h, span)


def _level(batches: Iterator[pa.RecordBatch], window: int, size: int, before: int | None) -> Iterator[pa.RecordBatch]:
    """Marks of length `size` for the full windows whose mark of length `before` is repeated, all at first; at the last level, these windows."""
    for run in ta.runs(batches):
        w = ta.words(ta.column(run, "text"))
        if len(w.hash) < window:
            continue
        full = _full(w, window)
        if before is not None:
            full &= _marked(run, w, window_hash(w.hash, before), window - before + 1)
        h = window_hash(w.hash, size)
        if size == window:
            at = np.flatnonzero(full)
        else:
            span = window - size + 1
            padded = np.zeros(len(h) + span - 1, dtype=_U)
            padded[span - 1 : span - 1 + len(full)] = np.where(full, sliding(h, span), _U(0))
            at = np.flatnonzero((sliding(padded, span, np.maximum) == h) & (h > 0))
        yield _placed(run, w, size, h, at)


def _placed(run: pa.RecordBatch, w: ta.Words, size: int, h: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Windows by two hashes, h and g, that share no arithmetic but the words' own hashes, and their row and place."""
    row = w.row[at]
    g = window_hash(ta.mix(w.hash + _OTHER), size)[at]
    take = pa.array(row)
    return pa.record_batch([pa.array(ta.signed(h[at])), pa.array(ta.signed(g)), ta.column(run, "doc_id").take(take), ta.column(run, "v").take(take), pa.array((at - w.first[row]).astype(np.int32))], names=["h", "g", "doc_id", "v", "pos"])


def _runs(batches: Iterator[pa.RecordBatch], window: int, before: int) -> Iterator[pa.RecordBatch]:
    """Runs of full windows that share a repeated mark of length `before`.

    h: the mark; t and g, by hashes as in _placed(): the run's words; where its first window starts, and how many more
    windows follow.
    """
    span = window - before + 1
    for run in ta.runs(batches):
        w = ta.words(ta.column(run, "text"))
        if len(w.hash) < window:
            continue
        h = window_hash(w.hash, before)
        at = np.flatnonzero(_full(w, window) & _marked(run, w, h, span))
        mark = sliding(np.arange(len(h)), span, lambda a, b: np.where(h[b] < h[a], b, a))[at]  # the leftmost smallest
        new = np.ones(len(at), dtype=bool)
        new[1:] = (mark[1:] != mark[:-1]) | (at[1:] != at[:-1] + 1)
        first, last, mark = at[new], at[np.append(new[1:], True)[: len(at)]], mark[new]
        more = last - first  # less than a window, so that the first and the last window hold all the run's words
        t, g = (ta.mix((more.astype(_U) * ta._BASE + x[first]) * ta._BASE + x[last]) for x in (window_hash(w.hash, window), window_hash(ta.mix(w.hash + _OTHER), window)))
        row = w.row[first]
        take = pa.array(row)
        columns = [*(pa.array(ta.signed(x)) for x in (h[mark], t, g)), ta.column(run, "doc_id").take(take), ta.column(run, "v").take(take)]
        yield pa.record_batch([*columns, pa.array((first - w.first[row]).astype(np.int32)), pa.array(more.astype(np.int32))], names=["h", "t", "g", "doc_id", "v", "pos", "more"])


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The windows at the given places."""
    for run in ta.runs(batches):
        w = ta.words(ta.column(run, "text"))
        if len(w.hash) < window:
            continue
        h = window_hash(w.hash, window)
        yield _placed(run, w, window, h, np.flatnonzero((_alive(run, w, h) != _MOST) & _full(w, window)))


def _doubled(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Windows of twice the length of which both halves are repeated."""
    for run in ta.runs(batches):
        w = ta.words(ta.column(run, "text"))
        if len(w.hash) < 2 * size:
            continue
        both = _alive(run, w, window_hash(w.hash, size)) != _MOST
        row = w.row
        n = len(row) - 2 * size + 1
        yield _placed(run, w, 2 * size, window_hash(w.hash, 2 * size), np.flatnonzero(both[:n] & both[size : size + n] & (row[:n] == row[2 * size - 1 :])))


def _remove(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for run in ta.runs(batches):
        w = ta.words(ta.column(run, "text"), hashed=False)
        removed, digests, kept = [], [], []
        for i, places in enumerate(ta.column(run, "places")):
            n = int(w.counts[i])
            edge = np.zeros(n + window + 1, dtype=np.int64)
            at = places.values.to_numpy() if places.is_valid else np.zeros(0, np.int64)
            at = at[at + window <= n]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + window, -1)
            keep = np.cumsum(edge)[:n] == 0
            text = b" ".join(x for x, k in zip(w.texts(w.first[i], w.first[i + 1]), keep, strict=True) if k)
            removed.append(n - int(keep.sum()))
            digests.append(hashlib.sha256(text).hexdigest())
            kept.append(text.decode() if removed[-1] else None)
        yield pa.record_batch([ta.column(run, "doc_id"), pa.array(w.counts), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in ta.runs(batches):
        split = [x.as_buffer().to_pybytes().split() if x.is_valid else [] for x in ta.column(run, "text").cast(pa.large_binary())]
        yield pa.record_batch([ta.column(run, "doc_id"), pa.array([len(x) for x in split], pa.int64()), pa.array([hashlib.sha256(b" ".join(x)).hexdigest() for x in split])], names=["doc_id", "n_words", "whole_sha256"])


def _repeated(rows: DataFrame) -> DataFrame:
    """h, g and the smallest doc_id that holds them, for hashes of more than one document; aggregated before it moves."""
    return rows.groupBy("h", "g").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("h", "g", "low")


def _places(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id", "v").agg(F.collect_set("pos").alias("places"))  # no more than a text has words, however often its row is repeated


def _run_places(runs: DataFrame) -> DataFrame:
    """As _places(), of all windows of the runs; those of one text don't overlap."""
    each = F.transform(F.collect_set(F.struct("pos", "more")), lambda r: F.sequence(r["pos"], r["pos"] + r["more"]))
    return runs.groupBy("doc_id", "v").agg(F.flatten(each).alias("places"))


_ROWS = "h long, g long, doc_id long, v long, pos int"
_RUNS = "h long, t long, g long, doc_id long, v long, pos int, more int"


def _versions(docs: DataFrame) -> DataFrame:
    """docs with v, by which different texts of one doc_id are told apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("v", F.xxhash64("text"))


def _with_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    return keep_ids(docs, places).join(places, ["doc_id", "v"]).select("doc_id", "v", "text", "places")


def _narrowed(docs: DataFrame, scratch: Scratch, window: int) -> tuple[DataFrame, int]:
    """(places of the repeated marks of the last length below the window's, that length)."""
    alive, before = None, None
    for size in levels(window)[:-1]:
        texts = docs if alive is None else _with_places(docs, alive)
        rows = scratch.save(texts.mapInArrow(lambda it, size=size, before=before: _level(it, window, size, before), _ROWS), f"level{size}")
        # the repeated hashes are written first, so that both sides of the join are plain shuffles and a hot hash's rows can be split
        again = scratch.save(_repeated(rows), f"repeated{size}")
        if alive is not None:
            scratch.drop(alive)
        alive, before = scratch.save(_places(rows.join(again.select("h", "g"), ["h", "g"])), f"alive{size}"), size
        scratch.drop(rows, again)
    return alive, before


def _texts(docs: DataFrame) -> DataFrame:
    return _versions(docs).where("doc_id is not null and text is not null")


def repeated_windows(docs: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, v, places): starts of the windows that a smaller doc_id holds too; v is the hash of the text."""
    docs = _texts(docs)
    alive, before = _narrowed(docs, scratch, window)
    runs = scratch.save(_with_places(docs, alive).mapInArrow(lambda it: _runs(it, window, before), _RUNS), "runs")
    scratch.drop(alive)
    equal = scratch.save(runs.groupBy("h", "t", "g").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")), "equal")
    # marks with several runs: equal windows may lie in runs that differ
    mixed = equal.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).where("n > 1 and low < high")
    mixed = scratch.save(mixed.select("h", F.lit(True).alias("mixed")), "mixed")
    told = scratch.save(equal.join(mixed, "h", "left").where("low < high or mixed").select("h", "t", "g", "low", F.coalesce("mixed", F.lit(False)).alias("mixed")), "told")
    scratch.drop(equal, mixed)
    met = runs.join(told, ["h", "t", "g"]).where("doc_id > low or mixed")
    met = scratch.save(met.select("doc_id", "v", "pos", "more", (F.col("doc_id") > F.col("low")).alias("later")), "met")
    scratch.drop(runs, told)
    # the smallest document that holds a window holds it in a run that no smaller one has as a whole: only such runs go window by window
    first = scratch.save(_run_places(met.where("not later")), "first")
    rows = scratch.save(_with_places(docs, first).mapInArrow(lambda it: _windows(it, window), _ROWS), "windows")
    scratch.drop(first)
    again = scratch.save(_repeated(rows), "repeated")
    single = rows.join(again, ["h", "g"]).where("doc_id > low").select("doc_id", "v", "pos", F.lit(0).alias("more"))
    found = scratch.save(_run_places(met.where("later").drop("later").unionByName(single)), "found")
    scratch.drop(met, rows, again)
    return found


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_words, n_removed, kept_sha256, kept), one row for each row of docs.

    A word goes if it is covered by a window of `window` words whose word sequence also starts in a document with a
    smaller doc_id; all windows are judged on the input. kept: the words that stay, joined by one space, null where
    nothing was removed. Null, empty and short texts have no windows. Rows without doc_id neither lose words nor cost
    others theirs. Rows of one doc_id don't remove each other's words, and each loses its own windows alone. Texts move
    only to places that go in them, and nothing moves after that. An empty table gives no rows.
    """
    if window < 2:
        raise ValueError("a window has at least two words")
    docs = _versions(docs)
    found = repeated_windows(docs, Scratch(docs.sparkSession, tidy=True), window)
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    cut = keep_ids(docs, found).join(found, ["doc_id", "v"], "left").select("doc_id", "text", "places")
    plain = keep_ids(docs, found, others=True).mapInArrow(_plain, "doc_id long, n_words long, whole_sha256 string")
    plain = plain.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("whole_sha256").alias("kept_sha256"), F.lit(None).cast("string").alias("kept"))
    return cut.mapInArrow(lambda it: _remove(it, window), out).unionByName(plain)


def grow(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs(doc_id, text) -> (window, doc_id, n_windows): at each doubled length, documents with windows that a smaller doc_id holds, until none survives.

    Each length reads only the documents and places that repeat at the one before.
    """
    scratch, size, out = Scratch(docs.sparkSession, tidy=True), window, None
    docs = _texts(docs)
    alive, before = _narrowed(docs, scratch, window)
    rows = scratch.save(_with_places(docs, alive).mapInArrow(lambda it: _level(it, window, window, before), _ROWS), "level")
    again = scratch.save(_repeated(rows), "repeated")
    scratch.drop(alive)
    while True:
        met = scratch.save(rows.join(again, ["h", "g"]).select("doc_id", "v", "pos", "low").distinct(), "met")
        scratch.drop(rows, again)
        level = scratch.save(met.where("doc_id > low").groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n_windows")).select(F.lit(size).alias("window"), "doc_id", "n_windows"), "grown")
        out = level if out is None else out.unionByName(level)
        if met.isEmpty():
            return out
        alive = scratch.save(_places(met), "alive")
        scratch.drop(met)
        rows = scratch.save(_with_places(docs, alive).mapInArrow(lambda it, size=size: _doubled(it, size), _ROWS), "doubled")
        again = scratch.save(_repeated(rows), "repeated")
        size *= 2


ORACLE = r"""
with t as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (
  select doc_id, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) as h
  from (select doc_id, w, unnest(range(0, len(w) - 49)) as i from t where len(w) >= 50)),
low as (select h, min(doc_id) as d from win group by h having min(doc_id) < max(doc_id)),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as p from (select win.doc_id, i from win join low using (h) where d < win.doc_id)),
kept as (
  select doc_id, string_agg(w[p + 1], ' ' order by p) as s, count(*) as n
  from (select doc_id, w, unnest(range(0, len(w))) as p from t) anti join gone using (doc_id, p) group by doc_id)
select t.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(s, '')) as kept_sha256
from t left join kept using (doc_id)
"""
