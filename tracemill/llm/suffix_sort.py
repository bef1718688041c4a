"""Removal of byte strings that stand earlier in the corpus, by a radix sort of suffixes that stops at the threshold.

Two suffixes matter to each other only where they agree in their first `window` bytes, so the sort goes no deeper: passes
from the most significant digit on split groups of suffixes, suffixes alone in their group drop out of all later passes,
and the groups that are left at the threshold are exactly the repeated windows.

Consecutive suffixes move together. Among the digits (half a window of bytes) within a window, the first of those with
the smallest hash is its anchor; equal windows have it at the same place. The suffixes that share an anchor are a run.

1. Digit at the anchor: one row for each run. Runs whose digit stands nowhere else drop out.
2. All other digits of a run at once. Of equal runs the earliest stays, all others are covered by it.
3. Runs with the same anchor digit but other digits around it: both digits of each suffix alone. Of equal suffixes the
   earliest stays, the others are covered.

No suffix of a run that dropped out equals any other; the first occurrence of every window lies in a run that stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .merkle import numbered
from .shared import HashFilter, Scratch, keep_ids
from .substring_dedup import sliding

WINDOW = 100
#: Bytes of text that are hashed at once: their arrays stay within a core's cache and aren't mapped anew each time.
PART_BYTES = 1 << 16
_U = np.uint64


def digit_size(window: int) -> int:
    """Half a window, rounded up: two digits make a window, and one lies within every window that holds the anchor."""
    return (window + 1) // 2


def segments(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray, int]]:
    """(batch, first row, bytes, offsets of the texts in these, bytes of the text before them).

    Short texts come many at once; one of over two parts comes in parts that share window - 1 bytes, so that each of its
    windows lies in one part.
    """
    size = min(PART_BYTES, ta.RUN_BYTES)
    for batch in batches:
        data, at = ta.raw(ta.column(batch, "text"))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + size, side="right")) - 1)
            text = data[at[i] : at[j]]
            if j > i + 1 or len(text) <= 2 * size:
                yield batch, i, text, at[i : j + 1] - at[i], 0
            else:
                for lo in range(0, len(text) - window + 1, size):
                    part = text[lo : lo + size + window - 1]
                    yield batch, i, part, np.array([0, len(part)]), lo
            i = j


def sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums over the bytes of a part, from which hashes() makes those of its byte ranges."""
    total = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum(ta._BYTE[data] * ta.powers()[: len(data)], out=total[1:])
    return total


def hashes(total: np.ndarray, start: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """64-bit hashes of the ranges of `size` bytes at each start; those of one size are equal where the bytes are."""
    return ta.mix((total[start + size] - total[start]) * ta.powers()[ta._SCALE - start])


def _leftmost(g: np.ndarray, span: int) -> np.ndarray:
    """How far from i the first smallest of g[i : i + span] is, for each i."""
    have, low, off = 1, g, np.zeros(len(g), np.int32)
    while have < span:
        step = min(have, span - have)
        a, b = low[:-step], low[step:]
        later = b < a
        low, off = np.minimum(a, b), np.where(later, off[step:] + step, off[:-step])
        have += step
    return off


def windows_of(at: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which positions start a window that lies within one text."""
    inside = np.ones(n, dtype=bool)
    across = (at[1:-1, None] - np.arange(1, window)).ravel()
    inside[across[(across >= 0) & (across < n)]] = False
    return inside


def unrolled(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each first, as many as its count."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


def anchors(data: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sums of the part, and of each run its first and last window and its anchor)."""
    size, total = digit_size(window), sums(data)
    none = np.zeros(0, np.int64)
    if len(data) < window:
        return total, none, none, none
    # digits are compared by the upper halves of their hashes; where two of a window share that, the leftmost counts
    g = (total[size:] - total[:-size]) * ta.powers()[: -len(total) + size - 1 : -1]
    g = (g >> _U(32)).astype(np.uint32)
    span = window - size + 1
    low = sliding(g, span)
    n = len(low)
    inside = windows_of(at, n, window)

    cut = np.ones(n + 1, dtype=bool)
    cut[1:-1] = (low[1:] != low[:-1]) | ~inside[:-1] | ~inside[1:]
    first, last = np.flatnonzero(cut[:-1] & inside), np.flatnonzero(cut[1:] & inside)
    digits = np.lib.stride_tricks.sliding_window_view(g, span)
    anchor = first + digits[first].argmin(axis=1)
    tied = last > anchor
    if tied.any():  # a digit repeats within a window: the anchors of these runs one by one
        every = unrolled(first[tied], (last - first + 1)[tied])
        leftmost = every + (digits[every].argmin(axis=1) if len(every) < n // 8 else _leftmost(g, span)[every])
        new = np.ones(len(every), dtype=bool)
        new[1:] = leftmost[1:] != leftmost[:-1]
        one = (every[new], every[np.append(new[1:], True)], leftmost[new])
        first, last, anchor = (np.concatenate([x[~tied], y]) for x, y in zip((first, last, anchor), one, strict=True))
        by = np.argsort(first)
        first, last, anchor = first[by], last[by], anchor[by]
    return total, first, last, anchor


def _first_digit(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for _, _, data, at, _ in segments(batches, window):
        total, _, _, anchor = anchors(data, at, window)
        yield pa.record_batch([pa.array(ta.signed(hashes(total, anchor, digit_size(window))))], names=["h"])


def _whole_runs(batches: Iterator[pa.RecordBatch], window: int, may_repeat: HashFilter) -> Iterator[pa.RecordBatch]:
    """h, the digit at the anchor; t, a hash of all of the run's bytes; where it lies and how many windows follow its first."""
    for batch, i, data, at, before in segments(batches, window):
        total, first, last, anchor = anchors(data, at, window)
        h = hashes(total, anchor, digit_size(window))
        keep = may_repeat(h)
        h, first, last = h[keep], first[keep], last[keep]
        t = ta.mix(hashes(total, first, last - first + window) + (last - first).astype(_U))
        row = np.searchsorted(at, first, side="right") - 1
        take = pa.array(i + row)
        columns = [pa.array(ta.signed(h)), pa.array(ta.signed(t)), ta.column(batch, "doc_id").take(take), ta.column(batch, "v").take(take)]
        yield pa.record_batch([*columns, pa.array((first - at[row] + before).astype(np.int32)), pa.array((last - first).astype(np.int32))], names=["h", "t", "doc_id", "v", "pos", "more"])


def _single(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Both digits of each suffix of the given runs. again: it stands earlier in the same text."""
    size = digit_size(window)
    for run in ta.runs(batches):
        data, at = ta.raw(ta.column(run, "text"))
        places = ta.column(run, "runs")
        first, more = (places.flatten().field(k).to_numpy().astype(np.int64) for k in (0, 1))
        start = np.unique(unrolled(np.repeat(at[:-1], pc.list_value_length(places).to_numpy()) + first, more + 1))
        one, two = np.empty(len(start), _U), np.empty(len(start), _U)
        for lo in range(0, len(data) - window + 1, PART_BYTES):
            a, b = np.searchsorted(start, (lo, lo + PART_BYTES))
            if a < b:
                total = sums(data[lo : lo + PART_BYTES + window - 1])
                one[a:b] = hashes(total, start[a:b] - lo, size)
                two[a:b] = hashes(total, start[a:b] - lo + window - size, size)
        row = np.searchsorted(at, start, side="right") - 1
        again = np.zeros(len(start), dtype=bool)
        both = np.sort(one + ta._BASE * two)
        if (both[1:] == both[:-1]).any():
            by = np.lexsort((start, two, one, row))
            again[by[1:]] = (one[by[1:]] == one[by[:-1]]) & (two[by[1:]] == two[by[:-1]]) & (row[by[1:]] == row[by[:-1]])
        columns = [pa.array(ta.signed(one)), pa.array(ta.signed(two)), ta.column(run, "o").take(pa.array(row)), pa.array((start - at[row]).astype(np.int32)), pa.array(again)]
        yield pa.record_batch(columns, names=["one", "two", "o", "pos", "again"])


def covered(docs: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """docs(doc_id, v, text) -> (doc_id, v, spans): byte ranges of the windows that stand earlier in the corpus; may overlap."""
    docs = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= window))
    digits = docs.select("text").mapInArrow(lambda it: _first_digit(it, window), "h long")
    twice = scratch.save(digits.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "digits")
    may_repeat = HashFilter(twice, "h")
    rows = docs.mapInArrow(lambda it: _whole_runs(it, window, may_repeat), "h long, t long, doc_id long, v long, pos int, more int")
    rows = scratch.save(rows.join(twice, "h"), "runs")
    scratch.drop(twice)
    earliest = rows.groupBy("h", "t").agg(F.min(F.struct("doc_id", "v", "pos", "more")).alias("low"), F.count(F.lit(1)).alias("n"))
    earliest = scratch.save(earliest, "earliest")
    # equal runs: all but the earliest are covered
    equal = rows.join(earliest.where("n > 1").select("h", "t", "low"), ["h", "t"]).where("doc_id <> low.doc_id or v <> low.v or pos <> low.pos")
    whole = scratch.save(equal.select("doc_id", "v", "pos", (F.col("pos") + F.col("more") + window).alias("end")), "equal")
    scratch.drop(rows)
    # other runs with the same digit: suffix by suffix
    mixed = scratch.save(earliest.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "mixed")
    order = numbered(docs.select(F.lit(0).alias("tree"), "doc_id", "v").distinct(), scratch, "doc_id", "v")[0].select("doc_id", "v", F.col("pos").alias("o"))
    order = scratch.save(order, "order")
    lone = earliest.join(mixed, "h").groupBy("low.doc_id", "low.v").agg(F.collect_list(F.struct("low.pos", "low.more")).alias("runs"))
    lone = scratch.save(lone.join(order, ["doc_id", "v"]), "lone")
    scratch.drop(earliest, mixed)
    texts = keep_ids(docs, lone).join(lone, ["doc_id", "v"]).select("text", "o", "runs")
    single = scratch.save(texts.mapInArrow(lambda it: _single(it, window), "one long, two long, o long, pos int, again boolean"), "single")
    scratch.drop(lone)
    met = scratch.save(single.where("not again").groupBy("one", "two").agg(F.min("o").alias("low"), F.max("o").alias("high")).where("low < high").select("one", "two", "low"), "met")
    later = keep_ids(single.where("not again").select("one", "two", "o", "pos"), met, "one").join(met, ["one", "two"]).where("o > low").select("o", "pos")
    found = later.unionByName(single.where("again").select("o", "pos")).groupBy("o").agg(F.collect_list(F.struct("pos", (F.col("pos") + window).alias("end"))).alias("spans"))
    found = found.join(order, "o").select("doc_id", "v", "spans")
    found = found.unionByName(whole.groupBy("doc_id", "v").agg(F.collect_list(F.struct("pos", "end")).alias("spans")))
    found = scratch.save(found.groupBy("doc_id", "v").agg(F.flatten(F.collect_list("spans")).alias("spans")), "covered")
    scratch.drop(single, met, whole, order)
    return found


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: int, end: int>>"
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the spans of each text and hashes the bytes between them."""
    for run in ta.runs(batches):
        data, at = ta.raw(ta.column(run, "text"))
        given = ta.column(run, "spans")
        row = np.repeat(np.arange(run.num_rows), pc.fill_null(pc.list_value_length(given), 0).to_numpy())
        start, end = (given.flatten().field(k).to_numpy() + at[row] for k in (0, 1))
        by = np.lexsort((start, row))
        row, start, end = row[by], start[by], np.maximum.accumulate(end[by])
        new = np.ones(len(row), dtype=bool)
        new[1:] = (start[1:] > end[:-1]) | (row[1:] != row[:-1])
        row, start, end = row[new], start[new], end[np.append(new[1:], True)[: len(new)]]
        of = np.searchsorted(row, np.arange(run.num_rows + 1))
        digests = []
        for i in range(run.num_rows):
            kept = hashlib.sha256()
            lo = at[i]
            for k in range(of[i], of[i + 1]):
                kept.update(data[lo : start[k]])
                lo = end[k]
            kept.update(data[lo : at[i + 1]])
            digests.append(kept.hexdigest())
        gone = np.append(0, np.cumsum(end - start))[of]
        columns = [pa.array(np.diff(x).astype(np.int64)) for x in (at, gone, of)]
        spans = pa.StructArray.from_arrays([pa.array((x - at[row]).astype(np.int32)) for x in (start, end)], fields=list(_SPAN))
        columns = [*columns, pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), spans)]
        yield pa.record_batch([ta.column(run, "doc_id"), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans), one row for each row of docs.

    A byte of the UTF-8 text goes if it is covered by a string of `window` bytes that also starts earlier: in a smaller
    doc_id, or before it in the same text. All strings are judged on the input. spans: the removed runs, from start up to
    before end, that neither touch nor overlap; the bytes between them need not be whole characters.

    Null, empty and short texts lose nothing; null counts as empty. Rows without doc_id neither lose bytes nor cost others
    theirs. Different texts of one doc_id are documents of their own, in order of a hash of the text; fully equal rows
    are one document and have the same result. An empty table gives no rows. Strings are equal where two 64-bit hashes
    of their halves are.
    """
    if window < 2:
        raise ValueError("a window has at least two bytes")
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("v", F.xxhash64("text"))
    found = covered(docs, scratch, window)
    texts = keep_ids(docs, found).join(found, ["doc_id", "v"], "left").select("doc_id", "text", "spans")
    plain = keep_ids(docs, found, others=True).select("doc_id", "text", F.lit(None).cast("array<struct<pos: int, end: int>>").alias("spans"))
    return texts.mapInArrow(_remove, _OUT).unionByName(plain.mapInArrow(_remove, _OUT))


ORACLE = r"""
with t as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
win as (select doc_id, i, md5(substr(x, 2 * i + 1, 200)) as h from (select doc_id, x, unnest(range(0, len(x) // 2 - 99)) as i from t where len(x) >= 200)),
low as (select h, min(struct_pack(d := doc_id, i := i)) as f from win group by h having count(*) > 1),
again as (select win.doc_id, i from win join low using (h) where f.d < win.doc_id or f.i < win.i),
edges as (select doc_id, i, case when coalesce(lag(i) over (partition by doc_id order by i) < i - 100, true) then 1 else 0 end as new from again),
spans as (
  select doc_id, min(i) as s, max(i) + 100 as e from (select doc_id, i, sum(new) over (partition by doc_id order by i) as k from edges) group by doc_id, k),
per as (select doc_id, list({'s': s, 'e': e} order by s) as spans, sum(e - s) as n_removed from spans group by doc_id)
select t.doc_id, (len(x) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(len(spans), 0)::bigint as n_spans,
       sha256(unhex(case when spans is null then x else array_to_string(list_transform(range(0, len(spans) + 1),
         lambda k: substr(x, 2 * (case when k = 0 then 0 else spans[k].e end) + 1, 2 * ((case when k = len(spans) then len(x) // 2 else spans[k + 1].s end) - (case when k = 0 then 0 else spans[k].e end)))), '') end)) as kept_sha256
from t left join per using (doc_id)
"""
