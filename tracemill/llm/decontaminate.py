"""Benchmark decontamination by latent semantic retrieval, then sequence and answer checks.

Benchmark texts are cut into passages of up to WINDOW words, dealt into groups of three quarters of RANK passages, so
that the space of a group holds all of them. The TF-IDF vectors of a group, with document frequencies over all
documents, get a randomised SVD, to which no document adds a row and of which no passage is left out: tasks multiply their passages by random signs, and once more by an
orthonormal basis, and only sums by word cell reach the driver. Windows of every document are compared with all
passages by cosine in the latent space of each group. A projection is no longer than what it projects, so a window of
which the words that some passage holds are too short a part can't reach the least cosine; such windows are left out.
What is found is a candidate; it counts as a leak if the item's words stand there in order, all but a few, by longest
common subsequence, and if the answer, where a benchmark has answers and the words were changed, stands there too.

An item that no window lies within (shorter than WINDOW + STEP words) is diluted by what stands around it, and a passage may lose too much of its length in the
latent space. Such items are looked up by their rarest words as well: so many of them that a place which holds the share
ORDER of an item in order can't miss all but a few. Whatever its length or words, an item that stands unchanged in a text
is found by its rarest word and a comparison of all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import counting
from . import textarrays as ta
from .html_text import common

#: Cells of words, latent dimensions, words of a window and between windows' starts, passages handled in one scan, or those of one item.
CELLS, RANK, WINDOW, STEP, PASSAGES = 1 << 17, 256, 32, 16, 2048
#: Passages of a group against RANK, the rest is what a randomised SVD takes more than its rank; least share of a passage's squared length in the latent space; rare words that must meet near each other; hits handled at once.
FILL, KEPT, MEET, HITS = 0.75, 0.95, 3, 1 << 21
#: Least cosine of a candidate; share of an item's words that must stand in order; share from which no answer is asked for; length of the place against the item; shorter items must stand unchanged.
COSINE, ORDER, VERBATIM, STRETCH, SHORT = 0.3, 0.7, 0.9, 1.6, 8
#: Taken off inverse frequencies: words in over a share exp(-COMMON) of the documents hardly count.
COMMON = 1.0
#: Windows compared at once: few enough for a processor's cache.
AT_ONCE = 192
_U = np.uint64


def cells(w: ta.Words) -> np.ndarray:
    return (w.hash & _U(CELLS - 1)).astype(np.int64)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by word cell, in parts."""
    df = np.zeros(CELLS, np.int64)
    for run in ta.runs(batches):
        w = ta.tokens(ta.column(run, "text"))
        df += np.bincount(np.unique(w.row * CELLS + cells(w)) % CELLS, minlength=CELLS)
    if df.any():
        part, counts = counting.parts(df)
        yield pa.record_batch([part, counts], names=["part", "counts"])


def inverse_frequencies(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """log((documents + 1) / (documents with a word of the cell + 1)) less COMMON, at least a little, and documents by cell, both over all documents."""
    df = counting.total(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_frequencies, "part int, counts binary"), CELLS)
    return np.maximum(0.05, np.log((docs.count() + 1.0) / (df + 1.0)) - COMMON), df


def passages(items: list[tuple[int, str, str | None]]) -> tuple[list[np.ndarray], np.ndarray]:
    """Word cells of each passage, and the item it belongs to."""
    w = ta.tokens(pa.array([x[1] for x in items], pa.string()))
    c, out, of = cells(w), [], []
    for i in range(len(items)):
        own = c[w.first[i] : w.first[i + 1]]
        starts = [*range(0, max(1, len(own) - WINDOW), WINDOW), max(0, len(own) - WINDOW)] if len(own) > 2 * WINDOW else [0]
        size = WINDOW if len(own) > 2 * WINDOW else len(own)
        for s in dict.fromkeys(starts):
            if size:
                out.append(own[s : s + size])
                of.append(i)
    return out, np.array(of, dtype=np.int64)


def _signs(at: np.ndarray, rank: int) -> np.ndarray:
    """Random signs by cell and dimension, the same in all tasks."""
    h = ta.mix(at.astype(_U)[:, None] * _U(0x9E3779B97F4A7C15) + ta.mix(np.arange((rank + 63) // 64, dtype=_U))[None])
    bits = np.unpackbits(h.view(np.uint8), axis=1, bitorder="little")[:, :rank]
    return bits.astype(np.float32) * 2 - 1


def _multiply(batches: Iterator[pa.RecordBatch], idf, basis, rank: int) -> Iterator[pa.RecordBatch]:
    """Passages' part of A' A B, by group and cell, as group * CELLS + cell; B: random signs, or for each group a basis (cells, matrix)."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for own, g in zip(ta.column(batch, "cells").to_pylist(), ta.column(batch, "group").to_pylist(), strict=True):
            at, count = np.unique(np.array(own, dtype=np.int64), return_counts=True)
            a = count * idf.value[at]
            a = (a / max(1e-12, float(np.sqrt((a * a).sum())))).astype(np.float32)
            b = _signs(at, rank) if basis is None else basis.value[g][1][np.searchsorted(basis.value[g][0], at)]
            y = a @ b
            for c, x in zip((at + g * CELLS).tolist(), a, strict=True):
                sums[c] = sums[c] + x * y if c in sums else x * y
    if sums:
        at = sorted(sums)
        for some in (at[i : i + 1000] for i in range(0, len(at), 1000)):
            yield pa.record_batch([pa.array(some, pa.int64()), pa.array([sums[c].astype(np.float32).tobytes() for c in some], pa.binary())], names=["cell", "row"])


def _sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cell, row = None, None
    for batch in batches:
        for c, x in zip(ta.column(batch, "cell").to_pylist(), ta.column(batch, "row"), strict=True):
            x = np.frombuffer(x.as_buffer(), dtype=np.float32)
            if c == cell:
                row = row + x
                continue
            if cell is not None:
                yield pa.record_batch([pa.array([cell], pa.int64()), pa.array([row.tobytes()], pa.binary())], names=["cell", "row"])
            cell, row = c, x
    if cell is not None:
        yield pa.record_batch([pa.array([cell], pa.int64()), pa.array([row.tobytes()], pa.binary())], names=["cell", "row"])


def latent_bases(passages: DataFrame, idf, n_groups: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """passages(group, cells) -> for each group, cells in order and an orthonormal basis of its passages' leading right singular vectors on them: at most RANK * WINDOW * 2 cells a group."""
    spark, bases = passages.sparkSession, None
    for _ in range(2):
        use = bases  # bound now: the tasks run below
        rows = passages.mapInArrow(lambda it: _multiply(it, idf, use, RANK), "cell long, row binary")  # noqa: B023
        found = rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(_sum_rows, "cell long, row binary").toArrow()
        at, flat = found.column("cell").to_numpy(), found.column("row").to_pylist()
        order = np.argsort(at)
        made = []
        for g in range(n_groups):
            own = order[np.searchsorted(at[order], g * CELLS) : np.searchsorted(at[order], (g + 1) * CELLS)]
            z = np.frombuffer(b"".join(flat[i] for i in own), dtype=np.float32).reshape(len(own), -1) if len(own) else np.zeros((0, RANK), np.float32)
            u, s, _ = np.linalg.svd(z.astype(np.float64), full_matrices=False)
            made.append((at[own] - g * CELLS, u[:, s > 1e-6 * max(1e-12, s.max(initial=0.0))].astype(np.float32)))
        bases = spark.sparkContext.broadcast(made)
    return bases.value


def _lookup(words: list[np.ndarray], items: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes in order; for each posting the number of its hash; its item; for each item, how many of its words must meet).

    A place with the share ORDER of an item's n words in order lacks at most n - ceil(ORDER n) of them; of so many and
    MEET more, the rarest, it holds MEET or more.
    """
    meet, hashes, of = np.ones(len(words), dtype=np.int64), [], []
    for i in items:
        n = len(words[i])
        if n < SHORT:
            continue  # must stand unchanged
        lacking = n - int(np.ceil(ORDER * n - 1e-9))
        meet[i] = max(1, min(MEET, n - lacking))
        rarest = np.argsort(df[(words[i] & _U(CELLS - 1)).astype(np.int64)], kind="stable")[: lacking + meet[i]]
        own = np.unique(words[i][rarest])
        hashes.append(own)
        of.append(np.full(len(own), i))
    if not hashes:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64), meet
    keys, number = np.unique(np.concatenate(hashes), return_inverse=True)
    return keys, number, np.concatenate(of), meet


def _hits(keys: np.ndarray, number: np.ndarray, w: ta.Words, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of words by key, one key after the other; and for each posting the first of its key's places, and how many there are."""
    known = np.zeros(CELLS, dtype=bool)
    known[(keys & _U(CELLS - 1)).astype(np.int64)] = True
    at = np.flatnonzero(known[c])
    key = np.minimum(np.searchsorted(keys, w.hash[at]), len(keys) - 1)
    right = keys[key] == w.hash[at]
    at, key = at[right], key[right]
    order = np.argsort(key, kind="stable")
    n = np.bincount(key, minlength=len(keys))
    return at[order], (np.cumsum(n) - n)[number], n[number]


def _spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers first[i] to first[i] + n[i] - 1, and their i."""
    i = np.repeat(np.arange(len(n)), n)
    return first[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n), i


def _rarest(words: list[np.ndarray], df: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes in order; for each item with words the number of its rarest word's hash; the item; the word's place in it)."""
    of = np.array([i for i, x in enumerate(words) if len(x)], dtype=np.int64)
    place = np.array([int(df[(words[i] & _U(CELLS - 1)).astype(np.int64)].argmin()) for i in of], dtype=np.int64)
    keys, number = np.unique(np.array([words[i][k] for i, k in zip(of, place, strict=True)], dtype=_U), return_inverse=True)
    return keys, number, of, place


def _unchanged(rarest: tuple, words: list[np.ndarray], lengths: np.ndarray, w: ta.Words, c: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(text, item, first) of the first place where an item stands unchanged in a text, by item."""
    keys, number, of, place = rarest
    if not len(keys):
        return
    flat, start = np.concatenate(words), np.cumsum(lengths) - lengths
    places, first, n = _hits(keys, number, w, c)
    batch = np.cumsum(n) // HITS
    for b in np.unique(batch[n > 0]):
        own = np.flatnonzero((batch == b) & (n > 0))
        at, i = _spread(first[own], n[own])
        text, item, s = row[places[at]], of[own][i], places[at] - place[own][i]
        fits = (s >= w.first[text]) & (s + lengths[item] <= w.first[text + 1])
        text, item, s, k = text[fits], item[fits], s[fits], 0
        while len(s):
            whole = lengths[item] == k
            if whole.any():
                t, j, f = text[whole], item[whole], s[whole]
                order = np.lexsort((f, t, j))
                t, j, f = t[order], j[order], f[order]
                new = (np.diff(t, prepend=-1) != 0) | (np.diff(j, prepend=-1) != 0)
                yield from zip(t[new].tolist(), j[new].tolist(), f[new].tolist(), strict=True)
                text, item, s = text[~whole], item[~whole], s[~whole]
            same = w.hash[s + k] == flat[start[item] + k]
            text, item, s, k = text[same], item[same], s[same], k + 1


def _meetings(lookup: tuple, lengths: np.ndarray, w: ta.Words, c: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, first, last) of places where as many of an item's rare words as must meet stand within its stretch."""
    keys, number, of, meet = lookup
    if not len(keys):
        return
    places, first, n = _hits(keys, number, w, c)
    # runs of whole items with about HITS hits; the postings stand in order of their items
    last = np.searchsorted(of, of, side="right") - 1
    batch = np.cumsum(n)[last] // HITS
    for b in np.unique(batch[n > 0]):
        own = np.flatnonzero((batch == b) & (n > 0))
        at, i = _spread(first[own], n[own])
        at, item = places[at], of[own][i]
        order = np.lexsort((at, item))
        at, item = at[order], item[order]
        other = np.arange(len(at)) + meet[item] - 1
        ok = other < len(at)
        other = np.minimum(other, len(at) - 1)
        wide = (STRETCH * lengths[item]).astype(np.int64)
        ok &= (item[other] == item) & (row[at[other]] == row[at]) & (at[other] - at <= wide)
        before = (-1, -1, 0)
        for k in np.flatnonzero(ok).tolist():
            t, j, p = int(row[at[k]]), int(item[k]), int(at[k])
            half = int(lengths[j]) // 2
            if before[:2] == (t, j) and p < before[2] + half:
                continue  # the stretch compared before reaches half an item further than it must
            before, more = (t, j, p), int(wide[k]) - int(lengths[j])
            yield t, j, p - more, int(at[other[k]]) + 1 + more + half


def _squares(known: np.ndarray, square: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Squared length, by window, of the TF-IDF vector of the words that have a number in known: a word that stands there n times counts n * n times the square of its number.

    A window is its block of STEP words and the next one; a word's times in it come from the sorted pairs of window and word.
    """
    at = np.flatnonzero(known >= 0)
    if not len(at):
        return np.zeros(len(begin))
    block = np.searchsorted(begin, at, side="right") - 1
    before = (block > 0) & (at < end[np.maximum(block - 1, 0)])  # also in the window that the block before it begins
    key = np.sort(np.concatenate([block, block[before] - 1]) * CELLS + known[np.concatenate([at, at[before]])])
    new = np.flatnonzero(np.diff(key, prepend=-1))
    times = np.diff(np.append(new, len(key)))
    return np.bincount(key[new] // CELLS, times * times * square[key[new] % CELLS], minlength=len(begin))


def _found(batches: Iterator[pa.RecordBatch], model) -> Iterator[tuple[pa.RecordBatch, ta.Words, dict]]:
    """Runs of rows, their words, and (text, item number) -> (score, cosine, first, last) of all leaks."""
    idf, groups, names, words, answers, lookup, rarest = model.value
    kinds = [np.unique(x, return_counts=True) for x in words]
    lengths = np.array([len(x) for x in words])
    spaces = []
    for used, basis, latent, of in groups:
        row_of = np.full(CELLS, -1, dtype=np.int32)
        row_of[used] = np.arange(len(used))
        # what each word adds to the inner product with each passage, both in the latent space: no more columns than dimensions
        spaces.append((used, row_of, ((basis * idf[used][:, None]).astype(np.float32) @ latent.T).astype(np.float32), of))
    square = (idf * idf).astype(np.float64)
    for run in ta.runs(batches):
        w = ta.tokens(ta.column(run, "text"))
        if not len(w.hash):
            yield run, w, {}
            continue
        c = cells(w)
        mass = np.concatenate([[0.0], np.cumsum(square[c])])
        # blocks of STEP words of a text, the last shorter; a window is a block and the next of its text
        n = -(-w.counts // STEP)
        text = np.repeat(np.arange(len(n)), n)
        begin = w.first[text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * STEP
        end = np.minimum(begin + WINDOW, w.first[text + 1])
        norm2 = mass[end] - mass[begin]  # a word that repeats counts for less than it has, so no cosine is too small
        found: dict[tuple[int, int], tuple] = {}
        last: dict[tuple[int, int], int] = {}
        for used, row_of, weighted, of in spaces:
            known = row_of[c]
            keep = np.flatnonzero((_squares(known, square[used], begin, end) >= 0.999 * COSINE * COSINE * norm2) & (norm2 > 0))
            for some in np.array_split(keep, max(1, len(keep) // AT_ONCE)):
                if not len(some):
                    continue
                blocks = np.union1d(some, some + 1)
                blocks = blocks[blocks < len(begin)]
                size = np.minimum(begin[blocks] + STEP, w.first[text[blocks] + 1]) - begin[blocks]
                at = known[np.repeat(begin[blocks], size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))]
                block = np.repeat(np.arange(len(blocks)), size)
                hit = at >= 0
                at, block = at[hit], block[hit]
                sums = np.zeros((len(blocks) + 1, weighted.shape[1]), dtype=np.float32)
                starts = np.flatnonzero(np.diff(block, prepend=-1))
                if len(starts):
                    sums[block[starts]] = np.add.reduceat(weighted[at], starts, axis=0)
                here = np.searchsorted(blocks, some)
                more = (some + 1 < len(begin)) & (text[np.minimum(some + 1, len(begin) - 1)] == text[some])
                cosine = (sums[here] + sums[np.where(more, here + 1, len(blocks))]) / np.sqrt(norm2[some])[:, None].astype(np.float32)
                for i, p in zip(*np.nonzero(cosine >= COSINE), strict=True):
                    key, b = (int(text[some[i]]), int(of[p])), int(begin[some[i]])
                    half = int(lengths[key[1]]) // 2
                    if 0 <= b - last.get(key, b + 1) < max(1, half):
                        continue  # what was compared before reaches half an item further than it must
                    last[key] = b
                    _check(found, key, b, int(end[some[i]]) + half, float(cosine[i, p]), w, words[key[1]], kinds[key[1]], answers[key[1]])
        row = w.row
        for t, i, at in _unchanged(rarest, words, lengths, w, c, row):
            best = found.get((t, i), (0.0, None))
            if best[0] < 1.0:
                found[t, i] = (1.0, best[1], at, at + len(words[i]) - 1)
        for t, i, lo, hi in _meetings(lookup, lengths, w, c, row):
            _check(found, (t, i), lo, hi, None, w, words[i], kinds[i], answers[i])
        yield run, w, found


def _find(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """(doc_id, item_id, score, cosine, first_word, last_word) of all leaks of each text."""
    names = model.value[2]
    for run, w, found in _found(batches, model):
        if found:
            t, i, score, cosine, first, last = zip(*((*k, *x) for k, x in sorted(found.items())), strict=True)
            t, first, last = np.array(t), np.array(first), np.array(last)
            ids = ta.column(run, "doc_id").take(pa.array(t))
            yield pa.record_batch([ids, pa.array([names[k] for k in i], pa.int64()), pa.array(score, pa.float64()), pa.array(cosine, pa.float64()), pa.array(first - w.first[t]), pa.array(last - w.first[t])], names=["doc_id", "item_id", "score", "cosine", "first_word", "last_word"])


def _keep(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """The rows without leaks."""
    for run, _, found in _found(batches, model):
        clean = np.ones(run.num_rows, dtype=bool)
        clean[[t for t, _ in found]] = False
        yield run.filter(pa.array(clean))


def _check(found: dict, key: tuple[int, int], begin: int, end: int, cosine: float | None, w: ta.Words, item: np.ndarray, item_words: tuple, answer: np.ndarray) -> None:
    """Compares an item with the words around a candidate window; found keeps (score, cosine, first, last) of the best place."""
    best = found.get(key, (0.0, None, 0, 0))
    if best[0] == 1.0:
        return
    n = len(item)
    lo, hi = max(int(w.first[key[0]]), begin - n), min(int(w.first[key[0] + 1]), end + n)
    near = w.hash[lo:hi]
    score, first, last = 0.0, lo, lo
    if n < SHORT:
        at = _places(near, item)
        if len(at):
            score, first, last = 1.0, lo + int(at[0]), lo + int(at[0]) + n - 1
    else:
        wide = min(len(near), int(STRETCH * n))
        kinds, times = item_words
        place = np.minimum(np.searchsorted(kinds, near), len(kinds) - 1)
        held = kinds[place] == near
        if np.minimum(np.bincount(place[held], minlength=len(kinds)), times).sum() < ORDER * n:
            return
        total = np.concatenate([[0], np.cumsum(held)])
        counts = total[wide:] - total[: len(total) - wide]
        if counts.max() >= ORDER * n:
            s = max(0, int(counts.argmax()) - n // 2)
            part = near[s : s + wide + 2 * (n // 2)]
            at = np.array(sorted(common(part.tolist(), item.tolist())), dtype=np.int64)
            if len(at):
                stop = np.searchsorted(at, at + wide)
                k = int((stop - np.arange(len(at))).argmax())  # the densest stretch of the words in order
                score = float(stop[k] - k) / n
                first, last = lo + s + int(at[k]), lo + s + int(at[stop[k] - 1])
    if score < ORDER or score < VERBATIM and len(answer) and not len(_places(w.hash[max(lo, first - n) : min(hi, last + n)], answer)):
        return
    if score > best[0]:
        found[key] = (score, cosine, first, last)


def _places(near: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Where words stand unchanged in near."""
    at = np.arange(max(0, len(near) - len(words) + 1))
    for k, x in enumerate(words):
        at = at[near[at + k] == x]
    return at


def models(docs: DataFrame, benchmark: DataFrame, answer: str | None = None) -> Iterator:
    """What tasks need to look for a benchmark in texts, broadcast: one for each set of items."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (F.col(answer).cast("string") if answer else F.lit(None).cast("string")).alias("answer"))
    n_items = items.count()
    if not n_items:
        return
    weights, df = inverse_frequencies(docs)
    idf = spark.sparkContext.broadcast(weights)
    # words, about, bound an item's passages; a scan takes items of PASSAGES of them, but for one item that has more
    n_passages = items.agg(F.sum(F.ceil(F.regexp_count("text", F.lit(r"\S+")) / WINDOW + 1))).first()[0]
    n_parts = max(1, -(-int(n_passages) // PASSAGES)) if n_items > 1 else 1
    for k in range(n_parts):
        own = items if n_parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_parts)) == k)
        rows = own.collect()
        text_cells, of = passages([(r.item_id, r.text, r.answer) for r in rows])
        if not text_cells:
            continue
        n_groups = 1 if len(text_cells) <= RANK else -(-len(text_cells) // int(FILL * RANK))
        group_of = np.arange(len(text_cells)) * n_groups // len(text_cells)
        listed = [(int(g), x.tolist()) for g, x in zip(group_of, text_cells, strict=True)]
        grouped = spark.createDataFrame(listed, "group int, cells array<int>").repartition(max(1, n_groups))
        groups, poor = [], set()
        for g, (used, basis) in enumerate(latent_bases(grouped, idf, n_groups)):
            mine = np.flatnonzero(group_of == g)
            latent = np.zeros((len(mine), basis.shape[1]), dtype=np.float32)
            for k_own, p in enumerate(mine):
                at, count = np.unique(text_cells[p], return_counts=True)
                x = count * weights[at]
                latent[k_own] = (x / np.sqrt((x * x).sum())) @ basis[np.searchsorted(used, at)]
            poor.update(of[mine][(latent * latent).sum(axis=1) < KEPT].tolist())
            groups.append((used, basis, latent, of[mine]))
        w, a = ta.tokens(pa.array([r.text for r in rows], pa.string())), ta.tokens(pa.array([r.answer for r in rows], pa.string()))
        words = [w.hash[w.first[i] : w.first[i + 1]] for i in range(len(rows))]
        answers = [a.hash[a.first[i] : a.first[i + 1]] for i in range(len(rows))]
        sought = poor | {i for i, x in enumerate(words) if 0 < len(x) < WINDOW + STEP}
        yield spark.sparkContext.broadcast((weights, groups, [r.item_id for r in rows], words, answers, _lookup(words, np.array(sorted(sought), dtype=np.int64), df), _rarest(words, df)))


def leaks(docs: DataFrame, benchmark: DataFrame, answer: str | None = None) -> DataFrame:
    """docs(doc_id, text, ...), benchmark(item_id, text, ...) -> (doc_id, item_id, score, cosine, first_word, last_word).

    A row for each document and benchmark item that it holds, unchanged or with words changed: score is the share of the
    item's words found in order, first_word and last_word the place, words numbered from 0; cosine is null where only
    the item's rare words led to the place. answer names a column of
    benchmark; where it isn't null or empty, changed items count only with the answer near. Null and empty texts hold
    nothing; items without words are in no document. Rows of one doc_id, or one item_id, give one row with the best
    score. Rows without doc_id are scored too. An empty table on either side gives no rows.

    Items are broadcast in sets of about PASSAGES passages, each with a scan of the documents of its own; an item with more is a set by itself.
    """
    spark, texts = docs.sparkSession, docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = f"doc_id {dict(texts.dtypes)['doc_id']}, item_id long, score double, cosine double, first_word long, last_word long"
    out = None
    for model in models(texts, benchmark, answer):
        found = texts.mapInArrow(lambda it, m=model: _find(it, m), schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], schema)
    best = F.max(F.struct("score", "cosine", (-F.col("first_word")).alias("first"), (-F.col("last_word")).alias("last")))
    best = out.groupBy("doc_id", "item_id").agg(best.alias("b"))
    return best.select("doc_id", "item_id", F.col("b.score").alias("score"), F.col("b.cosine").alias("cosine"), (-F.col("b.first")).alias("first_word"), (-F.col("b.last")).alias("last_word"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, answer: str | None = None) -> DataFrame:
    """The rows of docs whose text holds no item of benchmark, by the rules of leaks(). Each row is judged where it is read: none moves, and doc_id has no part in it."""
    out, schema = docs, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    for model in models(docs, benchmark, answer):
        out = out.mapInArrow(lambda it, m=model: _keep(it, m), schema)
    return out
