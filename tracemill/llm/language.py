"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read as its letters, with one blank for each run of anything else, in chunks of CHUNK bytes cut at the edges of
characters, whatever spaces they hold; the network reads CONTEXT bytes more on either side of a chunk. It reads from both
ends and labels every byte with a probability of each language; a document's probabilities are the mean over all its
letters' bytes. A chunk met again in a batch, or lately by the same worker, as in copies, isn't computed again. Training
is backpropagation through time in numpy, on chunks of a bounded sample of labelled documents.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textarrays as ta
from .shared import held_out, short_batches

#: Bytes of a chunk and beside it; hidden units for each direction; documents the network learns from, in all and for one language, and chunks of one of them.
CHUNK, CONTEXT, HIDDEN, SAMPLE, SAMPLE_LANG, SAMPLE_CHUNKS = 96, 8, 12, 2000, 400, 16
STEPS, BATCH, RATE = 200, 96, 0.03
#: Chunks computed at once where there are few languages, and chunks whose labels a worker remembers.
AT_ONCE, REMEMBERED = 768, 1 << 16
#: Languages of which the counts are broadcast.
FEW = 1 << 16
UNKNOWN = "und"
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_ASCII_LETTER = _LETTER & (np.arange(256) < 128)


@dataclass
class Chunks:
    """Letters of texts and their chunks: start and length of what is read, start and end within it of what counts, and the text it belongs to."""

    data: np.ndarray
    start: np.ndarray
    length: np.ndarray
    low: np.ndarray
    high: np.ndarray
    row: np.ndarray


def _edge(data: np.ndarray, at: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """at, moved on to the next edge of a character, within [least, most]."""
    at = np.clip(at, least, most)
    for _ in range(3):
        inner = (at < most) & ((data[np.minimum(at, len(data) - 1)] & 0xC0) == 0x80)
        at = at + inner
    return at


def chunks(texts: pa.Array) -> Chunks:
    """A-Z count as a-z; runs of ASCII that isn't a letter count as one blank, or nothing at the start."""
    data, at = ta.raw(texts)
    data = ta.lowered(data)
    letter = _LETTER[data]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    begin = at[:-1][at[:-1] < len(data)]
    keep[begin] = letter[begin]
    at = np.concatenate([[0], np.cumsum(keep)])[at]
    data = np.where(letter, data, np.uint8(32))[keep]
    size = np.diff(at)
    parts = -(-size // CHUNK)
    row = np.repeat(np.arange(len(size)), parts)
    if not len(row):
        none = np.zeros(0, np.int64)
        return Chunks(data, none, none, none, none, none)
    number = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    first, last = at[:-1][row], at[1:][row]
    low = _edge(data, first + number * CHUNK, first, last)
    high = _edge(data, first + (number + 1) * CHUNK, first, last)
    start, stop = _edge(data, low - CONTEXT, first, last), _edge(data, high + CONTEXT, first, last)
    return Chunks(data, start, stop - start, low - start, high - start, row)


def matrix(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Bytes of each chunk in a row, 0 beyond its end."""
    at = np.arange(int(length.max(initial=1)))
    out = data[np.minimum(start[:, None] + at, max(0, len(data) - 1))]
    out[at >= length[:, None]] = 0
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters by name: for each direction x in f, b a table of the gates' inputs by byte (tx) and recurrent weights (ux); output weights v and bias c."""

    def __init__(self, parameters: dict[str, np.ndarray]):
        self.p = parameters

    @classmethod
    def new(cls, languages: int, hidden: int = HIDDEN, seed: int = 1) -> Network:
        r = np.random.default_rng(seed)
        make = lambda a, b, s: (r.standard_normal((a, b)) * s).astype(np.float32)
        p = {"v": make(2 * hidden, languages, 0.2), "c": np.zeros(languages, np.float32)}
        for x in "fb":
            p |= {f"t{x}": make(256, 3 * hidden, 0.3), f"u{x}": make(hidden, 3 * hidden, hidden**-0.5)}
        return cls(p)

    def states(self, x: np.ndarray, length: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """Hidden states by step: forward ('f') from the first byte, backward ('b') from the last. keep gets what the way back needs."""
        table, u = self.p[f"t{way}"], self.p[f"u{way}"]
        k = u.shape[0]
        out = np.empty((x.shape[1], x.shape[0], k), dtype=np.float32)
        h = np.zeros((x.shape[0], k), dtype=np.float32)
        shortest = int(length.min(initial=0))
        for t in range(x.shape[1]) if way == "f" else range(x.shape[1] - 1, -1, -1):
            g, a = table[x[:, t]], h @ u
            gates = _sigmoid(g[:, : 2 * k] + a[:, : 2 * k])
            z, r = gates[:, :k], gates[:, k:]
            n = np.tanh(g[:, 2 * k :] + r * a[:, 2 * k :])
            inside = (t < length)[:, None]
            new = n + z * (h - n)
            if t >= shortest:
                new = np.where(inside, new, h)
            if keep is not None:
                keep.append((t, h, z, r, n, a[:, 2 * k :], inside))
            out[t] = h = new
        return out

    def _read(self, x: np.ndarray, length: np.ndarray, way: str) -> np.ndarray:
        """states() for all that only want the result: by step, unit and chunk, in buffers that are used again, gates halved for tanh beforehand."""
        table, u = self.p[f"t{way}"].T.copy(), self.p[f"u{way}"].T.copy()
        k, n = u.shape[1], x.shape[0]
        table[: 2 * k] *= 0.5
        u[: 2 * k] *= 0.5
        steps = x.T.copy()
        out = np.empty((len(steps), k, n), dtype=np.float32)
        g, a, h = np.empty((3 * k, n), np.float32), np.empty((3 * k, n), np.float32), np.zeros((k, n), np.float32)
        shortest = int(length.min(initial=0))
        for t in range(len(steps)) if way == "f" else range(len(steps) - 1, -1, -1):
            np.take(table, steps[t], axis=1, out=g, mode="clip")
            np.matmul(u, h, out=a)
            gates = g[: 2 * k]
            gates += a[: 2 * k]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            new, z, r = g[2 * k :], gates[:k], gates[k:]
            r *= a[2 * k :]
            new += r
            np.tanh(new, out=new)
            step = out[t]
            np.subtract(h, new, out=step)
            step *= z
            step += new
            if t >= shortest:
                np.copyto(step, h, where=t >= length)
            h = step
        return out

    def label(self, x: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Probabilities by step, language and chunk."""
        k = self.p["ub"].shape[0]
        vf, vb = self.p["v"][:k].T.copy(), self.p["v"][k:].T.copy()
        p = np.matmul(vf, self._read(x, length, "f"))
        p += np.matmul(vb, self._read(x, length, "b"))
        p += self.p["c"][:, None]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def gradients(self, x: np.ndarray, length: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all bytes within the chunks, and its gradients by backpropagation through time."""
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self.states(x, length, w, kept[w]) for w in "fb"], axis=2)
        p = _softmax(both @ self.p["v"] + self.p["c"])
        inside = (np.arange(x.shape[1])[:, None] < length)[:, :, None]
        count = inside.sum()
        loss = float(-(np.log(np.maximum(p[:, np.arange(len(y)), y], 1e-9)) * inside[:, :, 0]).sum() / count)
        d = p
        d[:, np.arange(len(y)), y] -= 1
        d *= inside / count
        out = {"v": np.einsum("tnh,tnl->hl", both, d, optimize=True), "c": d.sum(axis=(0, 1))}
        back = d @ self.p["v"].T
        k = both.shape[2] // 2
        for way, part in (("f", back[:, :, :k]), ("b", back[:, :, k:])):
            u = self.p[f"u{way}"]
            du, dt, carry = np.zeros_like(u), np.zeros_like(self.p[f"t{way}"]), np.zeros_like(part[0])
            for t, h, z, r, n, an, mask in reversed(kept[way]):
                whole = part[t] + carry
                dn = np.where(mask, whole, 0)
                stay = np.where(mask, 0, whole)
                dz = dn * (h - n) * z * (1 - z)
                pre = dn * (1 - z) * (1 - n * n)
                dr = pre * an * r * (1 - r)
                da = np.concatenate([dz, dr, pre * r], axis=1)
                carry = stay + dn * z + da @ u.T
                du += h.T @ da
                np.add.at(dt, x[:, t], np.concatenate([dz, dr, pre], axis=1))
            out |= {f"u{way}": du, f"t{way}": dt}
        return loss, out

    def fit(self, x: np.ndarray, length: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 2) -> Network:
        """Adam on batches with as many chunks of each language."""
        r = np.random.default_rng(seed)
        of = [np.flatnonzero(y == k) for k in range(self.p["c"].size)]
        one, two = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            rows = np.concatenate([r.choice(i, max(1, BATCH // len(of))) for i in of if len(i)])
            wide = int(length[rows].max())
            _, grad = self.gradients(x[rows, :wide], length[rows], y[rows])
            rate = RATE * (1 - step / (steps + 1))
            for k, g in grad.items():
                one[k] = 0.9 * one[k] + 0.1 * g
                two[k] = 0.99 * two[k] + 0.01 * g * g
                self.p[k] = (self.p[k] - rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def dump(self) -> bytes:
        np.savez(to := io.BytesIO(), **self.p)
        return to.getvalue()

    @classmethod
    def load(cls, packed: bytes) -> Network:
        return cls(dict(np.load(io.BytesIO(packed))))


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def _train(batches: Iterator[pa.RecordBatch], languages: list[str]) -> Iterator[pa.RecordBatch]:
    number = {k: i for i, k in enumerate(languages)}
    rows = sorted((str(i), text or "", number[lang]) for b in batches for i, text, lang in zip(*(ta.column(b, c).to_pylist() for c in ("doc_id", "text", "lang")), strict=True))
    net = Network.new(len(languages))
    found, y = [], []
    for some in (rows[i : i + 256] for i in range(0, len(rows), 256)):
        c = chunks(pa.array([x[1] for x in some], pa.large_string()))
        number_in = np.arange(len(c.row)) - np.searchsorted(c.row, c.row)
        step = np.maximum(1, -(-np.bincount(c.row, minlength=len(some)) // SAMPLE_CHUNKS))[c.row]
        letters = np.concatenate([[0], np.cumsum(_LETTER[c.data])])
        take = (number_in % step == 0) & (letters[c.start + c.length] > letters[c.start])  # SAMPLE_CHUNKS of a document, all over it
        wide = CHUNK + 2 * CONTEXT + 6
        x = np.zeros((int(take.sum()), wide), np.uint8)
        own = matrix(c.data, c.start[take], c.length[take])
        x[:, : own.shape[1]] = own
        found.append((x, c.length[take]))
        y.append(np.array([x[2] for x in some], dtype=np.int64)[c.row[take]])
    if y and sum(map(len, y)):
        net.fit(np.concatenate([x for x, _ in found]), np.concatenate([n for _, n in found]), np.concatenate(y))
    yield pa.record_batch([pa.array([net.dump()], pa.binary())], names=["model"])


def labelled(docs: DataFrame) -> DataFrame:
    """The rows that training can learn from: with a language and a text, and not held out."""
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))


def train(docs: DataFrame) -> tuple[list[str], bytes] | None:
    """Learns from text and lang of documents that aren't held out, in one task; None without any.

    All languages are learned: of each, as many documents as SAMPLE allows by their number, one at least and SAMPLE_LANG
    at most. A number of ids that this bounds reaches the driver, and no text but theirs is moved.
    """
    known = labelled(docs)
    name = F.xxhash64("doc_id", "text", F.lit("language sample"))
    keys = known.select("lang", name.alias("name"))
    counts = keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    languages = counts.count()
    if not languages:
        return None
    each = min(SAMPLE_LANG, max(1, SAMPLE // languages))
    # some more than that by their hash, for no language to miss its number by chance, and of these the first
    scale, more = 1 << 30, each + 8 + 4 * int(each**0.5)
    rate = F.greatest(F.lit(1), F.floor(F.least(F.lit(1.0), more / F.col("n")) * scale))
    # a hot language's ids stay where they are; counts of more languages than FEW aren't broadcast
    drawn = keys.join(F.broadcast(counts) if languages <= FEW else counts, "lang").where(F.pmod("name", F.lit(scale)) < rate).select("lang", "name").distinct()
    first = drawn.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("name"))).where(F.col("place") <= each).select("lang", "name").collect()
    sample = known.select("doc_id", "text", "lang", name.alias("name")).where(F.col("name").isin([r.name for r in first])).dropDuplicates(["name", "lang"])
    found = sorted({r.lang for r in first})
    return found, sample.repartition(1).mapInArrow(lambda it: _train(it, found), "model binary").first().model


_memory: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _labels(net: Network, model: int, c: Chunks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each chunk: its text's number, the sums of its letters' probabilities, and how many bytes of letters it has."""
    languages = net.p["c"].size
    if not len(c.start):
        return c.row, np.zeros((0, languages)), np.zeros(0)
    # a chunk's name: what is read, and what of it counts
    name = ta.mix(ta.window_sums(c.data, c.start, c.length) ^ (c.low * 4099 + c.high).astype(np.uint64))
    unique, first, back = np.unique(name, return_index=True, return_inverse=True)
    known, sums = _memory.get(model, (np.zeros(0, np.uint64), np.zeros((0, languages + 1), np.float32)))
    at = np.searchsorted(known, unique)
    met = known[np.minimum(at, len(known) - 1)] == unique if len(known) else np.zeros(len(unique), bool)
    out = np.zeros((len(unique), languages + 1), dtype=np.float32)
    out[met] = sums[at[met]]
    todo = np.flatnonzero(~met)
    todo = todo[np.argsort(c.length[first[todo]], kind="stable")]
    for some in np.array_split(todo, max(1, -(-len(todo) // max(8, AT_ONCE * 16 // max(16, languages))))):
        if not len(some):
            continue
        own = first[some]
        n = c.length[own]
        x = matrix(c.data, c.start[own], n)
        place = np.arange(x.shape[1])
        letters = _LETTER[x] & (place >= c.low[own][:, None]) & (place < c.high[own][:, None])
        out[some, :-1] = np.einsum("tln,tn->nl", net.label(x, n), letters.T.astype(np.float32))
        out[some, -1] = letters.sum(axis=1)
    if len(todo):
        if len(known) + len(todo) > REMEMBERED:
            known, sums = known[:0], sums[:0]
        names = np.concatenate([known, unique[todo]])[:REMEMBERED]
        order = np.argsort(names, kind="stable")
        _memory.clear()
        _memory[model] = (names[order], np.concatenate([sums, out[todo]])[:REMEMBERED][order])
    return c.row, out[back, :-1], out[back, -1]


def _predict(batches: Iterator[pa.RecordBatch], languages: list[str], packed, kept: list[str]) -> Iterator[pa.RecordBatch]:
    net, model = Network.load(packed.value), hash(packed.value)
    names = np.array([*languages, UNKNOWN], dtype=object)
    for run in ta.runs(batches):
        texts = ta.column(run, "text")
        row, sums, letters = _labels(net, model, chunks(texts))
        total = np.stack([np.bincount(row, sums[:, k], minlength=run.num_rows) for k in range(len(languages))], axis=1) / np.maximum(1, np.bincount(row, letters, minlength=run.num_rows))[:, None]
        data, at = ta.raw(texts)
        count = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
        has = count[at[1:]] > count[at[:-1]]
        for i in np.flatnonzero(~has & (at[1:] > at[:-1])):
            has[i] = any(map(str.isalpha, texts[int(i)].as_py()))
        best = np.where(has, total.argmax(axis=1), len(languages))
        score = np.where(has, np.clip(total.max(axis=1), 0, 1), 0.0)
        yield pa.record_batch([*(ta.column(run, c) for c in kept), pa.array(names[best], pa.string()), pa.array(score.astype(np.float64))], names=[*kept, "lang_pred", "score"])


def identify(docs: DataFrame, carry: tuple[str, ...] = (), model: tuple[list[str], bytes] | None = None) -> DataFrame:
    """docs(doc_id, text, lang, ...) -> (doc_id, held_out, *carry, lang_pred, score), one row for each row of docs.

    model is what train() gave; without one it is trained on docs.

    lang_pred is `und`, with score 0, for texts that are null or hold no letter, and for all texts where no document
    has a language to learn from. lang is read in training only. Rows are independent, so repeated rows and missing
    ids are harmless. An empty table gives no rows.
    """
    short_batches(docs.sparkSession)
    model = model or train(docs)
    plain = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"), *(c for c in carry if c != "text"))
    kept = ["doc_id", "held_out", *carry]
    if model is None:
        return plain.select(*kept, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    languages, packed = model[0], docs.sparkSession.sparkContext.broadcast(model[1])
    schema = ", ".join(f"`{k}` {t}" for k, t in plain.select(*kept).dtypes)
    return plain.mapInArrow(lambda it: _predict(it, languages, packed, kept), f"{schema}, lang_pred string, score double")
