"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text is the set of its words, their stems (first 4 to 6 bytes, so that an inflection not met in training still
counts), word pairs, and pairs with one word between, hashed to CELLS cells. FTRL-proximal keeps
a learning rate for each coordinate and an L1 penalty that leaves most weights at exactly 0, so the weights that are
broadcast are few, and scoring looks up only cells with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .shared import held_out, short_batches

CELLS = 1 << 20
#: Labelled documents it learns from, for each label.
SAMPLE = 4000
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 6.0, 0.1, 4
STEMS = (4, 5, 6)
_U = np.uint64


def features(w: ta.Words) -> tuple[np.ndarray, np.ndarray]:
    """(text number, cell) of all n-grams of the texts; a cell may come more than once for a text."""
    row, n = w.row, len(w.hash)
    rows, cells = [row], [ta.mix(w.hash ^ _U(1))]
    for size in STEMS:
        at = np.flatnonzero(w.end - w.start > size)
        rows.append(row[at])
        cells.append(ta.mix(ta.hashes(w.data, w.start[at], w.start[at] + size) ^ _U(size)))
    for gap, salt in ((1, 12), (2, 13)):
        if n > gap:
            at = np.flatnonzero(row[:-gap] == row[gap:])
            rows.append(row[at])
            cells.append(ta.mix(w.hash[at] * _U(3) + ta.mix(w.hash[at + gap] ^ _U(salt))))
    return np.concatenate(rows), (np.concatenate(cells) & _U(CELLS - 1)).astype(np.int64)


class Ftrl:
    """Per-coordinate sums z and squared gradients n; the last coordinate is the bias, which isn't penalized."""

    def __init__(self, cells: int = CELLS):
        self.z, self.n = np.zeros(cells + 1), np.zeros(cells + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: float) -> None:
        """One example; at: its distinct cells."""
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] += g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray, float]:
        w = self.weights(np.arange(len(self.z)))
        at = np.flatnonzero(w[:-1])
        return at, w[at], float(w[-1])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = []
    for run in ta.runs(batches):
        w = ta.tokens(ta.column(run, "text"))
        row, cell = features(w)
        order = np.argsort(row, kind="stable")
        parts = np.split(cell[order], np.cumsum(np.bincount(row, minlength=run.num_rows))[:-1])
        found += [(i, y, np.unique(p)) for i, y, p in zip(ta.column(run, "doc_id").to_pylist(), ta.column(run, "toxic").to_pylist(), parts, strict=True)]
    found.sort(key=lambda x: (x[0], x[1], len(x[2])))
    model, r = Ftrl(), np.random.default_rng(3)
    for _ in range(EPOCHS):
        for k in r.permutation(len(found)):
            model.learn(found[k][2], float(found[k][1] == 1))
    at, w, bias = model.sparse()
    yield pa.record_batch([pa.array([at], pa.list_(pa.int64())), pa.array([w], pa.list_(pa.float64())), pa.array([bias])], names=["at", "w", "bias"])


def training_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of at most about SAMPLE documents of each label that aren't held out, a row per doc_id.

    A document labelled more than once is toxic if any label says so; of several texts with one doc_id the first in
    order serves. All documents are read in parallel and met with the ids, at most 3 * SAMPLE short rows; what remains
    is aggregated before anything moves to one task.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    is_toxic = F.col("toxic") == 1
    counts = {r.y: r.n for r in known.groupBy(is_toxic.alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    scale = 1 << 30
    rate = F.when(is_toxic, F.lit(int(min(1.0, SAMPLE / max(1, counts.get(True, 0))) * scale))).otherwise(F.lit(int(min(1.0, SAMPLE / max(1, counts.get(False, 0))) * scale)))
    sample = known.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity sample")), F.lit(scale)) < rate).limit(3 * SAMPLE)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Cells, weights and bias, learnt in one task from training_texts()."""
    rows = training_texts(docs, labels).repartition(1).mapInArrow(_train, "at array<bigint>, w array<double>, bias double").collect()
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0), 0.0
    return np.array(rows[0].at, dtype=np.int64), np.array(rows[0].w), rows[0].bias


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    at, w, bias = model.value
    dense = np.zeros(CELLS, dtype=np.float64)
    dense[at] = w
    for run in ta.runs(batches):
        row, cell = features(ta.tokens(ta.column(run, "text")))
        held = np.flatnonzero(dense[cell])
        once = np.unique(row[held] * CELLS + cell[held])
        total = np.bincount(once // CELLS, dense[once % CELLS], minlength=run.num_rows) + bias
        score = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
        yield pa.record_batch([ta.column(run, "doc_id"), ta.column(run, "held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...), labels(doc_id, toxic) -> (doc_id, held_out, score, predicted), one row for each row of docs.

    Only text is scored; a null or empty text gets the bias's score. Labels that are null, or of held-out or unknown
    documents, teach nothing; a document labelled twice counts once, as toxic if any label says so. Without any label all scores are 0.5. Rows are
    independent, so repeated rows and missing ids are harmless. An empty table gives no rows.
    """
    short_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    plain = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = dict(plain.dtypes)["doc_id"]
    return plain.mapInArrow(lambda it: _score(it, model), f"doc_id {kind}, held_out boolean, score double, predicted int")
