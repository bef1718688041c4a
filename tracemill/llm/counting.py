"""Sums of long count vectors of fixed size over all tasks; the driver sees one vector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = 1 << 14


def parts(vector: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Columns (part, counts) of a vector of whole numbers below 2^31 whose length is a multiple of PART."""
    k = len(vector) // PART
    return pa.array(range(k), pa.int32()), pa.array([vector[i * PART : (i + 1) * PART].astype(np.int32).tobytes() for i in range(k)], pa.binary())


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            got = np.frombuffer(counts.as_buffer(), dtype=np.int64 if len(counts.as_buffer()) == 8 * PART else np.int32)
            total[part] = total[part] + got if part in total else got.astype(np.int64)
    if total:
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "counts"])


def total(rows: DataFrame, size: int) -> np.ndarray:
    """rows(part, counts) -> the sum, added up in two rounds so that no task reads a row of every other task."""
    add = lambda rows, *by: rows.repartition(size // PART, *by).mapInArrow(_add, "part int, counts binary")
    rows = add(add(rows, F.col("part"), F.spark_partition_id() % 16), F.col("part"))
    out = np.zeros(size, np.int64)
    for row in rows.toLocalIterator():  # one row a part
        out[row.part * PART : (row.part + 1) * PART] += np.frombuffer(row.counts, dtype=np.int64)
    return out
