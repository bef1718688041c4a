"""Scratch tables in the folder that all executors share, and small column helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as a word where a contract doesn't say otherwise: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a temporary one of a local session, as in tests; on a cluster, an error."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir() or ""
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='tracemill-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named


#: Spark's setting by which the shuffle files of a query go when it ends; one without it keeps them as before.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Intermediate results as Parquet in the shared folder: they cut lineage and outlive executors.

    A result is read when its query runs, so its tables stay until then; all folders go when the driver's process ends.
    """

    def __init__(self, spark: SparkSession, tidy: bool = False):
        """tidy: shuffle files of a step go once its table is written, not when the driver happens to collect its garbage."""
        short_batches(spark)
        self.tidy = tidy
        self.spark, self.root, self.n = spark, f"{shared_dir(spark).rstrip('/')}/tracemill-{uuid.uuid4().hex}", 0
        atexit.register(self._remove)

    def _remove(self) -> None:
        """Deletes the folder, if its session still runs."""
        if self.n and self.spark.sparkContext._jsc is not None:
            try:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            except Exception:  # noqa: BLE001  the JVM went first; the folder is named for whoever cleans the shared one
                return

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        before = self.spark.conf.get(SHUFFLES_GO, None)
        if self.tidy:
            self.spark.conf.set(SHUFFLES_GO, "true")
        try:
            df.write.parquet(path)
        finally:
            if self.tidy:
                self.spark.conf.unset(SHUFFLES_GO) if before is None else self.spark.conf.set(SHUFFLES_GO, before)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more, so that the folder holds no more than it must."""
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(table._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows and bytes of text in an Arrow batch. Texts are long: Spark's own 10,000 rows and 64 MB are held several times on both sides of each task.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def short_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Lowers the session's rows and bytes per Arrow batch to BATCH_ROWS and `most`; smaller settings stay."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(name).rstrip("b"))
    if now <= 0 or now > most:
        spark.conf.set(name, f"{most}b")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model learns from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bits of the filter in keep_ids: half a megabyte, or where over a part FULL of them is set, sixteen; whatever the input.
FILTER_BITS, MORE_BITS, FULL = 1 << 22, 1 << 27, 0.2


def _bits(ids: DataFrame, key: str, size: int, hashed: bool = False) -> np.ndarray:
    """A bit for each hash of an id, aggregated by the executors, 32 in a word. hashed: the ids are hashes."""
    value = F.col(key).cast("long")
    slot = F.pmod(value if hashed else F.xxhash64(value), F.lit(size)).cast("int")
    bits = ids.select(slot.alias("s")).groupBy(F.shiftright("s", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1, s & 31)")).alias("bits")).toArrow()
    words = np.zeros(size // 32, dtype=np.int32)
    words[bits.column("word").to_numpy()] = bits.column("bits").to_numpy()
    return words


def _filter(ids: DataFrame, key: str, hashed: bool = False) -> np.ndarray:
    """The smaller set of bits, or the larger one where that fills."""
    words = _bits(ids, key, FILTER_BITS, hashed)
    return _bits(ids, key, MORE_BITS, hashed) if np.bitwise_count(words).sum() > FULL * FILTER_BITS else words


class HashFilter:
    """Says of 64-bit hashes, in numpy arrays within tasks, whether they may be in a column: a fixed number of bits is broadcast, none is missed, and the join that follows decides."""

    def __init__(self, hashes: DataFrame, key: str, cells: int | None = None):
        """cells: the column holds the last bits of hashes, as many values as that; without, whole hashes."""
        self.bits = hashes.sparkSession.sparkContext.broadcast(_bits(hashes, key, cells, hashed=True) if cells else _filter(hashes, key, hashed=True))

    def __call__(self, h: np.ndarray) -> np.ndarray:
        words = self.bits.value
        at = (h & np.uint64(32 * len(words) - 1)).astype(np.int64)
        return (words[at >> 5] >> (at & 31).astype(np.int32)) & 1 == 1


def keep_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id", others: bool = False) -> DataFrame:
    """docs without most rows whose key isn't in ids, so that a join with ids moves few other texts.

    Only a fixed number of bits is broadcast. Rows may stay wrongly (of more than some 50 million ids, most do), none
    goes wrongly; the join that follows decides. others: the rows that go, in place of those that stay, and rows
    without key.
    """
    words = _filter(ids, key)
    slot = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(32 * len(words))).cast("int")
    packed = docs.sparkSession.sparkContext.broadcast(words)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(batch.num_columns - 1).to_numpy()
            hit = (packed.value[at >> 5] >> (at & 31).astype(np.int32)) & 1
            take = hit != others
            if take.any():
                yield batch.filter(pa.array(take)).select(range(batch.num_columns - 1))

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    kept = docs.where(F.col(key).isNotNull()).withColumn("_slot", slot).mapInArrow(keep, schema)
    return kept.unionByName(docs.where(F.col(key).isNull())) if others else kept
