"""Writers: files of the record format by exact name, export, insert-if-absent append, download, catalog and readme files, tombstones, activity."""

from __future__ import annotations

import contextlib
import json
import os
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.validate import require_valid
from .files import lines, listing

LAYOUT = ["model_slug", "tier", "shard"]


def json_value(df: DataFrame, pretty: bool = False) -> Column:
    """A row as JSON with null keys written."""
    return F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"} | ({"pretty": "true"} if pretty else {}))


def json_lines(df: DataFrame) -> DataFrame:
    """One column `value`: each row as JSON."""
    return df.select(json_value(df).alias("value"))


def export(df: DataFrame, path: str) -> None:
    json_lines(df).coalesce(1).write.mode("overwrite").text(path)


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _mounted(spark: SparkSession, root: str) -> str | None:
    """The path of a folder that tasks reach as one of the machine's own, as a shared mount; None in any other store."""
    fs, at = _fs(spark, root)
    return fs.makeQualified(at).toUri().getPath() if fs.getScheme() == "file" else None


def _write_whole(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Lines (path, value), all of a path in a row -> (path, staged): each path's lines in a file of folder, which no other attempt of the task shares."""
    task, path, out, done = TaskContext.get().taskAttemptId(), None, None, []
    os.makedirs(folder, exist_ok=True)
    for batch in batches:
        for to, value in zip(batch.column("path").to_pylist(), batch.column("value").to_pylist(), strict=True):
            if to != path:
                if out:
                    out.close()
                path = to
                done.append((to, f"{task}-{len(done)}"))
                out = open(f"{folder}/{done[-1][1]}", "wb")  # noqa: SIM115  closed at the next path
            out.write(((value or "") + "\n").encode())
    if out:
        out.close()
    for some in (done[i : i + 10000] for i in range(0, len(done), 10000)):
        yield pa.record_batch([pa.array(x, pa.string()) for x in zip(*some, strict=True)], names=["path", "staged"])


def _move(batches: Iterator[pa.RecordBatch], folder: str, root: str) -> Iterator[pa.RecordBatch]:
    """(path, staged) -> n: moves each staged file to its path below root, over one that is there. One that is gone was moved by an earlier attempt of the task."""
    for batch in batches:
        for path, staged in zip(batch.column("path").to_pylist(), batch.column("staged").to_pylist(), strict=True):
            to = f"{root}/{path}"
            parent, name = os.path.split(to)
            os.makedirs(parent, exist_ok=True)
            with contextlib.suppress(FileNotFoundError):  # a checksum that Hadoop left for the file that was there
                os.remove(f"{parent}/.{name}.crc")
            try:
                os.replace(f"{folder}/{staged}", to)
            except FileNotFoundError:
                if not os.path.exists(to):
                    raise
        yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], names=["n"])


def write_files(rows: DataFrame, root: str, order: list[Column]) -> int:
    """rows(path, value, ...): writes the lines `value`, in `order`, to the file `path` below root, over one that is there; returns the number of files.

    The format names its files, Spark doesn't. A file is written by one task, as it is the unit of the format. Where root
    is in a file system that machines mount, tasks write each file whole to a folder beside them and then, once all are
    complete, tasks move them to their names; the driver sees their number alone. In any other store Spark writes them
    under a digest of their path, and the driver moves them, several at a time, which reads and writes no content. What
    was there is replaced file by file, each by a rename that overwrites or fails: a file is never missing. Writers don't
    share their staged files.
    """
    spark, staged = rows.sparkSession, f"{root.rstrip('/')}/_incoming-{uuid.uuid4().hex}"
    keyed = rows.withColumn("_file", F.sha2("path", 256))
    in_files = keyed.select("_file", "path", "value", F.struct(*order).alias("_at")).repartition("_file").sortWithinPartitions("_file", "_at")
    folder = _mounted(spark, staged)
    if folder:
        in_files.select("path", "value").mapInArrow(lambda it: _write_whole(it, f"{folder}/files"), "path string, staged string").write.parquet(f"{staged}/names")
        to = os.path.dirname(folder)
        n = spark.read.parquet(f"{staged}/names").mapInArrow(lambda it: _move(it, f"{folder}/files", to), "n bigint").agg(F.sum("n")).first()[0]
        fs, at = _fs(spark, staged)
        fs.delete(at, True)
        return n or 0
    names = {r._file: r.path for r in keyed.select("_file", "path").distinct().collect()}  # a row per file written
    if not names:
        return 0
    in_files.select("_file", "value").write.partitionBy("_file").text(staged)
    fs, at = _fs(spark, staged)
    hadoop = spark._jvm.org.apache.hadoop.fs
    path_of, overwrite = hadoop.Path, spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    overwrite[0] = hadoop.Options.Rename.OVERWRITE
    context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())

    def move(name: str, path: str) -> None:
        parts = [s.getPath() for s in fs.globStatus(path_of(f"{staged}/_file={name}/part-*"))]
        to = path_of(f"{root.rstrip('/')}/{path}")
        fs.mkdirs(to.getParent())
        if len(parts) > 1:
            raise RuntimeError(f"{path} was written in parts")
        context.rename(parts[0], to, overwrite)

    with ThreadPoolExecutor(16) as pool:
        list(pool.map(move, names, names.values()))
    fs.delete(at, True)
    return len(names)


def write_staging(records: DataFrame, folder: str, key: str = "session_id") -> int:
    """A file session_{key}.json for each record, indented, over one that is there; no key is `unknown`, of records that share a file one stays. No privacy step."""
    body = records.drop(key)
    path = F.concat(F.lit("session_"), F.coalesce(F.nullif(F.col(key), F.lit("")), F.lit("unknown")), F.lit(".json"))
    one = records.select(path.alias("path"), json_value(body, pretty=True).alias("value")).groupBy("path").agg(F.max("value").alias("value"))
    return write_files(one, folder, [F.lit(0)])


def update_staging(records: DataFrame, folder: str, key: str = "session_id") -> int:
    """As write_staging, for records that were changed: all must be valid, or nothing is written."""
    return write_staging(require_valid(records, key), folder, key)


def write_outbox(records: DataFrame, folder: str) -> int:
    """A file record_{record_id}.jsonl of one line for each record, over one that is there; of records that share an id one stays."""
    named = records.select(F.concat(F.lit("record_"), "record_id", F.lit(".jsonl")).alias("path"), json_value(records).alias("value"))
    return write_files(named.groupBy("path").agg(F.max("value").alias("value")), folder, [F.lit(0)])


def overwrite_by_key(df: DataFrame, path: str, key: str) -> None:
    """One file set per key value; those of other keys stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).json(path, ignoreNullFields=False)


def append_shards(new: DataFrame, root: str, order: str) -> int:
    """Appends records that carry the layout's columns to data/{model}/{tier}/shard_{xx}.jsonl; returns how many.

    Only the shards that get records are read and written again. What is new to its model and tier is for
    dataset.insert_if_absent to say.
    """
    spark = new.sparkSession
    body = new.drop(*LAYOUT, order)
    path = F.concat_ws("/", F.lit("data"), "model_slug", "tier", F.concat(F.lit("shard_"), "shard", F.lit(".jsonl")))
    zero = F.lit(0).cast("bigint")
    added = new.select(path.alias("path"), F.lit(1).alias("part"), zero.alias("start"), zero.alias("row"), F.col(order).alias("_o"), F.to_json(F.struct(*body.columns), {"ignoreNullFields": "false"}).alias("value"))
    there = [r.path for r in listing(spark, f"{root}/data/*/*/shard_*.jsonl").select("path").collect()]
    touched = {r.path for r in added.select("path").distinct().collect()}  # a row per shard that gets records
    old = [p for p in there if any(p.endswith(f"/{t}") for t in touched)] if len(touched) < 64 else there
    count = added.count()
    if old:
        kept = lines(spark, old).select(F.concat(F.lit("data/"), F.array_join(F.slice(F.split("path", "/"), -3, 3), "/")).alias("path"), F.lit(0).alias("part"), "line.start", "line.row", F.lit(None).cast(added.schema["_o"].dataType).alias("_o"), "value")
        added = added.unionByName(kept.join(F.broadcast(spark.createDataFrame([(t,) for t in touched], "path string")), "path", "left_semi"))  # a name per shard written
    write_files(added, root, [F.col("part"), F.col("start"), F.col("row"), F.col("_o")])
    return count


def download(plan: DataFrame, source: str, target: str) -> DataFrame:
    """Copies the shard files of a plan (path) from source to target; one row: files downloaded, skipped because they are there, failed because source lacks them, and records (lines that aren't blank) and bytes of those downloaded."""
    spark = plan.sparkSession
    below = lambda root: listing(spark, f"{root}/data/*/*/shard_*.jsonl").select(F.concat(F.lit("data/"), F.array_join(F.slice(F.split("path", "/"), -3, 3), "/")).alias("path"), F.col("path").alias("full"), "size")
    wanted, have, there = plan.select("path").distinct(), below(target).select("path"), below(source)
    missing = wanted.join(have, "path", "left_anti")
    found = missing.join(there, "path").persist()
    files = [(r.path, r.full, r["size"]) for r in found.collect()]  # a row per file to copy
    n_missing, n_wanted = missing.count(), wanted.count()
    records = 0
    if files:
        text = lines(spark, [full for _, full, _ in files], blank=True)
        named = text.withColumn("path", F.concat(F.lit("data/"), F.array_join(F.slice(F.split("path", "/"), -3, 3), "/")))
        write_files(named.select("path", "value", "line"), target, [F.col("line")])
        records = named.where(F.trim("value") != "").count()
    for path, full, size in files:  # a file without lines has no rows to write
        if size == 0:
            write_text(spark, f"{target}/{path}", "")
    found.unpersist()
    row = (len(files), n_wanted - n_missing, n_missing - len(files), records, sum(size for _, _, size in files))
    return spark.createDataFrame([row], "downloaded bigint, skipped bigint, failed bigint, records bigint, bytes bigint")


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path, ignoreNullFields=False)


def append_deletions(tombstones: DataFrame, file: str) -> None:
    """Appends tombstones (record_id, deleted_at, reason) to a dataset's deletions as new files beside `file`: nothing that is there is read or written, and appends don't meet."""
    tombstones.select("record_id", "deleted_at", "reason").write.mode("append").json(f"{file}.d", ignoreNullFields=False)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A single small file through Hadoop, which reaches every store that Spark reads."""
    fs, to = _fs(spark, path)
    out = fs.create(to, True)
    out.write(bytearray(text.encode()))
    out.close()


def catalog_json(tiers: DataFrame, models: DataFrame, distribution: DataFrame, totals: DataFrame, generated_at: str) -> str:
    """The catalog as JSON: a row per model and tier reaches the driver, no records."""
    out: dict = {"schema_version": "0.1.0", "generated_at": generated_at} | totals.first().asDict()
    out["quality_distribution"] = {r.tier: r.record_count for r in distribution.collect()}
    out["models"] = {r.model_slug: {k: v for k, v in r.asDict(recursive=True).items() if k != "model_slug"} | {"tiers": {}} for r in models.orderBy("model_slug").collect()}
    for r in tiers.orderBy("model_slug", "tier").collect():
        if r.model_slug in out["models"]:
            out["models"][r.model_slug]["tiers"][r.tier] = {k: v for k, v in r.asDict(recursive=True).items() if k not in ("model_slug", "tier")}
    return json.dumps(out, indent=2, ensure_ascii=False, default=str)


def readme(tiers: DataFrame, distribution: DataFrame, totals: DataFrame) -> str:
    """A short description of the dataset in Markdown: totals, share of each tier, a line per model."""
    from ..operators.catalog import model_summary, tier_shares

    t = totals.first()
    text = [f"# Dataset\n\nRecords: {t.total_records}. Bytes: {t.total_size_bytes}. Deleted: {t.deletions_count}; leave out records that deletions.jsonl names.\n", "| Tier | Records | Share |", "|---|---|---|"]
    text += [f"| {r.tier} | {r.record_count} | {r.percentage}% |" for r in tier_shares(distribution).orderBy(F.desc("rank"), "tier").collect()]
    text += ["", "| Model | Records | Average quality | Top tier |", "|---|---|---|---|"]
    text += [f"| {r.model_slug} | {r.record_count} | {r.average} | {r.top_tier} |" for r in model_summary(tiers).orderBy("model_slug").collect()]
    return "\n".join(text) + "\n"
