"""Readers of JSON files in folders: staging, outbox, shards, deletions, activity, catalog."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .records import record_ddl
from .typed import parsed

CATALOG = (
    "schema_version string, generated_at string, total_records bigint, total_size_bytes bigint, deletions_count bigint, quality_distribution map<string, bigint>, "
    "models map<string, struct<display_name: string, parameter_counts: array<string>, quantizations: array<string>, context_windows: array<bigint>, total_records: bigint, hardware_distribution: map<string, bigint>, "
    "tiers: map<string, struct<record_count: bigint, avg_quality_score: double, shards: array<string>, total_size_bytes: bigint, last_updated: string>>>>"
)
LINES = "path string, modified timestamp, line struct<start: bigint, row: bigint>, value string"


def listing(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, size, modified) of files that match, empty ones too, which Spark's readers leave out."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    rows = [(s.getPath().toString(), s.getLen(), s.getModificationTime() / 1000.0) for s in found if not s.isDirectory()]
    return spark.createDataFrame(rows, "path string, size bigint, modified double").withColumn("modified", F.timestamp_seconds("modified"))


def lines(spark: SparkSession, pattern: str | list[str], blank: bool = False) -> DataFrame:
    """(path, modified, line, value): lines that aren't blank (all of them with `blank`). line orders the lines of a file: the start of the split it was read in, and its row there.

    Files are read in splits, so one of any size is read by many tasks. No rows where no file matches a pattern.
    """
    if isinstance(pattern, str) and not listing(spark, pattern).count():
        return spark.createDataFrame([], LINES)
    return _lines(spark.read.text(pattern), blank)


def lines_in(spark: SparkSession, folder: str, names: str, blank: bool = False) -> DataFrame:
    """As lines(), of the files of a folder by a pattern of names: the folder is listed once, by Spark, however many files it has."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], LINES)
    return _lines(spark.read.option("pathGlobFilter", names).text(folder), blank)


def _lines(read: DataFrame, blank: bool) -> DataFrame:
    at = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("row"))
    rows = read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), at.alias("line"), "value")
    return rows if blank else rows.where(F.trim("value") != "")


def count_lines(spark: SparkSession, file: str) -> int:
    """Lines that aren't blank, readable or not; none where there is no file: how many deletions a dataset has."""
    return lines(spark, _with_appended(file)).count()


def _records(lines: DataFrame, unread: bool, *keep: str) -> DataFrame:
    """The records of lines that hold one, after the columns keep; with `unread`, a column of what in them doesn't fit its type (typed.UNREAD), which is null in the record."""
    out = parsed(lines, record_ddl()).where("r is not null")
    return out.select(*keep, "r.*", *(["unread"] if unread else []))


def staging(spark: SparkSession, folder: str, unread: bool = False, ordered: bool = True) -> DataFrame:
    """Records of all *.json and *.jsonl files, a file each, newest first by column `modified`; unreadable files are left out. Without `ordered` in any order: a sort of all records opens each file twice."""
    whole = spark.read.option("pathGlobFilter", "*.{json,jsonl}").text(folder, wholetext=True)
    whole = whole.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), "value")
    found = _records(whole, unread, "path", "modified")
    return found.orderBy(F.desc("modified"), "path") if ordered else found


def latest_staging(spark: SparkSession, folder: str) -> DataFrame:
    """The newest *.json file, or the newest *.jsonl file if there is no other; no row if it can't be read. Only that file is opened."""
    found = listing(spark, f"{folder}/*.json*").where(F.col("path").endswith(".json") | F.col("path").endswith(".jsonl"))
    newest = found.orderBy(F.desc(F.col("path").endswith(".json")), F.desc("modified"), "path").first()
    if newest is None:
        return spark.createDataFrame([], f"path string, modified timestamp, {record_ddl()}")
    one = spark.read.text(newest.path, wholetext=True).select(F.lit(newest.path).alias("path"), F.lit(newest.modified).alias("modified"), "value")
    return _records(one, False, "path", "modified")


def outbox(spark: SparkSession, folder: str, unread: bool = False, ordered: bool = True) -> DataFrame:
    """Records by line, newest file first (without `ordered` in any order); the rest of a file after its first bad line isn't read."""
    read = parsed(lines_in(spark, folder, "*.jsonl"), record_ddl())
    before = W.partitionBy("path").orderBy("line")
    good = read.withColumn("bad", F.max(F.col("r").isNull()).over(before)).where("not bad")
    found = good.select("path", "modified", "line", "r.*", *(["unread"] if unread else []))
    return found.orderBy(F.desc("modified"), "path", "line") if ordered else found


def _layout(folder: str, model: str | None, tier: str | None) -> str:
    """Shard files of one model or tier, or of all: the choice is part of the path, so that no other file is listed or opened."""
    for name in (model, tier):
        if name is not None and not re.fullmatch(r"[\w-]+", name):
            raise ValueError(f"{name!r} names no folder of the layout")
    return f"{folder}/data/{model or '*'}/{tier or '*'}/shard_*.jsonl"


def shards(spark: SparkSession, folder: str, model: str | None = None, tier: str | None = None, unread: bool = False) -> DataFrame:
    """Records of data/{model}/{tier}/shard_*.jsonl with model_slug, tier, shard and line; blank and bad lines are left out. model, tier: only theirs, by slug."""
    part = F.split("path", "/")
    named = lines(spark, _layout(folder, model, tier)).withColumns({"model_slug": F.element_at(part, -3), "tier": F.element_at(part, -2), "shard": F.element_at(part, -1)})
    return _records(named, unread, "model_slug", "tier", "shard", "line")


def shard_files(spark: SparkSession, folder: str, model: str | None = None, tier: str | None = None) -> DataFrame:
    part = F.split("path", "/")
    return listing(spark, _layout(folder, model, tier)).select(F.element_at(part, -3).alias("model_slug"), F.element_at(part, -2).alias("tier"), F.element_at(part, -1).alias("shard"), "size", "modified")


def deletions(spark: SparkSession, file: str) -> DataFrame:
    """Tombstones: the file's, and those appended beside it since (sinks.append_deletions())."""
    rows = parsed(lines(spark, _with_appended(file)), "record_id string, deleted_at string, reason string")
    return rows.select("r.*")


def _with_appended(file: str) -> str:
    """A pattern of the file and of the folder of what was appended to it: deletions.jsonl and deletions.jsonl.d/*."""
    return file if "*" in file else f"{file}{{,.d/*.json}}"


def activity(spark: SparkSession, file: str) -> DataFrame:
    """All or nothing: one bad line fails the read."""
    return spark.read.schema("action string, record_id string, quality_tier string, timestamp string").json(file, mode="FAILFAST")


def catalog(spark: SparkSession, file: str) -> DataFrame | None:
    """The catalog, one row; None where nothing is published yet, or the file isn't JSON."""
    if not listing(spark, file).count():
        return None
    read = parsed(spark.read.text(file, wholetext=True), CATALOG).where("r is not null").select("r.*")
    return None if read.isEmpty() else read
