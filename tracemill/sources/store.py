"""A dataset whose publishes are atomic: a log of commits says which files are live, and each file's entry carries its share of the catalog.

Data lie in Parquet files by model, tier and shard. A publish writes new files for the shards that it touches, and then
one entry in the log by a rename that fails where another writer's entry is already; until then no reader sees them. As
an id fixes its shard, only files of touched shards are read for ids that are there already. Counts, sums, first names
and histograms of each file are kept in its log entry and merged from there, so no catalog reads data.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import dataset
from ..operators.catalog import SCORE

PLACE = "struct<tier: string, shard: string, version: bigint, row: bigint>"
ENTRY = (
    "version bigint, action string, kind string, path string, model_slug string, tier string, shard string, bytes bigint, modified timestamp, records bigint, "
    f"score_sum decimal(38, 9), scores bigint, name struct<at: {PLACE}, value: string>, firsts array<struct<field: string, value: string, at: {PLACE}>>, gpus map<string, bigint>"
)
SHARD = ["model_slug", "tier", "shard"]


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class Store:
    """columns: schema of the records, with model_slug, tier, shard, record_id, score, model_name, gpu_name and `attributes`, of which the catalog lists the values in the order of their first record."""

    def __init__(self, spark: SparkSession, root: str, columns: str | StructType, attributes: tuple[str, ...] = ()):
        self.spark, self.root, self.columns, self.attributes = spark, root.rstrip("/"), columns, attributes

    # the log

    def _path(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last commit, 0 before the first."""
        pattern, fs = self._path(f"{self.root}/_log/*.json")
        return max((int(s.getPath().getName().split(".")[0]) for s in fs.globStatus(pattern) or []), default=0)

    def _log(self, version: int) -> DataFrame:
        if not version:
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).json(f"{self.root}/_log/*.json").where(F.col("version") <= version)

    def live(self, kind: str = "data", version: int | None = None) -> DataFrame:
        """Entries of the files of a kind (`data`, `tombstones`) that were added and not removed up to a version, by default the last."""
        log = self._log(self.version() if version is None else version).where(F.col("kind") == kind)
        gone = log.where("action = 'remove'").select("path")
        return log.where("action = 'add'").join(gone, "path", "left_anti")

    def commit(self, version: int, entries: list[str]) -> None:
        """Makes entries (JSON) the given version, all at once, or raises Conflict where there is one already."""
        jvm = self.spark._jvm
        staged, fs = self._path(f"{self.root}/_staged/{uuid.uuid4().hex}")
        out = fs.create(staged, False)
        out.write(bytearray(("\n".join(entries) + "\n").encode()))
        out.close()
        to, _ = self._path(f"{self.root}/_log/{version:020d}.json")
        fs.mkdirs(to.getParent())
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri() if to.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(staged, to, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            fs.delete(staged, False)
            if "FileAlreadyExistsException" in str(e.java_exception):
                raise Conflict(f"version {version} of {self.root} is there already") from None
            raise

    # records

    def _read(self, entries: DataFrame, columns: list[str] | None = None) -> DataFrame:
        """The files of entries; their names reach the driver, as those of any table that Spark lists do."""
        paths = [r.path for r in entries.select("path").collect()]
        out = self.spark.read.schema(self.columns).parquet(*paths) if paths else self.spark.createDataFrame([], self.columns)
        return out.select(*columns) if columns else out

    def scan(self, model: str | None = None, tier: str | None = None, version: int | None = None) -> DataFrame:
        """Records, of one model or tier if named: only their files are listed in the plan."""
        entries = self.live(version=version)
        for column, value in (("model_slug", model), ("tier", tier)):
            entries = entries if value is None else entries.where(F.col(column) == value)
        return self._read(entries)

    def _stage(self, rows: DataFrame, version: int, order: str) -> list[str]:
        """Writes rows by model, tier and shard, and gives an entry for each file, from what was written."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        keyed = rows.withColumns({f"_{c}": F.col(c) for c in SHARD}).repartition(*(f"_{c}" for c in SHARD))
        keyed.write.partitionBy(*(f"_{c}" for c in SHARD)).parquet(folder)
        at = F.struct("tier", "shard", F.lit(version).cast("bigint").alias("version"), F.col(order).cast("bigint").alias("row"))
        back = self.spark.read.schema(rows.schema).option("recursiveFileLookup", True).parquet(folder).withColumns({"path": F.col("_metadata.file_path"), "_at": at, "_bytes": F.col("_metadata.file_size"), "_modified": F.col("_metadata.file_modification_time")})
        named = F.when((F.col("model_name") != F.col("model_slug")) & (F.col("model_name") != ""), F.col("_at"))
        main = back.groupBy("path").agg(
            *(F.first(c).alias(c) for c in SHARD),
            F.first("_bytes").alias("bytes"),
            F.first("_modified").alias("modified"),
            F.count(F.lit(1)).alias("records"),
            F.sum(F.col("score").cast(SCORE)).cast("decimal(38, 9)").alias("score_sum"),
            F.count("score").alias("scores"),
            F.min(F.when(named.isNotNull(), F.struct(named.alias("at"), F.col("model_name").alias("value")))).alias("name"),
        )
        values = F.array(*(F.struct(F.lit(a).alias("field"), F.col(a).cast("string").alias("value"), F.col("_at").alias("at")) for a in self.attributes)) if self.attributes else F.array().cast(f"array<struct<field: string, value: string, at: {PLACE}>>")
        used = back.select("path", F.explode(values).alias("x")).select("path", "x.*").where(F.col("value").isNotNull() & ~F.col("value").isin("", "0"))
        firsts = used.groupBy("path", "field", "value").agg(F.min("at").alias("at")).groupBy("path").agg(F.collect_list(F.struct("field", "value", "at")).alias("firsts"))
        gpus = back.where(F.coalesce("gpu_name", F.lit("")) != "").groupBy("path", "gpu_name").agg(F.count(F.lit(1)).alias("n")).groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("gpu_name", "n"))).alias("gpus"))
        entries = main.join(firsts, "path", "left").join(gpus, "path", "left").withColumns({"version": F.lit(version), "action": F.lit("add"), "kind": F.lit("data")})
        return [r.j for r in entries.select(F.to_json(F.struct(*entries.columns)).alias("j")).collect()]  # an entry per file written

    def publish(self, batch: DataFrame, order: str, attempts: int = 3) -> int:
        """Adds records (the store's columns, and `order`, a whole number) that are new to their model and tier, all or none; returns how many.

        Only ids in files of touched shards are read. Where another writer commits first, what is new is worked out
        again, up to `attempts` times; then Conflict is raised and nothing is added.
        """
        kind = self.spark.createDataFrame([], self.columns).schema
        for left in range(attempts, 0, -1):
            head = self.version()
            touched = batch.select(*SHARD).distinct()
            there = self._read(self.live(version=head).join(touched, SHARD, "left_semi"), dataset.KEY)
            new = dataset.insert_if_absent(batch, there, order)
            entries = self._stage(new.select(*kind.names, *([order] if order not in kind.names else [])), head + 1, order)
            if not entries:
                return 0
            try:
                self.commit(head + 1, entries)
                return sum(json.loads(e)["records"] for e in entries)
            except Conflict:
                if left == 1:
                    raise
        return 0

    # the catalog

    def tiers(self, version: int | None = None) -> DataFrame:
        """As catalog.tier_stats() over all records and files, from the log alone."""
        mean = F.round(F.sum("score_sum") / F.sum("scores"), 4).cast("double")
        return self.live(version=version).groupBy("model_slug", "tier").agg(
            F.sum("records").alias("record_count"),
            F.coalesce(mean, F.lit(0.0)).alias("avg_quality_score"),
            F.array_sort(F.collect_set("shard")).alias("shards"),
            F.sum("bytes").alias("total_size_bytes"),
            F.max("modified").alias("last_updated"),
        )

    def models(self, version: int | None = None) -> DataFrame:
        """As catalog.model_stats() over all records, from the log alone."""
        live = self.live(version=version)
        out = live.groupBy("model_slug").agg(F.sum("records").alias("total_records"), F.coalesce(F.min("name")["value"], F.first("model_slug")).alias("display_name"))
        firsts = live.select("model_slug", F.explode("firsts").alias("x")).groupBy("model_slug", "x.field", "x.value").agg(F.min("x.at").alias("at"))
        lists = firsts.groupBy("model_slug", "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("values"))
        for name in self.attributes:
            own = lists.where(F.col("field") == name).select("model_slug", F.col("values").alias(f"{name}s"))
            out = out.join(own, "model_slug", "left").withColumn(f"{name}s", F.coalesce(f"{name}s", F.array().cast("array<string>")))
        gpus = live.select("model_slug", F.explode("gpus").alias("gpu_name", "n")).groupBy("model_slug", "gpu_name").agg(F.sum("n").alias("n"))
        return out.join(gpus.groupBy("model_slug").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("gpu_name", "n")))).alias("hardware_distribution")), "model_slug", "left")

    # tombstones

    def delete(self, tombstones: DataFrame) -> int:
        """Adds tombstones (record_id, deleted_at, reason) as files of their own: none that is there is read. Deletes don't contradict each other, so this one takes the next version that is free."""
        folder = f"{self.root}/tombstones/{uuid.uuid4().hex}"
        tombstones.select("record_id", "deleted_at", "reason").write.parquet(folder)
        per = self.spark.read.parquet(folder).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("records")).collect()  # a row per file written
        while per:
            version = self.version() + 1
            try:
                self.commit(version, [json.dumps({"version": version, "action": "add", "kind": "tombstones", "path": r.path, "records": r.records}) for r in per])
                break
            except Conflict:
                continue
        return sum(r.records for r in per)

    def tombstones(self, version: int | None = None) -> DataFrame:
        paths = [r.path for r in self.live("tombstones", version).select("path").collect()]
        schema = "record_id string, deleted_at string, reason string"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def deletions_count(self, version: int | None = None) -> int:
        """Tombstones, from the log alone."""
        return self.live("tombstones", version).agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]

    def compact_tombstones(self) -> None:
        """Writes all tombstones together and puts the new files in place of the old ones, or raises Conflict; count and filter stay as they were."""
        head = self.version()
        old = [r.path for r in self.live("tombstones", head).select("path").collect()]
        if len(old) < 2:
            return
        folder = f"{self.root}/tombstones/{uuid.uuid4().hex}"
        self.tombstones(head).coalesce(max(1, len(old) // 64)).write.parquet(folder)
        per = self.spark.read.parquet(folder).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("records")).collect()
        entries = [{"action": "remove", "path": p} for p in old] + [{"action": "add", "path": r.path, "records": r.records} for r in per]
        self.commit(head + 1, [json.dumps(e | {"version": head + 1, "kind": "tombstones"}) for e in entries])

    def active(self, model: str | None = None, tier: str | None = None) -> DataFrame:
        """Records that no tombstone names."""
        return dataset.active(self.scan(model, tier), self.tombstones())
