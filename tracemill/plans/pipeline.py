"""The record pipelines: submit staged records, end sessions, publish the outbox, and build the catalog of a dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.privacy import meets_tier
from ..operators import catalog, consent, dataset
from ..operators.scoring import Scoring
from ..operators.scrub_records import scrub_records
from ..operators.validate import validate
from ..sources import files, sinks


def submit(records: DataFrame, now: Column, scoring: Scoring | None = None, score_first: bool = False) -> DataFrame:
    """Redacted, generalized, jittered records with consent applied, score and ids. score_first: score before consent, as live sessions do."""
    quality = (scoring or Scoring()).quality(now)
    out = consent.anonymize(scrub_records(records))
    if score_first:
        out = out.withColumn("quality", quality)
    out = consent.strip(consent.jitter_created(out), now)
    return consent.with_ids(out if score_first else out.withColumn("quality", quality))


def export_records(records: DataFrame, now: Column) -> DataFrame:
    """What a session exports: as submit(), but without a score."""
    return consent.with_ids(consent.strip(consent.jitter_created(consent.anonymize(scrub_records(records))), now))


def route(records: DataFrame, least_tier: str) -> tuple[DataFrame, DataFrame]:
    """(records that reach the tier and go to the outbox, the others, which stay in staging)."""
    good = meets_tier(F.col("quality.quality_tier"), F.lit(least_tier))
    return records.where(good), records.where(~good)


def routed(records: DataFrame, now: Column, mode: str = "ad-hoc", least_tier: str = "silver", key: str = "session_id") -> DataFrame:
    """Records of ended sessions, each in one row: place (`outbox` or `staging`), record (what goes there), and activity (what is logged, or null).

    mode `ad-hoc` leaves all of them in staging, as they are, and logs nothing; so does every mode but `continuous`.
    `continuous` submits those that reach least_tier, and logs `auto_submitted`; the others stay in staging as they
    are, not redacted, and are logged as `queued_for_review` by their key. A record's tier is judged once, from its
    redacted form before consent. The key only names records: one that is null or repeats changes no row's way.
    """
    activity = "struct<action: string, record_id: string, quality_tier: string, timestamp: timestamp>"
    as_is = F.struct(*records.columns)
    if mode != "continuous":
        return records.select(F.lit("staging").alias("place"), as_is.alias("record"), F.lit(None).cast(activity).alias("activity"))
    done = submit(records.withColumn("_as_is", as_is), now, score_first=True)
    good, tier = F.coalesce(meets_tier(F.col("quality.quality_tier"), F.lit(least_tier)), F.lit(False)), F.col("quality.quality_tier")
    entry = F.struct(F.when(good, "auto_submitted").otherwise("queued_for_review").alias("action"), F.when(good, F.col("record_id")).otherwise(F.col(key)).alias("record_id"), tier.alias("quality_tier"), now.alias("timestamp"))
    return done.select(F.when(good, "outbox").otherwise("staging").alias("place"), F.when(good, F.struct(*records.columns)).otherwise(F.col("_as_is")).alias("record"), entry.cast(activity).alias("activity"))


def end_sessions(records: DataFrame, now: Column, mode: str = "ad-hoc", least_tier: str = "silver", key: str = "session_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """routed() as (rows for the outbox, rows for staging, activity); who writes all three writes routed() first and splits what was written."""
    rows = routed(records, now, mode, least_tier, key)
    return rows.where("place = 'outbox'").select("record.*"), rows.where("place = 'staging'").select("record.*"), rows.where("activity is not null").select("activity.*")


def publish(outbox: DataFrame, existing: DataFrame, now: Column, order: str) -> tuple[DataFrame, DataFrame]:
    """(rows to append to the dataset, rejects): valid records with consent applied again, new to their model and tier."""
    valid, rejects = validate(outbox)
    return dataset.insert_if_absent(dataset.placed(consent.strip(valid, now)), existing, order), rejects


def publish_to(outbox: DataFrame, root: str, now: Column, order: str, generated_at: str, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """Publishes an outbox to the dataset at root -> (publish_summary(), rejects).

    Appends what is new to its model and tier to the shards, then writes catalog.json and README.md from a scan of all
    of them. A dry run writes nothing.
    """
    spark = outbox.sparkSession
    new, rejects = publish(outbox, files.shards(spark, root).select(*dataset.KEY), now, order)
    new = new.persist()
    summary = spark.createDataFrame(publish_summary(new).collect(), "n_records bigint, models array<string>, tiers array<string>, first_models array<string>")  # one row, before the shards change
    if not dry_run:
        sinks.append_shards(new, root, order)
        write_catalog(spark, root, generated_at)
    new.unpersist()
    return summary, rejects


def write_catalog(spark: SparkSession, root: str, generated_at: str) -> None:
    """catalog.json and README.md of the dataset at root, from its shards, their sizes and its deletions."""
    scanned = files.shards(spark, root)
    rows = scanned.select(
        "model_slug",
        "tier",
        "shard",
        F.col("quality.composite_score").alias("score"),
        F.col("model.model_name").alias("model_name"),
        F.col("hardware.gpu_name").alias("gpu_name"),
        *(F.col(f"model.{c}").alias(c) for c in ("parameter_count", "quantization", "context_window")),
        F.struct("tier", "shard", "line").alias("at"),
    )
    tiers = catalog.tier_stats(rows, files.shard_files(spark, root)).persist()  # a row per model and tier
    models = catalog.model_stats(rows, ("parameter_count", "quantization", "context_window"))
    distribution = catalog.quality_distribution(tiers)
    totals = catalog.catalog_totals(tiers, files.count_lines(spark, f"{root}/deletions.jsonl"))
    sinks.write_text(spark, f"{root}/catalog.json", sinks.catalog_json(tiers, models, distribution, totals, generated_at))
    sinks.write_text(spark, f"{root}/README.md", sinks.readme(tiers, distribution, totals))
    tiers.unpersist()


def delete(spark: SparkSession, root: str, record_id: str, deleted_at: str, reason: str | None = None) -> None:
    """Appends a tombstone to the dataset's deletions; whether there is such a record isn't looked at."""
    one = spark.createDataFrame([(record_id, deleted_at, reason)], "record_id string, deleted_at string, reason string")
    sinks.append_deletions(one, f"{root.rstrip('/')}/deletions.jsonl")


def publish_summary(written: DataFrame) -> DataFrame:
    """One row for what a publish appends, or would append in a dry run: count, models and tiers in order, and the first five models."""
    models = F.array_sort(F.collect_set("model_slug"))  # no more values than there are models
    return written.agg(F.count(F.lit(1)).alias("n_records"), models.alias("models"), F.array_sort(F.collect_set("tier")).alias("tiers"), F.slice(models, 1, 5).alias("first_models"))


def build_catalog(placed: DataFrame, deletions: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tiers, quality distribution, totals) of records with model_slug, tier, shard and score."""
    tiers = catalog.tier_stats(placed)
    return tiers, catalog.quality_distribution(tiers), catalog.catalog_totals(tiers, deletions)
