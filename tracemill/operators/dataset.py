"""The dataset of records by model, tier and shard: placing, insert-if-absent, upserts, tombstones, download plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import model_slug, shard

KEY = ["model_slug", "tier", "record_id"]


def placed(records: DataFrame, model_name: str = "model.model_name", tier: str = "quality.quality_tier") -> DataFrame:
    """records with model_slug, tier and shard; no usable name is `unknown`, no tier `review_needed`."""
    return records.withColumns(
        {
            "model_slug": F.coalesce(F.nullif(model_slug(F.col(model_name)), F.lit("")), F.lit("unknown")),
            "tier": F.coalesce(F.nullif(F.col(tier), F.lit("")), F.lit("review_needed")),
            "shard": shard(F.col("record_id")),
        }
    )


def first_of_each(batch: DataFrame, order: str) -> DataFrame:
    """One row per key, the first by `order`; rows without an id go. min_by keeps one row per key and task before anything moves."""
    usable = batch.where(F.coalesce(F.col("record_id"), F.lit("")) != "")
    one = usable.groupBy(*KEY).agg(F.min_by(F.struct(*(c for c in batch.columns if c not in KEY)), F.col(order)).alias("_r"))
    return one.select(*KEY, "_r.*").select(*batch.columns)


def insert_if_absent(batch: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """Rows of batch to append: ids new to their model and tier, each once. The same id under another model or tier is no repeat."""
    return first_of_each(batch, order).join(existing.select(*KEY).distinct(), KEY, "left_anti")


def last_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Upsert: the last row by `order` for each key."""
    one = rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != key)), F.col(order)).alias("_r"))
    return one.select(key, "_r.*").select(*rows.columns)


def active(records: DataFrame, deletions: DataFrame) -> DataFrame:
    """Records that no tombstone names."""
    return records.join(deletions.select("record_id").distinct(), "record_id", "left_anti")


def to_download(plan: DataFrame, present: DataFrame) -> DataFrame:
    """Shard paths of a plan that aren't there yet."""
    return plan.join(present.select("path").distinct(), "path", "left_anti")


def rank_newest(files: DataFrame) -> DataFrame:
    return files.withColumn("rank", F.row_number().over(W.orderBy(F.desc("modified"), "path")))
