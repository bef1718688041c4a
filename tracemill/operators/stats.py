"""Counts over submissions and activity, and ranked reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tier_counts(records: DataFrame) -> DataFrame:
    return records.groupBy(F.coalesce("quality.quality_tier", F.lit("?")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


def with_errors(counts: DataFrame, rejects: DataFrame) -> DataFrame:
    """Tier counts with a bucket `error`: rejected records also stay in their tier."""
    bad = rejects.agg(F.count(F.lit(1)).alias("n")).select(F.lit("error").alias("tier"), "n")
    return counts.unionByName(bad.where("n > 0"))


def tag_counts(records: DataFrame) -> DataFrame:
    return records.select(F.explode("outcome.outcome_tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def pain_counts(records: DataFrame) -> DataFrame:
    return records.select(F.explode("pain_points.category").alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def top(rows: DataFrame, value: str, order: str, n: int = 10) -> DataFrame:
    """The n most frequent values; ties go to the value that `order` puts first. Sorted by each task before the driver merges n rows of each."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen"))
    return counts.orderBy(F.desc("n"), "first_seen").limit(n)


def activity_summary(activity: DataFrame) -> DataFrame:
    return activity.groupBy("action").agg(F.count(F.lit(1)).alias("n"))
