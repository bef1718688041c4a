"""Catalog of a dataset: aggregates by model and tier, its queries and summaries.

Records are aggregated once, by model and tier with partial aggregation; everything else is computed from those few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import TIER_RANKS
from ..functions.privacy import tier_rank
from ..functions.text import byte_label


#: GPUs named in a model's details.
TOP_HARDWARE = 5
#: Scores to nine decimals; sums of 10^19 records fit.
SCORE = "decimal(18, 9)"


def tier_stats(records: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """records(model_slug, tier, shard, score) [files(model_slug, tier, shard, size, modified)] -> a row per model and tier, also for tiers of empty files.

    Scores are added up as decimals: the mean doesn't depend on the order of the rows, nor its rounding on the last bit.
    """
    exact = F.sum(F.col("score").cast(SCORE))
    mean = F.round(exact / F.count("score"), 4).cast("double")
    stats = records.groupBy("model_slug", "tier").agg(
        F.count(F.lit(1)).alias("record_count"),
        F.coalesce(mean, F.lit(0.0)).alias("avg_quality_score"),
        F.array_sort(F.collect_set("shard")).alias("shards"),
    )
    if files is None:
        return stats
    own = files.groupBy("model_slug", "tier").agg(
        F.array_sort(F.collect_set("shard")).alias("files"), F.sum("size").alias("total_size_bytes"), F.max("modified").alias("last_updated")
    )
    joined = own.join(stats, ["model_slug", "tier"], "left")
    return joined.select("model_slug", "tier", F.coalesce("record_count", F.lit(0)).alias("record_count"), F.coalesce("avg_quality_score", F.lit(0.0)).alias("avg_quality_score"), F.col("files").alias("shards"), "total_size_bytes", "last_updated")


def in_first_order(values: Column, at: Column) -> Column:
    """Distinct values that aren't null or empty, in the order of their first place. The set of (place, value) pairs is pre-aggregated to one place per value by the caller."""
    return F.transform(F.array_sort(F.collect_list(F.when(values.isNotNull(), F.struct(at.alias("at"), values.alias("v"))))), lambda x: x["v"])


def model_stats(records: DataFrame, attributes: tuple[str, ...] = ()) -> DataFrame:
    """records(model_slug, model_name, at, gpu_name, *attributes) -> a row per model.

    at orders rows (tier, shard, line). display_name: the first name that differs from the slug, else the slug.
    Each attribute becomes the list of its distinct values in the order of their first row, hardware_distribution the
    count of each GPU name.
    """
    base = records.groupBy("model_slug").agg(
        F.count(F.lit(1)).alias("total_records"),
        F.coalesce(F.min_by("model_name", F.when((F.col("model_name") != F.col("model_slug")) & (F.col("model_name") != ""), F.col("at"))), F.first("model_slug")).alias("display_name"),
    )
    for name in attributes:
        value = F.col(name)
        used = records.where(value.isNotNull() & ~value.cast("string").isin("", "0"))
        firsts = used.groupBy("model_slug", name).agg(F.min("at").alias("at"))  # one row per value before lists are made
        base = base.join(firsts.groupBy("model_slug").agg(in_first_order(F.col(name), F.col("at")).alias(f"{name}s")), "model_slug", "left")
        base = base.withColumn(f"{name}s", F.coalesce(f"{name}s", F.array().cast(f"array<{dict(records.dtypes)[name]}>")))
    gpus = records.where(F.coalesce("gpu_name", F.lit("")) != "").groupBy("model_slug", "gpu_name").agg(F.count(F.lit(1)).alias("n"))
    return base.join(gpus.groupBy("model_slug").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("gpu_name", "n")))).alias("hardware_distribution")), "model_slug", "left")


def quality_distribution(tiers: DataFrame) -> DataFrame:
    """(tier, record_count): all known tiers, with 0 where there is none, and unknown ones that occur."""
    known = tiers.sparkSession.createDataFrame([(t, 0) for t in TIER_RANKS], "tier string, record_count bigint")
    return known.unionByName(tiers.select("tier", "record_count")).groupBy("tier").agg(F.sum("record_count").alias("record_count"))


def catalog_totals(tiers: DataFrame, deletions: int = 0) -> DataFrame:
    """Sums over all tiers; records that were deleted still count."""
    size = F.coalesce(F.sum("total_size_bytes"), F.lit(0)) if "total_size_bytes" in tiers.columns else F.lit(0)
    return tiers.agg(F.coalesce(F.sum("record_count"), F.lit(0)).alias("total_records"), size.cast("bigint").alias("total_size_bytes"), F.lit(deletions).cast("bigint").alias("deletions_count"))


def rollup(records: DataFrame) -> DataFrame:
    """Counts by model and tier, by model, and of all, in one pass; null marks `all`."""
    return records.rollup("model_slug", "tier").agg(F.count(F.lit(1)).alias("record_count"), F.grouping_id().alias("level"))


def filter_catalog(tiers: DataFrame, model: str | None = None, tier: str | None = None) -> DataFrame:
    """Tiers of models whose slug or display_name contains `model`, in any case, and of that tier alone. Totals are those of the unfiltered catalog."""
    out = tiers
    if model:
        low = F.lit(model.lower())
        named = F.contains(F.lower("model_slug"), low)
        out = out.where(named | F.contains(F.lower("display_name"), low) if "display_name" in tiers.columns else named)
    return out.where(F.col("tier") == tier) if tier else out


def browse(tiers: DataFrame) -> DataFrame:
    """A row per model with its counts in gold, silver and bronze; total counts other tiers too."""
    pivot = tiers.groupBy("model_slug").pivot("tier", ["gold", "silver", "bronze"]).agg(F.coalesce(F.first("record_count"), F.lit(0)))
    total = tiers.groupBy("model_slug").agg(F.sum("record_count").alias("total"), _average().alias("average"))
    return pivot.na.fill(0, ["gold", "silver", "bronze"]).join(total, "model_slug")


def _average() -> Column:
    """Unweighted mean of the tiers' averages over 0, as text."""
    mean = F.avg(F.when(F.col("avg_quality_score") > 0, F.col("avg_quality_score")))
    return F.when(mean.isNotNull(), F.format_string("%.2f", mean)).otherwise("N/A")


def model_summary(tiers: DataFrame) -> DataFrame:
    """Records, mean of tier averages and highest tier of each model."""
    return tiers.groupBy("model_slug").agg(F.sum("record_count").alias("record_count"), _average().alias("average"), F.coalesce(F.max_by("tier", tier_rank(F.col("tier"))), F.lit("review_needed")).alias("top_tier"))


def tier_shares(distribution: DataFrame) -> DataFrame:
    """Share of each tier in percent with one decimal, and its rank."""
    total = distribution.agg(F.sum("record_count").alias("total"))
    share = F.when(F.col("total") > 0, F.format_string("%.1f", F.col("record_count") / F.col("total") * 100)).otherwise("0.0")
    return distribution.join(F.broadcast(total)).select("tier", "record_count", share.alias("percentage"), tier_rank(F.col("tier")).alias("rank"))  # total is one row


def shard_plan(tiers: DataFrame) -> DataFrame:
    """A row per shard file of the tiers."""
    return tiers.select("model_slug", "tier", F.explode("shards").alias("shard")).withColumn("path", F.concat(F.concat_ws("/", F.lit("data"), "model_slug", "tier", F.concat(F.lit("shard_"), "shard")), F.lit(".jsonl")))


def tier_breakdown(tiers: DataFrame, slug: str) -> DataFrame:
    own = tiers.where(F.col("model_slug") == slug)
    return own.select("tier", "record_count", "avg_quality_score", F.size("shards").alias("n_shards"), byte_label(F.col("total_size_bytes")).alias("size") if "total_size_bytes" in tiers.columns else F.lit(None).cast("string").alias("size"), tier_rank(F.col("tier")).alias("rank"))


def drill_down(models: DataFrame, tiers: DataFrame, slug: str, attributes: tuple[str, ...] = ("parameter_count", "quantization", "context_window")) -> DataFrame:
    """One row for a model of model_stats() and tier_stats(): its name, its attribute lists as text, `---` where empty, its tiers, best first, and its five most frequent GPUs."""
    listed = [F.coalesce(F.nullif(F.array_join(F.transform(f"{a}s", lambda x: x.cast("string")), ", "), F.lit("")), F.lit("---")).alias(f"{a}s") for a in attributes]
    in_order = F.array_sort(F.transform(F.map_entries("hardware_distribution"), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("name"))))
    top = F.array_join(F.transform(F.slice(in_order, 1, TOP_HARDWARE), lambda x: F.format_string("%s (%d)", x["name"], -x["n"])), ", ")
    per = tier_breakdown(tiers, slug).groupBy().agg(F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("place"), "tier", "record_count", "avg_quality_score"))).alias("t"))  # a row per tier
    shown = F.array_join(F.transform("t", lambda x: F.format_string("%s %d %.2f", x["tier"], x["record_count"], x["avg_quality_score"])), ", ")
    return models.where(F.col("model_slug") == slug).join(F.broadcast(per)).select("model_slug", "display_name", *listed, "total_records", shown.alias("tiers"), F.coalesce(top, F.lit("")).alias("hardware"))


def available(tiers: DataFrame) -> DataFrame:
    """What to choose from where a filter finds nothing: one row with all models and all tiers, in order."""
    return tiers.agg(F.array_sort(F.collect_set("model_slug")).alias("models"), F.array_sort(F.collect_set("tier")).alias("tiers"))


def browse_filtered(models: DataFrame, tiers: DataFrame, model: str | None = None, tier: str | None = None) -> tuple[str, DataFrame]:
    """(`empty`, nothing), (`none`, available()), (`model`, drill_down()) where a model filter leaves one model, or (`summary`, browse())."""
    found = filter_catalog(tiers, model, tier)
    slugs = [r.model_slug for r in found.select("model_slug").distinct().limit(2).collect()]
    if not slugs:
        return ("empty", tiers) if tiers.isEmpty() else ("none", available(tiers))
    return ("model", drill_down(models, found, slugs[0])) if model and len(slugs) == 1 else ("summary", browse(found))
