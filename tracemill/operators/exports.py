"""Projections of records: training formats, tool counts, history rows."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import CATEGORIES
from ..functions.scrub import org_domains
from ..functions.text import preview
from ..sources.records import FIELDS, TOOL_CALL

if TYPE_CHECKING:
    from .scoring import Scoring


def sharegpt(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["from"].alias("from"), t["value"].alias("value")))


def dpo_prompt(turns: Column) -> Column:
    """The first human text that isn't empty."""
    said = F.filter(turns, lambda t: (t["from"] == "human") & (t["value"] != ""))
    return F.coalesce(F.get(said, 0)["value"], F.lit(""))


def dpo_response(turns: Column) -> Column:
    return F.array_join(F.transform(F.filter(turns, lambda t: t["from"] == "gpt"), lambda t: t["value"]), "\n")


def tool_counts(turns: Column) -> Column:
    """All calls, those that succeeded, and the others."""
    calls = F.flatten(F.filter(F.transform(turns, lambda t: t["tool_calls"]), lambda x: x.isNotNull()))
    total, good = F.size(calls), F.size(F.filter(calls, lambda c: c["tool_status"] == "success"))
    return F.struct(total.alias("total_tool_calls"), good.alias("successful_tool_calls"), (total - good).alias("failed_tool_calls"))


def history(records: DataFrame) -> DataFrame:
    """A short row for each record; tier and score as stored, `?` and a dash where there is none."""
    return records.select(
        "record_id",
        "record_type",
        F.size("trajectory.conversations").alias("turn_count"),
        F.left(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(19)).alias("created_at"),
        F.coalesce("quality.quality_tier", F.lit("?")).alias("tier"),
        F.when(F.col("quality.composite_score").isNotNull(), F.format_string("%.3f", F.col("quality.composite_score"))).otherwise("-").alias("score"),
    )


def scrub_summary(counts: DataFrame) -> DataFrame:
    """df with `{category}_redacted` columns -> (label, n) of those over 0 in sum, labels in title case."""
    sums = counts.agg(*(F.sum(f"{c}_redacted").alias(c) for c in CATEGORIES))
    rows = sums.select(F.explode(F.array(*(F.struct(F.initcap(F.lit(c.replace("_", " "))).alias("label"), F.col(c).alias("n")) for c in CATEGORIES))).alias("x"))
    return rows.select("x.*").where("n > 0")


def preview_flags() -> Column:
    """Organisations' domains in the texts of turns and tools as they stand, in order; those of comments and pain points don't count."""
    texts = lambda t: F.concat(F.array(t["value"]), F.flatten(F.transform(F.coalesce(t["tool_calls"], F.array().cast(f"array<{TOOL_CALL}>")), lambda c: F.array(c["tool_input"], c["tool_output"]))))
    return F.flatten(F.transform(F.flatten(F.transform("trajectory.conversations", texts)), lambda x: F.coalesce(org_domains(x), F.array().cast("array<string>"))))


def record_preview(records: DataFrame, scoring: Scoring) -> DataFrame:
    """What a record's owner sees before it is submitted: counts, model, tier and score, annotations, flags, and the first and last turn. records: redacted ones, with a column raw_flags of preview_flags()."""
    t, turns = F.col("trajectory"), F.col("trajectory.conversations")
    model = F.when(F.col("model.quantization").isNotNull(), F.format_string("%s (%s)", F.col("model.model_name"), F.col("model.quantization"))).otherwise(F.col("model.model_name"))
    calls = F.format_string("%d total (%d success, %d failed)", *(F.coalesce(t[c], F.lit(0)) for c in ("total_tool_calls", "successful_tool_calls", "failed_tool_calls")))
    pains = F.transform("pain_points", lambda p: F.format_string("[%s] %s: %s", p["severity"], p["category"], p["description"]))
    last = F.when(F.size(turns) > 1, preview(F.element_at(turns, -1)["value"]))
    return records.withColumn("_score", scoring.score()).select(
        *(c for c in records.columns if c not in FIELDS and c != "raw_flags"),
        "record_type",
        t["turn_count"].alias("turn_count"),
        calls.alias("tool_calls"),
        model.alias("model"),
        scoring.tier(F.col("_score")).alias("tier"),
        F.format_string("%.3f", F.col("_score")).alias("score"),
        F.format_string("%d/5", F.col("outcome.user_rating")).alias("rating"),
        F.array_join("outcome.outcome_tags", ", ").alias("tags"),
        F.col("outcome.user_comment").alias("comment"),
        F.array_join(pains, "\n").alias("pain_points"),
        F.array_join("raw_flags", ", ").alias("flags"),
        preview(F.get(turns, 0)["value"]).alias("first_turn"),
        last.alias("last_turn"),
    )
