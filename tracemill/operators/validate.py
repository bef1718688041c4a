"""Validation of records: each rule gives the name of what is wrong, so that rejects stay explained."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed


def _all_in(array: Column, pick, vocabulary: tuple[str, ...], required: bool = True) -> Column:
    value = lambda x: F.coalesce(pick(x).isin(*vocabulary), F.lit(not required))
    return F.coalesce(F.forall(array, value), F.lit(True))


def _in(value: Column, vocabulary: tuple[str, ...]) -> Column:
    return value.isNull() | value.isin(*vocabulary)


def rules() -> dict[str, Column]:
    """What must hold, by name; null counts as met where a field may be missing."""
    c, t, o, q = F.col, F.col("trajectory"), F.col("outcome"), F.col("quality")
    turns = t["conversations"]
    counts = [F.coalesce(t[x], F.lit(0)) for x in ("total_tool_calls", "successful_tool_calls", "failed_tool_calls")]
    calls = F.flatten(F.transform(turns, lambda x: F.coalesce(x["tool_calls"], F.array().cast("array<struct<tool_name: string, tool_input: string, tool_output: string, tool_status: string, latency_ms: bigint>>"))))
    return {
        "conversations": F.coalesce(F.size(turns) > 0, F.lit(False)),
        "turn_count": F.coalesce(t["turn_count"], F.lit(0)).isin(0) | (t["turn_count"] == F.size(turns)),
        "tool_counts": ((counts[0] == 0) & (counts[1] == 0) & (counts[2] == 0)) | (counts[1] + counts[2] == counts[0]),
        "turn_from": _all_in(turns, lambda x: x["from"], fixed.ROLES),
        "turn_value": F.coalesce(F.forall(turns, lambda x: x["value"].isNotNull()), F.lit(True)),
        "tool_name": F.coalesce(F.forall(calls, lambda x: x["tool_name"].isNotNull()), F.lit(True)),
        "tool_status": _all_in(calls, lambda x: x["tool_status"], fixed.TOOL_STATUSES),
        "record_type": _in(c("record_type"), fixed.RECORD_TYPES),
        "model_name": c("model").isNull() | c("model.model_name").isNotNull(),
        "provider": _in(c("model.provider"), fixed.PROVIDERS),
        "user_rating": o.isNull() | F.coalesce(o["user_rating"].between(1, 5), F.lit(False)),
        "outcome_tags": F.size(F.array_except(F.coalesce(o["outcome_tags"], F.array().cast("array<string>")), F.array(*map(F.lit, fixed.OUTCOME_TAGS)))) == 0,
        "difficulty_estimate": _in(o["difficulty_estimate"], fixed.DIFFICULTIES),
        "pain_category": _all_in(c("pain_points"), lambda x: x["category"], fixed.PAIN_POINT_CATEGORIES),
        "pain_severity": _all_in(c("pain_points"), lambda x: F.coalesce(x["severity"], F.lit("medium")), fixed.SEVERITIES),
        "pain_description": F.coalesce(F.forall("pain_points", lambda x: x["description"].isNotNull()), F.lit(True)),
        "consent_level": _in(c("submission.consent_level"), fixed.CONSENT_LEVELS),
        "quality_tier": q.isNull() | q["quality_tier"].isNotNull(),
        "composite_score": q.isNull() | F.coalesce(q["composite_score"].between(0.0, 1.0), F.lit(False)),
    }


def errors() -> Column:
    """Names of the rules that a record breaks, in the order of rules()."""
    return F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(True)), name) for name, ok in rules().items())), lambda x: x.isNotNull())


def validate(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid records, rejects with a column `errors`). Where records come with `unread` (sources.typed), each field in it is an error `type:{field}` first."""
    found = errors()
    if "unread" in records.columns:
        found = F.concat(F.array_distinct(F.transform("unread", lambda x: F.concat(F.lit("type:"), x["field"]))), found)
    judged = records.withColumn("errors", found)
    return judged.where(F.size("errors") == 0).drop("errors"), judged.where(F.size("errors") > 0)


def require_valid(records: DataFrame, key: str) -> DataFrame:
    """records if all of them are valid; else an error that names up to ten and what is wrong with each."""
    bad = validate(records)[1].select(key, "errors").limit(10).collect()
    if bad:
        raise ValueError("; ".join(f"{r[0]}: {', '.join(r.errors)}" for r in bad))
    return records
