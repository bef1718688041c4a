"""The record schema, and records made from tables of turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import SCHEMA_VERSION

TOOL_CALL = "struct<tool_name: string, tool_input: string, tool_output: string, tool_status: string, latency_ms: bigint>"
TURN = f"struct<`from`: string, value: string, tool_calls: array<{TOOL_CALL}>, token_count: bigint, generation_latency_ms: bigint>"
SCRUB_LOG = "struct<file_paths_redacted: int, api_keys_redacted: int, network_redacted: int, emails_redacted: int, phone_redacted: int, crypto_redacted: int, connection_strings_redacted: int, potential_names_redacted: int, items_flagged: int>"
FIELDS = {
    "schema_version": "string",
    "record_id": "string",
    "record_type": "string",
    "created_at": "timestamp",
    "submission_hash": "string",
    "trajectory": f"struct<format: string, conversations: array<{TURN}>, turn_count: int, total_tool_calls: int, successful_tool_calls: int, failed_tool_calls: int>",
    "model": "struct<model_name: string, model_family: string, parameter_count: string, quantization: string, context_window: bigint, context_used: bigint, provider: string, is_local: boolean, model_hash: string>",
    "hardware": "struct<gpu_name: string, gpu_vram_gb: int, gpu_count: int, cpu_name: string, ram_gb: int, os: string, inference_backend: string, cuda_version: string>",
    "outcome": "struct<user_rating: int, outcome_tags: array<string>, user_comment: string, task_category: string, difficulty_estimate: string>",
    "pain_points": "array<struct<category: string, severity: string, description: string, turn_index: int, reproducible: boolean>>",
    "submission": f"struct<agent_version: string, plugin_version: string, contributor_id: string, consent_level: string, pii_scrub_version: string, scrub_log: {SCRUB_LOG}>",
    "quality": "struct<quality_tier: string, composite_score: double, sub_scores: map<string, double>, scored_at: timestamp>",
}


def record_ddl() -> str:
    return ", ".join(f"`{k}` {v}" for k, v in FIELDS.items())


def complete(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """df with the record's columns in order and type after those of `keep`: missing ones null, defaults set, unknown ones dropped."""
    has = set(df.columns)
    out = df.select(*keep, *(F.col(k).cast(v).alias(k) if k in has else F.lit(None).cast(v).alias(k) for k, v in FIELDS.items()))
    return out.withColumn("schema_version", F.coalesce("schema_version", F.lit(SCHEMA_VERSION))).withColumn("record_type", F.coalesce("record_type", F.lit("task_trajectory")))


def from_turns(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """turns(key, turn, role, text) -> (key, conversations, dropped): user as human, assistant as gpt, other roles dropped and counted, in turn order."""
    role = F.when(F.col("role").isin("user", "human"), "human").when(F.col("role").isin("assistant", "gpt"), "gpt")
    rows = turns.select(key, "turn", role.alias("from"), F.col("text").alias("value"))
    legal = F.col("from").isNotNull()
    one = F.when(legal, F.struct("turn", "from", "value"))
    packed = rows.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("_t"), F.sum((~legal).cast("int")).alias("dropped"))
    return packed.select(key, F.transform("_t", lambda t: F.struct(t["from"].alias("from"), t["value"].alias("value"))).alias("conversations"), "dropped")
