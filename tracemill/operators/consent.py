"""Consent levels and hardware generalization applied to whole records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.privacy import anonymize_hardware, jitter, redacted_turns
from ..functions.text import record_id, submission_hash


def strip(records: DataFrame, now: Column, level: Column | None = None) -> DataFrame:
    """What a record's consent level leaves of it; a level that isn't known leaves all. now: the time that replaces created_at where timing goes."""
    level = F.coalesce(F.col("submission.consent_level"), F.lit("full")) if level is None else level
    anonymous, text_only, no_text = level == "anonymous", level == "trajectory_only", level == "metadata_only"
    s = F.col("submission")
    submission = F.when(anonymous, s.withField("contributor_id", F.lit(None).cast("string")).withField("agent_version", F.lit(None).cast("string"))).when(text_only, s.withField("contributor_id", F.lit(None).cast("string"))).otherwise(s)
    bare = F.struct(*(F.col("model.model_name").alias("model_name") if f.name == "model_name" else F.lit(None).cast(f.dataType).alias(f.name) for f in records.schema["model"].dataType.fields))
    return records.withColumns(
        {
            "model": F.when(anonymous, None).when(text_only & F.col("model").isNotNull(), bare).otherwise(F.col("model")),
            "hardware": F.when(~(anonymous | text_only), F.col("hardware")),
            "outcome": F.when(~anonymous, F.col("outcome")),
            "pain_points": F.when(~anonymous, F.col("pain_points")),
            "submission": F.when(s.isNotNull(), submission),
            "created_at": F.when(anonymous | text_only, now).otherwise(F.col("created_at")),
            "trajectory": F.when(no_text, F.col("trajectory").withField("conversations", redacted_turns(F.col("trajectory.conversations")))).otherwise(F.col("trajectory")),
        }
    )


def anonymize(records: DataFrame) -> DataFrame:
    return records.withColumn("hardware", anonymize_hardware(F.col("hardware")))


def jitter_created(records: DataFrame) -> DataFrame:
    return records.withColumn("created_at", jitter(F.col("created_at"), F.col("trajectory.conversations")))


def with_ids(records: DataFrame) -> DataFrame:
    """record_id and submission_hash from what the record holds now: to be called last."""
    turns = F.col("trajectory.conversations")
    return records.withColumn("record_id", record_id(turns)).withColumn("submission_hash", submission_hash(turns, F.col("model.model_name"), F.col("outcome.user_rating"), F.col("outcome.outcome_tags")))
