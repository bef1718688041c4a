"""Assembly of session events into trajectories and full records.

Kinds of events: start, turn, rate, report and end. Within a session they count in the order of seq; a start resets what
came before it and captures model and hardware. A session's events are brought together once, by session_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fixed import OUTCOME_TAGS, PAIN_POINT_CATEGORIES, SEVERITIES, TOOL_STATUSES
from ..functions.text import tool_text
from ..sources.records import FIELDS, TOOL_CALL, TURN, complete
from .exports import tool_counts

GIVEN_CALL = "struct<name: string, input: string, output: string, status: string, latency_ms: bigint>"
EVENT = (
    "session_id string, seq bigint, kind string, role string, content string, rating int, tags array<string>, category string, description string, "
    f"comment string, severity string, tool_calls array<{GIVEN_CALL}>, token_count bigint, latency_ms bigint, model {FIELDS['model']}, hardware {FIELDS['hardware']}, at timestamp"
)
SESSION = (
    f"session_id string, conversations array<{TURN}>, user_rating int, outcome_tags array<string>, user_comment string, pain_points {FIELDS['pain_points']}, "
    f"model {FIELDS['model']}, hardware {FIELDS['hardware']}, created_at timestamp, ended boolean"
)
HUMAN, ASSISTANT = ("user", "human"), ("assistant", "gpt")


def model_metadata(model: Column) -> Column:
    """Model of a start event: no name is `unknown`, the used part of the context isn't known."""
    named = model.withField("model_name", F.coalesce(model["model_name"], F.lit("unknown"))).withField("context_used", F.lit(None).cast("bigint"))
    return F.when(model.isNotNull(), named)


def _is_turn(e: Column) -> Column:
    calls = F.coalesce(F.forall(e["tool_calls"], lambda c: c["name"].isNotNull() & F.coalesce(c["status"].isin(*TOOL_STATUSES), F.lit(True))), F.lit(True))
    return (e["kind"] == "turn") & F.coalesce(e["role"].isin(*HUMAN, *ASSISTANT), F.lit(False)) & e["content"].isNotNull() & calls


def _is_rating(e: Column) -> Column:
    known = F.coalesce(F.forall(e["tags"], lambda t: F.coalesce(t.isin(*OUTCOME_TAGS), F.lit(False))), F.lit(True))
    return (e["kind"] == "rate") & F.coalesce(e["rating"].between(1, 5), F.lit(False)) & known


def _is_report(e: Column) -> Column:
    severe = F.coalesce(e["severity"].isin(*SEVERITIES), F.lit(True))
    return (e["kind"] == "report") & F.coalesce(e["category"].isin(*PAIN_POINT_CATEGORIES), F.lit(False)) & severe & e["description"].isNotNull()


def _turn(e: Column) -> Column:
    call = lambda c: F.struct(
        c["name"].alias("tool_name"),
        tool_text(F.coalesce(c["input"], F.lit(""))).alias("tool_input"),
        tool_text(F.coalesce(c["output"], F.lit(""))).alias("tool_output"),
        F.coalesce(c["status"], F.lit("success")).alias("tool_status"),
        c["latency_ms"].alias("latency_ms"),
    )
    return F.struct(
        F.when(e["role"].isin(*HUMAN), "human").otherwise("gpt").alias("from"),
        e["content"].alias("value"),
        F.when(F.size(e["tool_calls"]) > 0, F.transform(e["tool_calls"], call)).cast(f"array<{TOOL_CALL}>").alias("tool_calls"),
        e["token_count"].alias("token_count"),
        e["latency_ms"].alias("generation_latency_ms"),
    )


def assemble(events: DataFrame) -> DataFrame:
    """events(EVENT) -> a row per session (SESSION): turns in order, the last valid rating, reports with the number of the turn they came after, model and hardware of the start, and whether it ended.

    Turns without a known role, content, or a named tool with a known status are skipped; ratings outside 1 to 5 or with
    unknown tags, and reports of an unknown category or severity, are ignored; what comes after an end still counts,
    until the next start. turn_index is the number of turns so far less one, 0 if there is none.

    Events are dealt by session once: what precedes the last start goes and turns are numbered by windows over the sorted
    session, so the work for a session grows with its events.
    """
    of = W.partitionBy("session_id")
    e = {f: F.col(f) for f in ("kind", "role", "content", "tool_calls", "rating", "tags", "category", "description", "severity")}
    last_start = F.max(F.when(F.col("kind") == "start", F.col("seq"))).over(of)
    since = events.withColumn("_start", last_start).where(F.col("_start").isNull() | (F.col("seq") >= F.col("_start")))
    before = F.sum(_is_turn(e).cast("int")).over(of.orderBy("seq").rangeBetween(W.unboundedPreceding, -1))
    kept = since.withColumn("_before", F.coalesce(before, F.lit(0)))
    one = F.struct(F.col("seq"), *(c for c in events.columns if c not in ("session_id", "seq", "model", "hardware")), "_before")
    start = F.max_by(F.struct("model", "hardware", "at"), F.when((F.col("kind") == "start") & (F.col("seq") == F.col("_start")), F.col("seq")))
    packed = kept.groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.when(_is_turn(e), one))).alias("turns"),  # bounded by a session
        F.array_sort(F.collect_list(F.when(_is_report(e), one))).alias("reports"),
        F.max_by(one, F.when(_is_rating(e), F.col("seq"))).alias("rated"),
        start.alias("start"),
        F.max(F.col("kind") == "end").alias("ended"),
    )
    reports = F.transform(
        "reports",
        lambda r: F.struct(r["category"].alias("category"), F.coalesce(r["severity"], F.lit("medium")).alias("severity"), r["description"].alias("description"), F.greatest(r["_before"] - 1, F.lit(0)).cast("int").alias("turn_index"), F.lit(None).cast("boolean").alias("reproducible")),
    )
    rated = F.col("rated")
    return packed.select(
        "session_id",
        F.transform("turns", _turn).alias("conversations"),
        rated["rating"].alias("user_rating"),
        F.when(rated.isNotNull(), F.coalesce(rated["tags"], F.array().cast("array<string>"))).alias("outcome_tags"),
        F.nullif(rated["comment"], F.lit("")).alias("user_comment"),
        reports.alias("pain_points"),
        model_metadata(F.col("start.model")).alias("model"),
        F.col("start.hardware").alias("hardware"),
        F.col("start.at").alias("created_at"),
        F.coalesce("ended", F.lit(False)).alias("ended"),
    )


def build_records(sessions: DataFrame, now: Column) -> DataFrame:
    """sessions(SESSION) -> the record's columns and session_id: turn and tool counts, outcome and reports where there are any, consent `full`. now: created_at of sessions without a start."""
    turns = F.col("conversations")
    counts = tool_counts(turns)
    submission = F.struct(F.lit("full").alias("consent_level"))
    made = sessions.select(
        "session_id",
        F.coalesce("created_at", now).alias("created_at"),
        F.struct(
            F.lit("sharegpt_extended").alias("format"),
            turns.alias("conversations"),
            F.size(turns).alias("turn_count"),
            *(counts[c].alias(c) for c in ("total_tool_calls", "successful_tool_calls", "failed_tool_calls")),
        ).alias("trajectory"),
        "model",
        "hardware",
        F.when(F.col("user_rating").isNotNull(), F.struct(F.col("user_rating").alias("user_rating"), F.col("outcome_tags").alias("outcome_tags"), F.col("user_comment").alias("user_comment"), F.lit(None).cast("string").alias("task_category"), F.lit(None).cast("string").alias("difficulty_estimate"))).alias("outcome"),
        F.when(F.size("pain_points") > 0, F.col("pain_points")).alias("pain_points"),
        _widened(submission, sessions, "submission").alias("submission"),
    )
    return complete(made, ("session_id",))


def _widened(struct: Column, df: DataFrame, name: str) -> Column:
    """struct with all fields of the record's column, null where it has none."""
    want = df.sparkSession.createDataFrame([], f"x {FIELDS[name]}").schema["x"].dataType
    return F.struct(*((struct["consent_level"] if f.name == "consent_level" else F.lit(None)).cast(f.dataType).alias(f.name) for f in want.fields))


def from_event_table(events: DataFrame) -> DataFrame:
    """Session events from a table (event_id, ts, user_id, event_type, value, props): a session per user; signup starts, view and click are turns, purchase rates, error reports."""
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type").isin("view", "click"), "turn").when(F.col("event_type") == "purchase", "rate").otherwise("report")
    is_start, k = F.col("event_type") == "signup", F.col("event_id")
    status = F.when(k % 3 == 0, "failure").when(k % 3 == 1, "success")
    call = F.struct(F.concat(F.lit("tool"), (k % 4).cast("string")).alias("name"), F.col("props").alias("input"), F.lit(None).cast("string").alias("output"), status.alias("status"), (k % 100).alias("latency_ms"))
    model = F.struct(F.when(F.col("user_id") % 7 > 0, F.concat(F.lit("model "), (F.col("user_id") % 7).cast("string"))).alias("model_name"), F.lit("8B").alias("parameter_count"))
    hardware = F.struct(F.lit("NVIDIA RTX 4090").alias("gpu_name"), F.lit(24).alias("gpu_vram_gb"))
    out = events.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"),
        k.alias("seq"),
        kind.alias("kind"),
        F.when(F.col("event_type") == "view", "user").when(F.col("event_type") == "click", "assistant").alias("role"),
        F.col("props").alias("content"),
        F.floor(F.col("value") % 7).cast("int").alias("rating"),
        F.array(F.when(k % 5 == 0, "not_a_tag").otherwise("task_completed")).alias("tags"),
        F.lit("other").alias("category"),
        F.col("props").alias("description"),
        F.when(k % 2 == 0, F.col("props")).alias("comment"),
        F.when(k % 3 == 0, "high").alias("severity"),
        F.when((F.col("event_type") == "click") & (k % 2 == 0), F.array(call)).alias("tool_calls"),
        (k % 50).alias("token_count"),
        (k % 70).alias("latency_ms"),
        F.when(is_start, model).alias("model"),
        F.when(is_start, hardware).alias("hardware"),
        F.col("ts").alias("at"),
    )
    return _as_events(out)


def _as_events(events: DataFrame) -> DataFrame:
    """events with all columns of EVENT, in type and order; struct fields by name."""
    want = events.sparkSession.createDataFrame([], EVENT).schema
    have = {f.name: f.dataType for f in events.schema.fields}

    def typed(name: str, kind) -> Column:
        if name not in have:
            return F.lit(None).cast(kind).alias(name)
        if kind.typeName() == "struct":
            own = {f.name for f in have[name].fields}
            made = F.struct(*((F.col(name)[f.name] if f.name in own else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields))
            return F.when(F.col(name).isNotNull(), made).alias(name)
        return F.col(name).cast(kind).alias(name)

    return events.select(*(typed(f.name, f.dataType) for f in want.fields))
