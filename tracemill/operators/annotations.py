"""Changes to staged records: ratings, reports and review decisions as tables that are joined to staging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import OUTCOME_TAGS, PAIN_POINT_CATEGORIES, SEVERITIES
from ..sources.records import FIELDS

RATING = "seq bigint, score int, tags array<string>, comment string"
REPORT = "seq bigint, category string, description string, severity string"
ACTIONS = ("approve", "reject", "skip", "quit")


def rate(staged: DataFrame, ratings: DataFrame, key: str) -> DataFrame:
    """staged with the outcome replaced by the last valid rating of its key. ratings: key and RATING.

    A rating is valid with a score from 1 to 5 and known tags; no tags are an empty list, an empty comment is none. The
    whole outcome is replaced. The last rating of each key is found before anything is joined.
    """
    known = F.coalesce(F.forall("tags", lambda t: F.coalesce(t.isin(*OUTCOME_TAGS), F.lit(False))), F.lit(True))
    valid = ratings.where(F.col("score").between(1, 5) & known)
    last = valid.groupBy(key).agg(F.max_by(F.struct("score", "tags", "comment"), "seq").alias("_rating"))
    r = F.col("_rating")
    outcome = F.struct(
        r["score"].alias("user_rating"),
        F.coalesce(r["tags"], F.array().cast("array<string>")).alias("outcome_tags"),
        F.nullif(r["comment"], F.lit("")).alias("user_comment"),
        F.lit(None).cast("string").alias("task_category"),
        F.lit(None).cast("string").alias("difficulty_estimate"),
    )
    return staged.join(last, key, "left").withColumn("outcome", F.when(r.isNotNull(), outcome).otherwise(F.col("outcome"))).select(*staged.columns)


def report(staged: DataFrame, reports: DataFrame, key: str) -> DataFrame:
    """staged with all valid reports of its key appended to its pain points, in the order of seq. reports: key and REPORT.

    Category and severity count without regard to case, no severity is medium; without a description, or with an
    unknown category or severity, a report is ignored. A report made afterwards has no turn.
    """
    rows = reports.select(key, "seq", F.lower("category").alias("category"), F.lower(F.coalesce("severity", F.lit("medium"))).alias("severity"), "description")
    valid = rows.where(F.col("category").isin(*PAIN_POINT_CATEGORIES) & F.col("severity").isin(*SEVERITIES) & F.col("description").isNotNull())
    per = valid.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "category", "severity", "description"))).alias("_reports"))  # the reports of one record
    added = F.transform("_reports", lambda x: F.struct(x["category"].alias("category"), x["severity"].alias("severity"), x["description"].alias("description"), F.lit(None).cast("int").alias("turn_index"), F.lit(None).cast("boolean").alias("reproducible")))
    kind = FIELDS["pain_points"]
    both = F.concat(F.coalesce(F.col("pain_points").cast(kind), F.array().cast(kind)), added.cast(kind))
    return staged.join(per, key, "left").withColumn("pain_points", F.when(F.col("_reports").isNotNull(), both).otherwise(F.col("pain_points"))).select(*staged.columns)


def decided(staged: DataFrame, decisions: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """staged with a column `action`: the decision (key, action) of each record, skip where there is none or an unknown one, null from the first quit on in `order`.

    The place of the first quit is one row, found by aggregation; no task sorts all records.
    """
    wanted = decisions.select(key, F.lower("action").alias("action")).groupBy(key).agg(F.max("action").alias("action"))
    rows = staged.join(wanted, key, "left")
    rows = rows.withColumn("action", F.when(F.col("action").isin(*ACTIONS), F.col("action")).otherwise("skip")).withColumn("_place", F.struct(*order))
    first_quit = rows.where("action = 'quit'").agg(F.min("_place").alias("_quit"))
    rows = rows.join(F.broadcast(first_quit))  # one row
    return rows.withColumn("action", F.when(F.col("_quit").isNull() | (F.col("_place") < F.col("_quit")), F.col("action"))).select(*staged.columns, "action")


def review(staged: DataFrame, decisions: DataFrame, key: str, order: list[Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records to submit, records that stay in staging, one row with the numbers approved, rejected and skipped). Rejected ones go; what comes after a quit isn't reviewed."""
    rows = decided(staged, decisions, key, order)
    stays = rows.where(F.col("action").isNull() | (F.col("action") == "skip"))
    n = lambda action: F.coalesce(F.sum((F.col("action") == action).cast("bigint")), F.lit(0)).alias
    counts = rows.agg(n("approve")("approved"), n("reject")("rejected"), n("skip")("skipped"))
    return rows.where("action = 'approve'").drop("action"), stays.drop("action"), counts
