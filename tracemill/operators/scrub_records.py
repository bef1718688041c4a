"""Redaction of all free text of records, in place: each record's texts are a column of lists that the steps go over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import CATEGORIES
from ..functions.scrub import org_domains, scrub_lists

TEXTS = "array<array<string>>"


def texts() -> Column:
    """All free text of a record: for each turn its value and then the input and output of each tool call, and at last the pain points' descriptions and the comment."""
    turn = lambda t: F.concat(F.array(t["value"]), F.coalesce(F.flatten(F.transform(t["tool_calls"], lambda c: F.array(c["tool_input"], c["tool_output"]))), F.array().cast("array<string>")))
    turns = F.coalesce(F.transform("trajectory.conversations", turn), F.array().cast(TEXTS))
    rest = F.concat(F.coalesce(F.transform("pain_points", lambda p: p["description"]), F.array().cast("array<string>")), F.array(F.col("outcome.user_comment")))
    return F.concat(turns, F.array(rest))


def scrub_records(records: DataFrame) -> DataFrame:
    """Records with redacted text and submission.scrub_log filled; items_flagged counts organisations' domains in the redacted text.

    Rows stay where they are: no key takes part, so records without one, or with one that repeats, are redacted like all
    others. A text is written back only as the steps left it; a record without texts has a log of zeros, and one
    without submission gets none.
    """
    clean = scrub_lists(records.withColumn("_texts", texts()), "_texts")
    flagged = F.aggregate(F.flatten("_texts"), F.lit(0), lambda n, x: n + F.coalesce(F.size(org_domains(x)), F.lit(0)))
    at = lambda i, k: F.get(F.get(F.col("_texts"), i), k)
    turns = F.transform(
        "trajectory.conversations",
        lambda t, i: t.withField("value", at(i, F.lit(0))).withField("tool_calls", F.transform(t["tool_calls"], lambda c, j: c.withField("tool_input", at(i, 2 * j + 1)).withField("tool_output", at(i, 2 * j + 2)))),
    )
    rest = F.element_at("_texts", -1)
    log = F.struct(*(F.col(f"{c}_redacted").alias(f"{c}_redacted") for c in CATEGORIES), F.lit(0).alias("potential_names_redacted"), flagged.cast("int").alias("items_flagged"))
    return clean.withColumns(
        {
            "trajectory": F.when(F.col("trajectory").isNotNull(), F.col("trajectory").withField("conversations", turns)),
            "pain_points": F.transform("pain_points", lambda p, i: p.withField("description", F.get(rest, i))),
            "outcome": F.when(F.col("outcome").isNotNull(), F.col("outcome").withField("user_comment", F.element_at(rest, -1))),
            "submission": F.when(F.col("submission").isNotNull(), F.col("submission").withField("scrub_log", log)),
        }
    ).select(*records.columns)
