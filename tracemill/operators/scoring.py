"""Quality score of records. A design of this repository: five sub-scores in [0, 1], weights and tier limits are parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exports import tool_counts


@dataclass(frozen=True)
class Scoring:
    weights: dict[str, float] = field(default_factory=lambda: {"coherence": 0.25, "tool_validity": 0.2, "outcome_quality": 0.3, "information_density": 0.15, "metadata_completeness": 0.1})
    #: Least score of each tier, best first; below all is review_needed.
    limits: dict[str, float] = field(default_factory=lambda: {"gold": 0.78, "silver": 0.6, "bronze": 0.4})

    def sub_scores(self) -> dict[str, Column]:
        turns = F.col("trajectory.conversations")
        n = F.size(turns)
        alternate = F.size(F.filter(F.transform(turns, lambda t, i: (i == 0) | (t["from"] != F.get(turns, i - 1)["from"])), lambda x: x))
        calls = tool_counts(turns)
        words = F.aggregate(turns, F.lit(0), lambda a, t: a + F.size(F.filter(F.split(t["value"], r"\s+"), lambda w: w != "")))
        known = ["model.model_name", "model.quantization", "hardware.gpu_name", "outcome.task_category"]
        return {
            "coherence": F.when(n > 0, alternate / n).otherwise(0.0),
            "tool_validity": F.when(calls["total_tool_calls"] > 0, calls["successful_tool_calls"] / calls["total_tool_calls"]).otherwise(1.0),
            "outcome_quality": F.coalesce((F.col("outcome.user_rating") - 1) / 4.0, F.lit(0.5)),
            "information_density": F.least(F.lit(1.0), words / (F.greatest(n, F.lit(1)) * 40.0)),
            "metadata_completeness": sum((F.col(c).isNotNull().cast("int") for c in known[1:]), F.col(known[0]).isNotNull().cast("int")) / float(len(known)),
        }

    def score(self) -> Column:
        total = sum(self.weights.values())
        parts = [s * (self.weights[k] / total) for k, s in self.sub_scores().items()]
        return F.round(sum(parts[1:], parts[0]), 6)

    def tier(self, score: Column) -> Column:
        out = None
        for name, least in self.limits.items():
            out = F.when(score >= least, name) if out is None else out.when(score >= least, name)
        return out.otherwise("review_needed")

    def quality(self, scored_at: Column) -> Column:
        """The record's struct `quality`."""
        subs = F.create_map(*(x for k, s in self.sub_scores().items() for x in (F.lit(k), s)))
        return F.struct(self.tier(self.score()).alias("quality_tier"), self.score().alias("composite_score"), subs.alias("sub_scores"), scored_at.alias("scored_at"))
