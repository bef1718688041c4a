"""Connected components by repeated contraction, with DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges(a long, b long) -> (node, component), component = the smallest node reachable.

    In each round every node points at its smallest neighbour or itself, pointers are jumped twice, and edges are
    rewritten by them; loops and repeats go. The rounds grow with the logarithm of the longest path. Hubs are
    pre-aggregated by min() before their rows move. No edges give no rows; null ends are ignored.
    """
    live = scratch.save(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps = []
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("to")), "point")
        for _ in range(2):
            far = point.select(F.col("node").alias("to"), F.col("to").alias("far")).where("to <> far")
            point = point.join(far, "to", "left").select("node", F.coalesce("far", "to").alias("to"))
        point = scratch.save(point, "jump")
        maps.append(point)
        ends = [point.select(F.col("node").alias(x), F.col("to").alias(f"to_{x}")) for x in "ab"]
        live = scratch.save(
            live.join(ends[0], "a").join(ends[1], "b").where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(),
            "edges",
        )
    if not maps:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = maps[0].select("node", F.col("to").alias("component"))
    for later in maps[1:]:
        later = later.select(F.col("node").alias("component"), "to")
        out = out.join(later, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return scratch.save(out, "components")
