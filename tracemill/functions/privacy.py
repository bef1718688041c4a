"""Hardware generalization, timestamp jitter, consent levels and tier thresholds as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import GPU_FAMILIES, JITTER_SECONDS, MEMORY_TIERS, OTHER_GPU, REDACTED_CONTENT, TIER_RANKS
from .text import canonical_turns


def gpu_family(name: Column) -> Column:
    out = F.when(name.isNull(), F.lit(None).cast("string"))
    for pattern, family in GPU_FAMILIES:
        out = out.when(name.rlike(f"(?iU){pattern}"), family)
    return out.otherwise(OTHER_GPU)


def memory_tier(gb: Column) -> Column:
    """The smallest tier that holds the value; the largest tier for more, the smallest for none or less."""
    out = F.when(gb.isNull(), F.lit(None).cast("int")).when(gb <= 0, MEMORY_TIERS[0])
    for tier in MEMORY_TIERS:
        out = out.when(gb <= tier, tier)
    return out.otherwise(MEMORY_TIERS[-1])


def os_family(name: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(low.contains("darwin") | low.contains("mac"), "macos")
        .when(low.contains("linux"), "linux")
        .when(low.contains("win"), "windows")
        .otherwise(name)
    )


def anonymize_hardware(hardware: Column) -> Column:
    """Generalized names and sizes, no CUDA version; no hardware stays none."""
    changed = hardware.withField("gpu_name", gpu_family(hardware["gpu_name"])).withField("gpu_vram_gb", memory_tier(hardware["gpu_vram_gb"]))
    changed = changed.withField("ram_gb", memory_tier(hardware["ram_gb"])).withField("os", os_family(hardware["os"])).withField("cuda_version", F.lit(None).cast("string"))
    return F.when(hardware.isNotNull(), changed)


def jitter_seconds(turns: Column) -> Column:
    """An offset within JITTER_SECONDS either way that follows from the turns alone."""
    digits = F.conv(F.left(F.sha2(canonical_turns(turns), 256), F.lit(15)), 16, 10).cast("long")
    return (F.pmod(digits, F.lit(2 * JITTER_SECONDS + 1)) - JITTER_SECONDS).cast("int")


def jitter(created_at: Column, turns: Column) -> Column:
    return F.timestamp_add("SECOND", jitter_seconds(turns), created_at)


def tier_rank(tier: Column) -> Column:
    out = F.when(tier.isNull(), 0)
    for name, rank in TIER_RANKS.items():
        out = out.when(tier == name, rank)
    return out.otherwise(0)


def meets_tier(tier: Column, least: Column) -> Column:
    return tier_rank(tier) >= tier_rank(least)


def redacted_turns(turns: Column) -> Column:
    """Turns with all text replaced; who spoke, and which tools were called, stays."""
    text = F.lit(REDACTED_CONTENT)
    return F.transform(
        turns,
        lambda t: t.withField("value", text).withField("tool_calls", F.transform(t["tool_calls"], lambda c: c.withField("tool_input", text).withField("tool_output", text))),
    )
