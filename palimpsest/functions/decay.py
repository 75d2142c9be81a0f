"""Time decay: ages in hours against an explicit reference time in microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR = 3_600_000_000.0

# Shape k and scale eta (hours) by memory type.
WEIBULL = {
    "profile": (0.3, 8760.0), "preference": (0.4, 4380.0), "relationship": (0.35, 8760.0), "learning": (0.7, 1440.0), "fact": (0.8, 720.0), "entity": (0.5, 4380.0), "setup": (0.6, 2160.0),
    "pattern": (0.6, 1680.0), "context": (0.85, 360.0), "observation": (0.9, 480.0), "artifact": (0.75, 2160.0), "project": (0.85, 1080.0), "goal": (0.9, 720.0), "decision": (1.0, 336.0),
    "commitment": (1.0, 240.0), "event": (1.2, 168.0), "instruction": (0.9, 480.0), "error": (1.1, 336.0), "issue": (1.1, 336.0), "request": (1.5, 72.0), "general": (1.0, 168.0),
}
VERACITY_WEIGHT = {"stated": 1.0, "unknown": 0.8, "inferred": 0.7, "imported": 0.6, "tool": 0.5}
TIER_WEIGHT = {1: 1.0, 2: 0.5, 3: 0.25}


def age_hours(us: Column, ref_us: int) -> Column:
    return (F.lit(ref_us) - us) / F.lit(HOUR)


def recency(us: Column, ref_us: int, scale_hours: float = 168.0) -> Column:
    """exp(-age / scale); future rows exceed 1, a missing time gives 0.5."""
    return F.coalesce(F.exp(-age_hours(us, ref_us) / scale_hours), F.lit(0.5))


def temporal_boost(us: Column, at_us: int, scale_hours: float = 24.0) -> Column:
    """exp(-age / scale) with future rows clamped to 1, a missing time gives 0."""
    scale = scale_hours if scale_hours and scale_hours > 0 and scale_hours != float("inf") else 24.0
    # greatest() skips nulls, so a missing time is tested first.
    return F.when(us.isNull(), 0.0).otherwise(F.exp(-F.greatest(F.lit(0.0), age_hours(us, at_us)) / scale))


def lookup(table: dict, key: Column, default) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def weibull(us: Column, ref_us: int, memory_type: Column) -> Column:
    """exp(-(age / eta) ** k) by type (an unknown type is general); ages below zero count as zero, a missing time gives 0.5."""
    k = lookup({t: p[0] for t, p in WEIBULL.items()}, memory_type, 1.0)
    eta = lookup({t: p[1] for t, p in WEIBULL.items()}, memory_type, 168.0)
    return F.when(us.isNull(), 0.5).otherwise(F.exp(-F.pow(F.greatest(F.lit(0.0), age_hours(us, ref_us)) / eta, k)))


def veracity_weight(veracity: Column) -> Column:
    return lookup(VERACITY_WEIGHT, F.lower(F.trim(veracity)), 0.8)


def clamp_veracity(raw: Column) -> Column:
    low = F.lower(F.trim(raw))
    return F.when(low.isin(list(VERACITY_WEIGHT)), low).otherwise("unknown")
