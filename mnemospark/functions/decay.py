"""Decay, reinforcement and validity of confidences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemospark.functions import lexicon as L


def days_between(earlier: Column, later: Column) -> Column:
    """Elapsed days, 0 where `later` is before `earlier`; null where one is null."""
    return F.greatest(F.lit(0.0), (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 8.64e10)


def decayed(confidence: Column, days: Column, rate: Column | float = 0.005) -> Column:
    r = rate if isinstance(rate, Column) else F.lit(rate)
    return confidence * F.exp(-r * days)


def reinforced(confidence: Column, times: Column) -> Column:
    """c + 0.2 (1 - c), `times` times over."""
    return F.least(F.lit(1.0), F.lit(1.0) - (F.lit(1.0) - confidence) * F.pow(F.lit(0.8), times))


def superseded(confidence: Column) -> Column:
    return F.greatest(F.lit(0.01), confidence * 0.3)


def decay_tier(predicate: Column, subject_type: Column, object_type: Column) -> Column:
    """By predicate, else by the subject's type, else by the object's, else project."""

    def by(c: Column, table: dict[str, list[str]]) -> Column:
        out = F.lit(None).cast("string")
        for tier, values in table.items():
            out = F.when(c.isin(values), tier).otherwise(out)
        return out

    return F.coalesce(by(predicate, L.PREDICATE_TIERS), by(subject_type, L.TYPE_TIERS), by(object_type, L.TYPE_TIERS), F.lit("project"))


def tier_rate(tier: Column) -> Column:
    out = F.lit(L.TIER_RATES["project"])
    for name, rate in L.TIER_RATES.items():
        out = F.when(tier == name, rate).otherwise(out)
    return out
