"""Priority and risk: severity weights, fused score, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threatlake.constants import (
    ALERT_LABELS, FAMILY_SEVERITY, FLAGGED_RISK, FUSION_WEIGHTS, PRIORITY_THRESHOLDS, RISK_THRESHOLDS, SEVERITY_WEIGHT,
)
from threatlake.functions.numbers import floor_ladder, lookup


def family_severity(family: Column) -> Column:
    return F.coalesce(lookup(family, FAMILY_SEVERITY), F.lit("info"))


def severity_weight(severity: Column) -> Column:
    return F.coalesce(lookup(severity, SEVERITY_WEIGHT), F.lit(0.0))


def supervised_score(first: Column, second: Column) -> Column:
    return F.greatest(first, second)


def priority_score(
    first: Column, second: Column, anomaly: Column, weight: Column,
    weights: dict[str, float] | None = None, certainty_bonus: bool = False,
) -> Column:
    """Weighted sum clipped to [0, 1]; the bonus for two very sure models is off by default."""
    w = {**FUSION_WEIGHTS, **(weights or {})}
    total = w["supervised"] * supervised_score(first, second) + w["anomaly"] * anomaly + w["severity"] * weight
    if certainty_bonus:
        total = total + F.when(F.least(first, second) > 0.95, 0.10).otherwise(0.0)
    return F.greatest(F.least(total, F.lit(1.0)), F.lit(0.0))


def priority_label(score: Column) -> Column:
    return floor_ladder(score, PRIORITY_THRESHOLDS, "info")


def priority_rank(label: Column) -> Column:
    """1 for critical down to 5 for info."""
    order = {name: place for place, (_, name) in enumerate(PRIORITY_THRESHOLDS, 1)}
    return lookup(label, order)


def risk_label(score: Column) -> Column:
    return floor_ladder(score, RISK_THRESHOLDS, "baseline")


def is_alert(label: Column) -> Column:
    return label.isin(*ALERT_LABELS)


def is_flagged(label: Column) -> Column:
    return label.isin(*FLAGGED_RISK)
