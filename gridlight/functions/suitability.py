"""Transformer headroom analysis and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gridlight import constants as C
from gridlight.functions.numeric import clip


def headroom_analysis(capacity: Column, load: Column, existing_solar: Column, request_kw: Column) -> dict[str, Column]:
    before = load + existing_solar
    available = capacity - before
    after = before + request_kw
    return {"total_before_kw": before, "available_headroom_kw": available,
            "safe_headroom_kw": capacity * C.SAFETY_MARGIN - before, "total_after_kw": after,
            "can_support": available >= request_kw,
            "curtailment_risk": after / capacity > C.CURTAILMENT_LIMIT,
            "utilization_before": before / capacity, "utilization_after": after / capacity,
            "headroom_margin_pct": clip((available - request_kw) / capacity * 100, 0.0)}


def headroom_score(safe: Column, available: Column, request_kw: Column) -> Column:
    need = F.greatest(request_kw, F.lit(0.001))
    return (F.when(safe / need >= 1.5, 100.0).when(safe / need >= 1.0, 80.0)
            .when(available / need >= 1.0, 50.0).otherwise(0.0))


def distance_score(distance_m: Column) -> Column:
    return 100 * F.exp(-distance_m / 1000)


def stability_score(utilization_after: Column) -> Column:
    return (F.when(utilization_after <= 0.70, 100.0).when(utilization_after <= 0.85, 75.0)
            .when(utilization_after <= 0.95, 40.0).otherwise(0.0))


def rule_score(headroom: Column, distance: Column, stability: Column) -> Column:
    w = C.SUITABILITY_WEIGHTS
    return headroom * w["headroom"] + distance * w["distance"] + stability * w["stability"]


def blended_score(rule: Column, model: Column) -> Column:
    return rule * C.RULE_SHARE + model * C.MODEL_SHARE


def suitability_label(score: Column) -> Column:
    return (F.when(score >= 80, "IDEAL").when(score >= 60, "GOOD").when(score >= 40, "FAIR").otherwise("POOR"))


def recommendation(score: Column, available: Column, after: Column, curtailment: Column, request_kw: Column) -> Column:
    return (F.when(score >= 80, F.format_string(
                "Highly suitable. Transformer has %.1f kW of available headroom. "
                "Proceed with grid connection.", available))
            .when(score >= 60, F.format_string(
                "Conditionally suitable. Post-connection utilisation will be %.1f%%. "
                "Review with your utility provider.", after * 100))
            .when((score >= 40) & curtailment, F.lit(
                "Fair option but curtailment risk is elevated. Consider scheduling generation during "
                "off-peak hours or choosing an alternative transformer."))
            .when(score >= 40, F.lit(
                "Marginal suitability due to limited headroom. "
                "An upgrade assessment is recommended before connecting."))
            .otherwise(F.format_string(
                "Not suitable. Only %.1f kW headroom available against %.1f kW requested. "
                "Select a different transformer.", available, request_kw)))


def capacity_tier(score: Column, headroom: Column, tiers: list[float] = C.CAPACITY_TIERS) -> Column:
    """Largest tier within the safe headroom, null below a score of 60."""
    fits = F.filter(F.array(*[F.lit(float(t)) for t in tiers]), lambda t: t <= headroom * C.SAFETY_MARGIN)
    return F.when(score >= 60, F.array_max(fits))


def dashboard_scores(capacity: Column, headroom: Column, distance_m: Column, curtailment: Column) -> dict[str, Column]:
    return {"headroom_score": F.coalesce(F.least(F.lit(100.0), F.try_divide(headroom, F.nullif(capacity, F.lit(0.0))) * 100), F.lit(0.0)),
            "distance_score": F.when(distance_m <= 1000, F.greatest(F.lit(0.0), 100 - distance_m / 10)).otherwise(0.0),
            "stability_score": F.when(curtailment, 20.0).otherwise(80.0)}
