"""Transformer assessment: roll-up, classifier, risk tiers, trend, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridlight.operators import ml, rollup as RU, suitability as SU
from gridlight.session import cut_lineage


def transformer_table(readings: DataFrame) -> DataFrame:
    """Features, model score, risk tier and future load of every transformer."""
    features = cut_lineage(RU.transformer_features(RU.transformer_rollup(readings)))
    labelled = ml.suitability_labels(features)
    scored = ml.suitability_scores(ml.fit_suitability(labelled), labelled)
    tiers = ml.risk_tiers(features).select("TRANSFORMER_CODE", "cluster", "risk_tier")
    trend = ml.load_trend(readings).select("TRANSFORMER_CODE", "future_load_kW")
    return cut_lineage(scored.join(tiers, "TRANSFORMER_CODE").join(trend, "TRANSFORMER_CODE", "left"))


def assess_sites(sites: DataFrame, table: DataFrame, radius: float | str = "search_radius_m", max_radius_m: float = 5000.0, k: int = 5) -> DataFrame:
    return SU.assess(sites, table, radius, max_radius_m, k, model_score="ml_score")
