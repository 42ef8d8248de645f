"""Transformers within reach of a site, scored and ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridlight.functions import suitability as S
from gridlight.functions.geo import haversine_m
from gridlight.operators.spatial import radius_join, top_k


def score_transformers(pairs: DataFrame, request_kw: str = "solar_kw", model_score: str | None = None) -> DataFrame:
    """Headroom, distance, stability and blended scores of (site, transformer) pairs.

    Without a model score the blend takes 50, the value of an undecided classifier.
    """
    kw = F.col(request_kw)
    h = S.headroom_analysis(F.col("ESTIMATED_CAPACITY_kW"), F.col("current_load_kW"), F.col("total_solar_capacity"), kw)
    df = pairs.withColumns(h)
    df = df.withColumns({"headroom_score": S.headroom_score(F.col("safe_headroom_kw"), F.col("available_headroom_kw"), kw),
                         "distance_score": S.distance_score(F.col("distance_m")),
                         "stability_score": S.stability_score(F.col("utilization_after"))})
    df = df.withColumn("rule_score", S.rule_score(F.col("headroom_score"), F.col("distance_score"), F.col("stability_score")))
    model = F.col(model_score) if model_score else F.lit(50.0)
    df = df.withColumn("score", S.blended_score(F.col("rule_score"), model))
    return df.withColumns({
        "label": S.suitability_label(F.col("score")),
        "recommended_kw": S.capacity_tier(F.col("score"), F.col("available_headroom_kw")),
        "recommendation": S.recommendation(F.col("score"), F.col("available_headroom_kw"), F.col("utilization_after"),
                                           F.col("curtailment_risk"), kw)})


def assess(sites: DataFrame, transformers: DataFrame, radius: float | str = "search_radius_m", max_radius_m: float = 5000.0,
           k: int = 5, request_kw: str = "solar_kw", model_score: str | None = None, distance=haversine_m) -> DataFrame:
    """The ``k`` best transformers of every site; ties go to the nearer, then to the code."""
    pairs = radius_join(sites, transformers, radius, point_id="user_id", target_id="TRANSFORMER_CODE",
                        max_radius_m=max_radius_m, distance=distance)
    scored = score_transformers(pairs, request_kw, model_score)
    return top_k(scored, ["user_id"], [F.round("score", 6).desc(), F.round("distance_m", 3), F.col("TRANSFORMER_CODE")], k)
