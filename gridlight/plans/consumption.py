"""Requests to forecasts and bills for all users in one run."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridlight.operators import billing as BL, clean as CL, ensemble as EN, pattern as PA, rollup as RU, similarity as SI
from gridlight.session import cut_lineage


def similar_households(requests: DataFrame, readings: DataFrame) -> DataFrame:
    """Checkpointed top similar households: the costly pair join is used by several later steps."""
    profiles = RU.customer_profiles(CL.plausible_range(CL.within_bounds(readings)))
    return cut_lineage(SI.similar_households(requests, profiles))


def forecast(requests: DataFrame, readings: DataFrame, more: dict[str, DataFrame] | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """Monthly forecast per user: the pattern, combined with further forecasters if given."""
    accepted, _ = CL.split_requests(CL.validate_requests(requests))
    similar = similar_households(accepted, readings)
    pattern = PA.pattern_forecast(PA.user_patterns(accepted, similar))
    stacked = EN.stack_forecasts({"pattern": pattern, **(more or {})})
    return EN.combine(stacked, accepted, weights or {"pattern": 0.5, "lstm": 0.5})


def bills(forecasts: DataFrame, requests: DataFrame) -> DataFrame:
    """Monthly bills of the forecast months."""
    rows = forecasts.join(requests.select("user_id", "tariff"), "user_id")
    return BL.monthly_bills(rows, "kwh", "tariff")


def annual(bill_rows: DataFrame) -> DataFrame:
    return BL.annual_bills(bill_rows, ["user_id"], "kwh")


def rejected(requests: DataFrame) -> DataFrame:
    return CL.split_requests(CL.validate_requests(requests))[1].select("user_id", "errors")


def outcome_counts(requests: DataFrame) -> DataFrame:
    ok = F.size("errors") == 0
    return CL.validate_requests(requests).agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"))
