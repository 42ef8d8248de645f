"""Everything about a site in one table: consumption, bills, generation, transformer, finance."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridlight.functions.tariff import export_tariff
from gridlight.operators import finance as FI, rollup as RU, solar as SO, suitability as SU
from gridlight.plans import consumption as CO


def analyse(requests: DataFrame, readings: DataFrame, yields: DataFrame, radius: float | str = "search_radius_m", max_radius_m: float = 5000.0) -> DataFrame:
    """One row per accepted user.

    ``yields`` has the kWh per kW of every calendar month (``MONTH``, ``Efficiency``).
    All parts are keyed by user, so the assembly is four joins on the same key.
    """
    forecast = CO.cut_lineage(CO.forecast(requests, readings))
    annual = CO.annual(CO.bills(forecast, requests)).select("user_id", "total_consumption_kwh", "total_bill_lkr")
    sized = annual.withColumn("size_kw", FI.recommended_size(F.col("total_consumption_kwh")))
    # twelve yields a year: their sum is one number
    per_kw = yields.agg(F.sum(F.greatest("Efficiency", F.lit(0.0)))).scalar()
    sized = CO.cut_lineage(sized.withColumn("annual_generation_kwh", per_kw * F.col("size_kw")))
    sites = requests.join(sized.select("user_id", F.col("size_kw").alias("solar_kw")), "user_id")
    transformers = CO.cut_lineage(RU.transformer_features(RU.transformer_rollup(readings)))
    best = SU.assess(sites, transformers, radius, max_radius_m, k=1).select("user_id", "TRANSFORMER_CODE", F.col("distance_m"), F.col("score"), "label", "recommended_kw")
    systems = sized.select(F.col("user_id").alias("system_id"), "size_kw", "annual_generation_kwh", F.col("total_consumption_kwh").alias("annual_consumption_kwh"))
    money = FI.payback_summary(FI.yearly_cash_flow(systems)).select(F.col("system_id").alias("user_id"), "investment_lkr", "payback_years", "npv_lkr", "annual_roi_pct", "recommendation")
    out = sized.join(money, "user_id").join(best, "user_id", "left")
    return out.withColumn("export_tariff_lkr", export_tariff(F.col("size_kw")))
