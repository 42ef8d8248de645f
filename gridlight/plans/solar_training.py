"""Readings and weather to the solar training table, its split and its models."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridlight import constants as C
from gridlight.operators import clean as CL, ml, rollup as RU, solar as SO, splits as SP
from gridlight.session import cut_lineage


def training_table(readings: DataFrame, weather: DataFrame, history: DataFrame, start_year: int, end_year: int) -> DataFrame:
    """Solar readings with imputed weather, features and target, residential systems only."""
    w = CL.impute_irradiance(CL.sentinels_to_null(weather), history, start_year, end_year)
    df = SO.solar_features(SO.join_weather(readings.where(F.col("HAS_SOLAR") == 1), w))
    df = CL.residential_only(df).withColumnRenamed("MONTH", "Month")
    keep = ["account_id", "YEAR", "EXPORT_kWh", "Efficiency", "Clear_Sky_GHI", *C.SOLAR_MODEL_FEATURES]
    return df.select(*keep).dropna(subset=["Efficiency", *C.SOLAR_MODEL_FEATURES])


def split_and_clean(table: DataFrame, test_share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Group-safe split; outliers are removed from the train rows only, with bounds fitted on them."""
    parts = cut_lineage(SP.group_split(table, test_share))
    train = parts.where("split = 'train'")
    bounds = RU.month_iqr_bounds(train, "EXPORT_kWh", month="Month")
    return RU.drop_month_outliers(train, bounds, "EXPORT_kWh", "Month"), parts.where("split = 'test'")


def train(train_rows: DataFrame, test_rows: DataFrame, models: dict | None = None, folds: int = 5) -> tuple[dict, DataFrame]:
    """Tuned models and the comparison table."""
    found = ml.grid_search(train_rows, C.SOLAR_MODEL_FEATURES, "Efficiency", models or ml.regressors("Efficiency"), folds)
    table = ml.evaluate_models({k: m for k, (m, _) in found.items()}, test_rows, "Efficiency", {k: e for k, (_, e) in found.items()})
    return {k: m for k, (m, _) in found.items()}, ml.comparison_table(table)
