"""Writers: partitioned tables, JSON results, append logs and parameter tables."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F


def write_readings(df: DataFrame, path: str, by: tuple[str, ...] = ("SOURCE", "TRANSFORMER_CODE"), rows_per_file: int = 5_000_000) -> None:
    """Readings partitioned by source and transformer.

    Adaptive execution balances the partitions it is dealt to: a transformer with most
    of the rows is written by as many tasks as its size asks for, small ones share one.
    """
    df.hint("rebalance", *by).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(*by).parquet(path)


def split_by_source(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col("SOURCE") == "REAL"), df.where(F.col("SOURCE") == "SYNTHETIC")


def union_sources(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document per row."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append-only JSON lines with the time of writing."""
    df.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(path)


def write_parameters(df: DataFrame, path: str) -> None:
    df.hint("rebalance").write.mode("overwrite").parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
