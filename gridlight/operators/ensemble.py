"""Weighted combination of forecasts.

Forecasters are plain functions that return (user_id, month, kwh, confidence);
registering one means adding its rows, tagged with a method name, and a weight.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from gridlight import constants as C
from gridlight.functions import numeric as N


def stack_forecasts(methods: dict[str, DataFrame]) -> DataFrame:
    parts = [df.select("user_id", F.lit(name).alias("method"), "month", "kwh", "confidence") for name, df in methods.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def combine(forecasts: DataFrame, users: DataFrame, weights: dict[str, float] = C.ENSEMBLE_WEIGHTS, default_weight: float = 0.5) -> DataFrame:
    """Confidence-weighted mean per month, rescaled to the level of the user's own months."""
    w_user = Window.partitionBy("user_id")
    method_conf = F.avg("confidence").over(Window.partitionBy("user_id", "method"))
    weight = F.coalesce(N.lookup(F.col("method"), weights), F.lit(default_weight))
    rows = forecasts.withColumn("w", weight * method_conf)
    months = rows.groupBy("user_id", "month").agg(
        (F.sum(F.col("kwh") * F.col("w")) / F.sum("w")).alias("kwh"), F.avg("confidence").alias("confidence"),
        F.min("kwh").alias("lower"), F.max("kwh").alias("upper"), F.stddev_pop("kwh").alias("std"),
        F.percentile("kwh", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.count(F.lit(1)).cast("int").alias("n_methods"))
    own = users.select("user_id", N.array_mean(F.transform(F.map_values("consumption_months"), lambda v: v.cast("double"))).alias("user_avg"))
    df = months.join(own, "user_id", "left").withColumn("model_avg", F.avg("kwh").over(w_user))
    scale = F.when((F.col("model_avg") > 0) & (F.col("user_avg") > 0), F.try_divide(F.col("user_avg"), F.col("model_avg"))).otherwise(1.0)
    single = F.col("n_methods") == 1
    v = F.col("kwh")
    return df.select("user_id", "month", (v * scale).alias("kwh"), "confidence",
                     F.when(single, v * 0.8).otherwise(F.col("lower")).alias("lower_bound"),
                     F.when(single, v * 1.2).otherwise(F.col("upper")).alias("upper_bound"),
                     F.when(single, v * 0.2).otherwise(F.col("std")).alias("std_dev"),
                     F.when(single, v * 0.9).otherwise(F.get("q", 0)).alias("q25"),
                     F.when(single, v * 1.1).otherwise(F.get("q", 1)).alias("q75"), "n_methods")


def month_confidence(combined: DataFrame) -> DataFrame:
    """Confidence falling off with the distance from the peak month."""
    w = Window.partitionBy("user_id")
    peak = F.max_by("month", F.struct(F.round("kwh", 6), -F.col("month"))).over(w)
    overall = F.avg("confidence").over(w)
    return combined.withColumn("month_confidence", overall * (1 - 0.1 * F.abs(F.col("month") - peak) / 6))


def ensemble_statistics(combined: DataFrame) -> DataFrame:
    """Annual figures with the trend taken from the mean month-to-month change (five kWh)."""
    v, m = F.col("kwh"), F.col("month")
    change = (F.max_by(v, m) - F.min_by(v, m)) / 11
    mean, std = F.avg(v), F.stddev_pop(v)
    return combined.groupBy("user_id").agg(
        F.sum(v).alias("annual_total"), mean.alias("annual_average"), F.max_by("month", F.struct(F.round(v, 6), -m)).alias("peak_month"),
        F.min_by("month", F.struct(F.round(v, 6), m)).alias("low_month"), std.alias("monthly_variability"),
        F.when(mean > 0, F.try_divide(std, mean)).otherwise(0.0).alias("seasonality_index"),
        F.when(change > 5, "increasing").when(change < -5, "decreasing").otherwise("stable").alias("trend"))


def adapt_weights(history: DataFrame, weights: dict[str, float], key: str, window: int = 3) -> DataFrame:
    """Weights of every key after all its errors; ``history`` has (key, run, method, mape).

    From the ``window``-th error of a method on, each new one moves this method's weight towards the inverse of its mean
    recent error and scales the others, starting from the weights the error before has left.
    """
    names = list(weights)
    w = Window.partitionBy(key, "method").orderBy("run").rowsBetween(-(window - 1), 0)
    rows = history.where(F.col("method").isin(names)).withColumns({"_recent": F.avg("mape").over(w), "_n": F.count(F.lit(1)).over(w)}).where(F.col("_n") >= window)
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("method")).cast("int")
    steps = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("run", place.alias("i"), F.col("_recent").alias("e")))).alias("steps"))

    def step(held: Column, e: Column) -> Column:
        others = F.aggregate(held, F.lit(0.0), lambda a, x: a + x) - F.element_at(held, e["i"])
        base = F.when(e["e"] > 0, 1.0 / e["e"]).otherwise(1.0)
        own = base / (base + others)
        return F.transform(held, lambda v, k: F.when(k == e["i"] - 1, own).otherwise(F.when(others > 0, v * (1 - own) / others).otherwise(0.0)))

    held = F.aggregate("steps", F.array(*[F.lit(float(v)) for v in weights.values()]), step)
    return steps.select(key, F.posexplode(held).alias("_i", "weight")).select(key, F.get(F.array(*[F.lit(n) for n in names]), F.col("_i")).alias("method"), "weight")
