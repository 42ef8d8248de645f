"""Consumption pattern of a user's similar households and the twelve-month forecast from it.

From the top-k step on every row set is keyed by user and small per user (at
most ten households by twelve months).  The statistics of the points come from
arrays, many users at a time; the steps after them run on one partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from gridlight import constants as C
from gridlight.functions import calendar as CAL, numeric as N
from gridlight.operators.series import smooth_circular
from gridlight.operators.skew import shuffle_tasks

MIN_POINTS = 3


def pattern_points(similar: DataFrame) -> DataFrame:
    """One row per user: of every similar household its score and its value of each month, null after the user's last month and for outliers."""
    kept = lambda v, i: (i < F.col("last_user_month")) & v.between(C.MIN_NET_KWH, C.MAX_NET_KWH) & v.between(0.3 * F.col("household_median"), 3.0 * F.col("household_median"))
    values = F.transform("net_by_month", lambda v, i: F.when(kept(v, i), v))
    return similar.select("user_id", "score", values.alias("values")).groupBy("user_id").agg(
        F.collect_list(F.struct("score", "values")).alias("points"), F.avg("score").alias("avg_similarity"), F.count(F.lit(1)).cast("int").alias("n_similar"))


def points_statistics(points: pa.ListArray) -> dict[str, np.ndarray]:
    """Of every user and month the number of points, their weighted median and their quantiles, which lie between two as in ``percentile``."""
    flat = points.flatten()
    score = flat.field("score").to_numpy(zero_copy_only=False)
    values = pc.list_flatten(flat.field("values")).to_numpy(zero_copy_only=False).astype(float).reshape(-1, 12)
    size = pc.list_value_length(points).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)
    v, w = np.full((len(size), max(1, size.max(initial=0)), 12), np.nan), np.zeros((len(size), max(1, size.max(initial=0)), 1))
    v[rows, place], w[rows, place, 0] = values, score / np.bincount(rows, score, len(size))[rows]
    order = np.argsort(v, axis=1, kind="stable")    # what is missing comes last
    v = np.take_along_axis(v, order, 1)
    w = np.where(np.isnan(v), 0.0, np.take_along_axis(np.broadcast_to(w, v.shape), order, 1))
    n, upto = (~np.isnan(v)).sum(1), np.cumsum(w, 1)
    reached = ~np.isnan(v) & (np.isnan(upto) | (upto >= upto[:, -1:] / 2 - 1e-12))
    median = np.where(reached, v, np.inf).min(1)

    def quantile(p: float) -> np.ndarray:
        at = p * (n - 1.0)
        lower, higher = np.floor(at), np.ceil(at)
        low, high = (np.take_along_axis(v, np.maximum(x, 0).astype(int)[:, None, :], 1)[:, 0] for x in (lower, higher))
        return np.where(low == high, low, (higher - at) * low + (at - lower) * high)

    return {"n": n, "median": median, "iqr": quantile(0.75) - quantile(0.25), "p10": quantile(0.10), "p90": quantile(0.90)}


def _statistics(points: DataFrame) -> DataFrame:
    """``points`` with ``known``, twelve entries of statistics, instead of the points; a user's row holds few numbers, so users are taken many at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = points_statistics(batch.column("points"))
            entries = pa.StructArray.from_arrays([pa.array(x.reshape(-1).astype("int32" if name == "n" else float)) for name, x in found.items()], list(found))
            known = pa.ListArray.from_arrays(pa.array(np.arange(0, 12 * len(batch) + 1, 12, dtype="int32")), entries)
            kept = [c for c in batch.schema.names if c != "points"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], known], names=[*kept, "known"])

    entry = StructType([StructField("n", IntegerType()), *[StructField(c, DoubleType()) for c in ("median", "iqr", "p10", "p90")]])
    out = StructType([*[f for f in points.schema.fields if f.name != "points"], StructField("known", ArrayType(entry))])
    # a row a user is sent on, so that the months need not be
    return points.mapInArrow(run, out).repartition(shuffle_tasks(points), "user_id")


def month_statistics(points: DataFrame) -> DataFrame:
    """Weighted median, spread and bounds per user and month (at most ``k`` points each)."""
    rows = _statistics(points).select("user_id", F.posexplode("known").alias("_pos", "_k")).where(F.col("_k.n") > 0)
    return rows.select("user_id", (F.col("_pos") + 1).alias("month"), "_k.*")


def monthly_patterns(similar: DataFrame) -> DataFrame:
    """Twelve rows per user: weighted median, spread and 10/90 bounds; thin months take the seasonal default."""
    stats = _statistics(pattern_points(similar))
    grid = stats.select("user_id", "avg_similarity", "n_similar", F.posexplode("known").alias("_pos", "_k")).withColumn("month", F.col("_pos") + 1)
    k, n = F.col("_k"), F.col("_k.n")
    base = 350 * N.lookup(F.col("month"), C.FORECAST_SEASONAL)
    enough = n >= MIN_POINTS
    return grid.select("user_id", "month", "avg_similarity", "n_similar", n.alias("n_points"),
                       F.when(enough, k["median"]).otherwise(base).alias("median"),
                       F.when(enough, k["iqr"]).otherwise(base * 0.4).alias("iqr"),
                       F.when(enough, k["p10"]).otherwise(base * 0.6).alias("p10"),
                       F.when(enough, k["p90"]).otherwise(base * 1.4).alias("p90"))


def robust_pattern(similar: DataFrame) -> DataFrame:
    """Smoothed pattern with quality score and confidence on each of its twelve rows."""
    p = smooth_circular(monthly_patterns(similar), ["user_id"], "median")
    w = Window.partitionBy("user_id")
    annual = F.avg("median").over(w)
    s1 = F.sum(F.when(F.col("n_points") >= MIN_POINTS, 1).otherwise(0)).over(w) / 12.0
    iqr_mean = F.avg("iqr").over(w)
    s2 = F.when(annual > 0, F.greatest(F.lit(0.0), 1 - F.try_divide(iqr_mean, annual) / 0.5)).otherwise(0.5)
    s3 = F.greatest(F.lit(0.0), 1 - F.coalesce(F.try_divide(F.stddev_pop("iqr").over(w), iqr_mean), F.lit(0.0)) / 0.3)
    p = p.withColumns({"annual_average": annual, "total_points": F.sum("n_points").over(w),
                       "quality_score": N.clip(s1 * 0.6 + s2 * 0.2 + s3 * 0.2, 0.0, 1.0)})
    enough = F.least(F.lit(1.0), F.col("total_points") / 12.0 / 5)
    confidence = N.clip(F.col("avg_similarity") * 0.4 + F.col("quality_score") * 0.3 + enough * 0.3, 0.3, 0.95)
    return p.withColumn("confidence", confidence)


def adjustment_factor(user_median: Column, pattern_median: Column) -> Column:
    """Ratio of the user's to the pattern's level, clamped by the user's level."""
    raw = F.when(pattern_median > 0, F.try_divide(user_median, pattern_median)).otherwise(1.0)
    out = None
    for bound, lo, hi in C.ADJUSTMENT_LADDER[:-1]:
        value = N.clip(raw, lo, hi)
        out = F.when(user_median < bound, value) if out is None else out.when(user_median < bound, value)
    _, lo, hi = C.ADJUSTMENT_LADDER[-1]
    return out.otherwise(N.clip(raw, lo, hi))


def adjust_to_user(pattern: DataFrame, users: DataFrame) -> DataFrame:
    """Scale the pattern to the level of the user's own months."""
    own = users.select("user_id", "consumption_months")
    w = Window.partitionBy("user_id")
    df = pattern.join(own, "user_id")
    in_user = F.array_contains(F.map_keys("consumption_months"), F.col("month"))
    pattern_values = F.collect_list(F.when(in_user, F.col("median"))).over(w)
    factor = adjustment_factor(N.array_median(F.map_values("consumption_months")), N.array_median(pattern_values))
    df = df.withColumn("adjustment_factor", factor)
    df = df.withColumns({c: F.col(c) * F.col("adjustment_factor") for c in ("median", "iqr", "p10", "p90")})
    return df.withColumn("annual_average", F.avg("median").over(w)).drop("consumption_months")


def apply_season(pattern: DataFrame) -> DataFrame:
    """Blend with the seasonal template, lift April, lower a high July and August, smooth."""
    w = Window.partitionBy("user_id")
    m, annual = F.col("month"), F.col("annual_average")
    df = pattern.withColumn("median", F.col("median") * 0.7 + annual * N.lookup(m, C.FORECAST_SEASONAL) * 0.3)
    df = df.withColumns({"_peak": F.max("median").over(w),
                         "_peak_month": F.max_by("month", F.struct(F.col("median"), -m)).over(w)})
    v = F.col("median")
    boost = (m == 4) & (F.col("_peak_month") != 4) & (v < F.col("_peak") * 0.95)
    lower = m.isin(7, 8) & (v > annual * 1.1)
    df = df.withColumn("median", F.when(boost, F.col("_peak") * 1.05).when(lower, v * 0.9).otherwise(v)).drop("_peak", "_peak_month")
    return smooth_circular(df, ["user_id"], "median").withColumn("annual_average", F.avg("median").over(w))


def user_patterns(users: DataFrame, similar: DataFrame) -> DataFrame:
    """Adjusted, seasonal pattern of every user; the default pattern where nobody is similar."""
    p = apply_season(adjust_to_user(robust_pattern(similar), users))
    grid = users.select("user_id", "consumption_months", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    df = grid.join(p, ["user_id", "month"], "left")
    base = 350 * N.lookup(F.col("month"), C.FORECAST_SEASONAL)
    missing = {"median": base, "iqr": F.lit(80.0), "p10": base * 0.7, "p90": base * 1.3, "confidence": F.lit(0.3),
               "quality_score": F.lit(0.3), "n_points": F.lit(0), "n_similar": F.lit(0), "total_points": F.lit(0).cast("long"),
               "avg_similarity": F.lit(0.0), "adjustment_factor": F.lit(1.0)}
    return df.withColumns({c: F.coalesce(F.col(c), d) for c, d in missing.items()}).drop("annual_average")


def pattern_forecast(patterns: DataFrame, last_year: int | Column = 2025) -> DataFrame:
    """Twelve rows per user, starting after the last known month: value, bounds, confidence, labels."""
    m = F.col("month")
    known = F.map_keys("consumption_months")
    last = F.coalesce(F.array_max(known), F.lit(12))
    year0 = F.lit(last_year) if isinstance(last_year, int) else last_year
    step = F.pmod(m - last - 1, F.lit(12))
    year = year0 + F.floor((last + step) / 12).cast("int")
    nearest = F.array_min(F.transform(known, lambda k: CAL.circular_month_distance(m, k)))
    conf = (F.when(F.array_contains(known, m), 0.9)
            .when(F.size(known) > 0, F.col("confidence") * F.exp(-nearest / 6.0))
            .otherwise(F.col("confidence") * 0.7))
    mean = F.avg("median").over(Window.partitionBy("user_id"))
    return patterns.select(
        "user_id", (step + 1).alias("horizon"), year.alias("year"), "month", F.col("median").alias("kwh"),
        F.greatest(F.lit(0.0), F.col("median") - F.col("iqr")).alias("lower_kwh"), (F.col("median") + F.col("iqr")).alias("upper_kwh"),
        conf.alias("confidence"), CAL.season(m).alias("season"), m.isin(C.HOLIDAY_MONTHS).alias("is_holiday_month"),
        F.when(mean > 0, F.try_divide(F.col("median"), mean)).otherwise(1.0).alias("seasonal_factor"))


def forecast_statistics(forecast: DataFrame, by: list[str], value: str = "kwh", order: str = "horizon") -> DataFrame:
    """Annual figures, peak and low month and trend (slope over the horizon, two kWh a month)."""
    v, x = F.col(value), F.col(order)
    slope = F.regr_slope(v, x)
    mean, std = F.avg(v), F.stddev_pop(v)
    return forecast.groupBy(*by).agg(
        F.sum(v).alias("annual_total"), mean.alias("annual_average"),
        F.max_by("month", F.struct(F.round(v + 1e-7, 5), -F.col("month"))).alias("peak_month"), F.max(v).alias("peak_kwh"),
        F.min_by("month", F.struct(F.round(v + 1e-7, 5), F.col("month"))).alias("low_month"), F.min(v).alias("low_kwh"),
        F.when(slope > 2, "increasing").when(slope < -2, "decreasing").otherwise("stable").alias("trend"),
        std.alias("monthly_variability"), F.when(mean > 0, F.try_divide(std, mean)).otherwise(0.0).alias("seasonality_index"),
        F.avg("confidence").alias("overall_confidence"))


def national_fallback(users: DataFrame, level: float = 300.0) -> DataFrame:
    return users.select("user_id", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month")).withColumn(
        "kwh", level * N.lookup(F.col("month"), C.FORECAST_SEASONAL)).withColumn("confidence", F.lit(0.3))


def serving_frame(users: DataFrame, similar: DataFrame, top: int = 5) -> DataFrame:
    """The 30 features of every user and month, from the user's own months and the nearest households."""
    nets = F.transform(F.sort_array(F.collect_list(F.struct("rank", "net_by_month"))), lambda e: e["net_by_month"])
    near = similar.where(F.col("rank") <= top).groupBy("user_id").agg(nets.alias("nets"))
    cols = ["user_id", "consumption_months", "phase", *[c for c in ("inv_capacity",) if c in users.columns]]
    df = users.select(*cols).join(near, "user_id").withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    own = F.try_element_at(F.col("consumption_months"), F.col("month")).cast("double")
    vals = F.filter(F.transform("nets", lambda a: F.get(a, F.col("month") - 1)), lambda v: v.isNotNull())
    df = df.withColumns({"_own": own, "_vals": vals, "_user_avg": N.array_mean(F.transform(F.map_values("consumption_months"), lambda v: v.cast("double")))})
    df = df.withColumns({"_med": F.when(F.size("_vals") > 0, N.array_median(F.col("_vals"))), "_mean": N.array_mean(F.col("_vals")),
                         "_first": F.get("_vals", 0)})
    scaled = F.when(F.col("_mean") > 0, F.col("_med") * F.try_divide(F.col("_user_avg"), F.col("_mean"))).otherwise(F.col("_med"))
    df = df.withColumns({"consumption": F.coalesce("_own", scaled, 400 * N.lookup(F.col("month"), C.FORECAST_SEASONAL)),
                         "_base": F.coalesce("_own", "_med"), "_roll": F.coalesce("_own", "_first")})
    w = Window.partitionBy("user_id").orderBy("month")
    c = F.col("consumption")
    feats: dict[str, Column] = {f"lag_{n}": F.coalesce(F.lag("_base", n).over(w), c * 0.9) for n in (1, 2, 3, 6, 12)}
    for n in (3, 6, 12):
        prev = w.rowsBetween(-n, -1)
        count = F.count("_roll").over(prev)
        feats[f"rolling_mean_{n}"] = F.coalesce(F.avg("_roll").over(prev), c)
        feats[f"rolling_std_{n}"] = F.when(count > 1, F.stddev_pop("_roll").over(prev)).when(count == 1, c * 0.1).otherwise(c)
        feats[f"rolling_min_{n}"] = F.coalesce(F.min("_roll").over(prev), c)
        feats[f"rolling_max_{n}"] = F.coalesce(F.max("_roll").over(prev), c)
    df = df.withColumns(feats)
    lag1, lag12 = F.col("lag_1"), F.col("lag_12")
    diff1, diff12 = c - lag1, F.when(lag12 > 0, c - lag12).otherwise(0.0)
    hist = F.when(lag1 > 0, (lag1 + F.col("lag_2") + F.col("lag_3")) / 3).otherwise(c)
    flags = CAL.season_flags(F.col("month"), serving=True)
    more = {"is_wet_season": flags["is_wet_season"], "is_intermediate": flags["is_intermediate"], "diff_1": diff1, "diff_12": diff12,
            "pct_change_1": F.when(lag1 > 0, F.try_divide(diff1, lag1) * 100).otherwise(0.0),
            "pct_change_12": F.when(lag12 > 0, F.try_divide(diff12, lag12) * 100).otherwise(0.0),
            "consumption_vs_avg": F.when(hist > 0, F.try_divide(c, hist)).otherwise(1.0)}
    for n in (3, 6, 12):
        mean = F.col(f"rolling_mean_{n}")
        more[f"consumption_vs_rolling_{n}"] = F.when(mean > 0, F.try_divide(c, mean)).otherwise(1.0)
    more["INV_CAPACITY"] = F.col("inv_capacity") if "inv_capacity" in df.columns else F.lit(0.0)
    more["DISTANCE_FROM_TF_M"] = F.lit(0.0)
    more["phase_SP"] = F.when(F.col("phase") == "SP", 1.0).otherwise(0.0)
    return df.withColumns(more).select("user_id", "month", "consumption", *feats, *more)


def historical_features(similar: DataFrame, users: DataFrame, top: int = 5) -> DataFrame:
    """Mean, median, spread and range of the nearest households in each of the user's months."""
    near = similar.where(F.col("rank") <= top).join(users.select("user_id", "consumption_months"), "user_id")
    rows = near.select("user_id", F.explode(F.map_keys("consumption_months")).alias("month"), "net_by_month")
    v = F.get("net_by_month", F.col("month") - 1)
    return rows.withColumn("v", v).where(F.col("v").isNotNull()).groupBy("user_id", "month").agg(
        F.avg("v").alias("hist_mean"), F.percentile("v", F.lit(0.5)).alias("hist_median"), F.stddev_pop("v").alias("hist_std"),
        F.min("v").alias("hist_min"), F.max("v").alias("hist_max"))


def user_statistics(users: DataFrame) -> DataFrame:
    """Level, spread and trend of each user's own months, from the map alone (no shuffle)."""
    m = F.transform(F.map_keys("consumption_months"), lambda k: k.cast("double"))
    v = F.transform(F.map_values("consumption_months"), lambda k: k.cast("double"))
    df = users.select("user_id", m.alias("m"), v.alias("v")).withColumn("user_mean", N.array_mean(F.col("v")))
    var = N.array_mean(F.transform("v", lambda x: (x - F.col("user_mean")) * (x - F.col("user_mean"))))
    enough = F.size("v") >= 3
    corr = N.array_corr(F.col("m"), F.col("v"))
    return df.select("user_id", "user_mean", N.array_median(F.col("v")).alias("user_median"), F.sqrt(var).alias("user_std"),
                     F.array_min("v").alias("user_min"), F.array_max("v").alias("user_max"),
                     F.when(F.col("user_mean") > 0, F.try_divide(F.sqrt(var), F.col("user_mean"))).otherwise(0.0).alias("user_cv"),
                     F.when(enough, N.array_slope(F.col("m"), F.col("v"))).alias("user_trend_slope"),
                     F.when(enough, corr * corr).alias("user_trend_r2"))
