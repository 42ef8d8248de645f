"""Forecast metrics, baselines, residual tests and correlation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridlight.functions import calendar as CAL, numeric as N
from gridlight.operators.ordered import exact_quantiles
from gridlight.operators.series import by_account


def metric_columns(y: Column, p: Column) -> dict[str, Column]:
    """MAE, RMSE, MAPE, R2, bias and peak error as aggregates over actual ``y`` and predicted ``p``."""
    err, n = p - y, F.count(y)
    peak = F.struct(y, -F.abs(err))
    mean = F.avg(y)
    return {"n": n, "mae": F.avg(F.abs(err)), "rmse": F.sqrt(F.avg(err * err)),
            "mape": F.avg(F.when(y > 0, F.abs(F.try_divide(err, y)))) * 100,
            "r2": 1 - F.try_divide(F.sum(err * err), F.var_pop(y) * n),
            "bias": F.avg(err), "bias_pct": F.when(mean > 0, F.try_divide(F.avg(err), mean) * 100).otherwise(0.0),
            "peak_error": F.max_by(F.abs(err), peak),
            "peak_error_pct": F.max_by(F.try_divide(F.abs(err), y) * 100, peak)}


def forecast_metrics(df: DataFrame, by: list[str] | None = None, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    return df.groupBy(*(by or [])).agg(*[c.alias(k) for k, c in metric_columns(F.col(y), F.col(p)).items()])


def scaled_error(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """MASE: MAE over the MAE of the twelve-months-ago forecast of each account."""
    naive = F.abs(F.col(y) - F.lag(y, 12).over(by_account()))
    out = df.withColumn("_naive", naive).agg(F.avg(F.abs(F.col(y) - F.col(p))).alias("mae"), F.avg("_naive").alias("naive_mae"))
    return out.withColumn("mase", F.try_divide(F.col("mae"), F.nullif(F.col("naive_mae"), F.lit(0.0))))


def consumption_level(x: Column) -> Column:
    return N.right_closed_bin(x, [0, 90, 150, 300, 2000], ["Low", "Medium-Low", "Medium-High", "High"])


def metrics_by_level(df: DataFrame) -> DataFrame:
    return forecast_metrics(df.withColumn("level", consumption_level(F.col("y_true"))), ["level"]).select("level", "n", "mae", "rmse")


def metrics_by_season(df: DataFrame) -> DataFrame:
    return forecast_metrics(df.withColumn("season", CAL.validation_season(F.col("MONTH"))), ["season"]).select("season", "n", "mae", "rmse")


def level_errors(df: DataFrame, readings: DataFrame) -> DataFrame:
    """All errors of the accounts that were ever at a level, per level.

    An account's errors are summed before the join, so the join carries one row
    per account and level, not one per reading.
    """
    err = F.abs(F.col("y_true") - F.col("y_pred"))
    per_account = df.groupBy("account_id").agg(F.sum(err).alias("s"), F.sum(err * err).alias("q"), F.count(err).alias("n"))
    levels = readings.select("account_id", consumption_level(F.col("NET_CONSUMPTION_kWh")).alias("level")).where("level IS NOT NULL").distinct()
    return levels.join(per_account, "account_id").groupBy("level").agg(
        F.count(F.lit(1)).alias("n_accounts"), (F.sum("s") / F.sum("n")).alias("mae"), F.sqrt(F.sum("q") / F.sum("n")).alias("rmse"))


def naive_baselines(readings: DataFrame, value: str = "NET_CONSUMPTION_kWh") -> DataFrame:
    """MAE of persistence, seasonal-naive and month-mean forecasts, one row each."""
    w, v = by_account(), F.col(value)
    means = readings.groupBy("MONTH").agg(F.avg(value).alias("_month_mean"))       # twelve rows
    df = readings.join(F.broadcast(means), "MONTH").withColumns(
        {"_p1": F.lag(value, 1).over(w), "_p12": F.lag(value, 12).over(w)})
    one = df.agg(F.avg(F.abs(v - F.col("_p1"))).alias("a"), F.avg(F.abs(v - F.col("_p12"))).alias("b"), F.avg(F.abs(v - F.col("_month_mean"))).alias("c"))
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("baseline"), F.col(c).alias("mae")) for n, c in
                                         (("persistence", "a"), ("seasonal_naive", "b"), ("historical_average", "c"))])))


def diebold_mariano(df: DataFrame, by: list[str], order: list[str], y: str = "y_true", p1: str = "y_pred", p2: str = "y_pred2",
                    lags: int = 4, compat: bool = False) -> DataFrame:
    """Diebold-Mariano test of two forecasts of each series.

    The default variance is ``g0 + 2*sum(g1..g_lags)`` over autocovariances;
    ``compat=True`` starts from the lag-one covariance (``g1 + 2*(g2 + ...)``).
    Each series is ordered inside its own group.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    d = F.abs(F.col(y) - F.col(p1)) - F.abs(F.col(y) - F.col(p2))
    rows = df.withColumn("d", d)
    rows = rows.withColumns({f"_d{k}": F.lag("d", k).over(w) for k in range(1, lags + 1)})
    gammas = [F.coalesce(F.covar_samp(F.when(F.col(f"_d{k}").isNotNull(), F.col("d")), F.col(f"_d{k}")), F.lit(0.0)).alias(f"g{k}") for k in range(1, lags + 1)]
    agg = rows.groupBy(*by).agg(F.count("d").alias("n"), F.avg("d").alias("d_bar"), F.var_pop("d").alias("g0"), *gammas)
    rest = [F.col(f"g{k}") for k in range(1, lags + 1)]
    tail = sum(rest[1:], F.lit(0.0)) if compat else sum(rest, F.lit(0.0))
    var = (rest[0] if compat else F.col("g0")) + 2 * tail
    out = agg.withColumn("variance", var)
    ok = F.col("variance") > 0
    out = out.withColumn("dm_statistic", F.when(ok, F.try_divide(F.col("d_bar"), F.sqrt(F.when(ok, F.col("variance")) / F.col("n")))).otherwise(0.0))
    p = F.when(ok, 2 * (1 - N.normal_cdf(F.abs(F.col("dm_statistic"))))).otherwise(1.0)
    return out.select(*by, "n", "dm_statistic", p.alias("p_value"), (ok & (p < 0.05)).alias("significant"),
                      F.when(F.col("d_bar") < 0, "model1").otherwise("model2").alias("better_model"))


def residual_analysis(df: DataFrame, by: list[str], order: list[str], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    res = F.col(y) - F.col(p)
    rows = df.withColumn("e", res).withColumn("_prev", F.lag("e").over(w))
    out = rows.groupBy(*by).agg(
        F.avg("e").alias("mean"), F.stddev_pop("e").alias("std"), F.skewness("e").alias("skewness"), F.kurtosis("e").alias("kurtosis"),
        F.try_divide(F.sum((F.col("e") - F.col("_prev")) * (F.col("e") - F.col("_prev"))), F.sum(F.col("e") * F.col("e"))).alias("durbin_watson"),
        N.guarded_corr(F.abs(F.col("e")), F.col(p)).alias("heteroscedasticity_corr"))
    return out.withColumn("constant_variance", F.abs(F.col("heteroscedasticity_corr")) < 0.3)


def quantile_bias(df: DataFrame, y: str = "y_true", p: str = "y_pred", probs: tuple[float, ...] = (0.10, 0.25, 0.50, 0.75, 0.90)) -> DataFrame:
    """Actual and predicted quantiles side by side, exact at any size."""
    long = df.select(F.explode(F.array(F.struct(F.lit("actual").alias("side"), F.col(y).alias("x")), F.struct(F.lit("predicted").alias("side"), F.col(p).alias("x")))).alias("e")).select("e.side", "e.x")
    names = {f"q{int(q * 100)}": q for q in probs}
    q = exact_quantiles(long, ["side"], "x", names)
    rows = q.select("side", F.inline(F.array(*[F.struct(F.lit(v).alias("quantile"), F.col(n).alias("x")) for n, v in names.items()])))
    wide = rows.groupBy("quantile").pivot("side", ["actual", "predicted"]).agg(F.max("x"))
    return wide.withColumn("bias", F.col("predicted") - F.col("actual"))


def diversity(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Improvement over the mean predictor, number of distinct predictions, spread ratio."""
    mean = df.agg(F.avg(y)).scalar()
    out = df.withColumn("_mean", mean).agg(
        F.avg(F.abs(F.col(y) - F.col(p))).alias("mae"), F.avg(F.abs(F.col(y) - F.col("_mean"))).alias("mean_mae"),
        F.count_distinct(F.round(p, 1)).alias("distinct_predictions"), F.stddev_pop(p).alias("_sp"), F.stddev_pop(y).alias("_sy"))
    return out.select("mae", "mean_mae", ((1 - F.try_divide(F.col("mae"), F.col("mean_mae"))) * 100).alias("improvement_pct"),
                      "distinct_predictions", F.try_divide(F.col("_sp"), F.col("_sy")).alias("std_ratio"))


def coverage(df: DataFrame, lo: Column, hi: Column, y: str = "y_true", p: str = "y_pred", within: float = 150.0, low_limit: float = 400.0) -> DataFrame:
    err = F.abs(F.col(y) - F.col(p))
    return df.agg((F.avg(F.col(y).between(lo, hi).cast("int")) * 100).alias("coverage_pct"),
                  (F.avg((err <= within).cast("int")) * 100).alias("within_pct"), F.avg(F.when(F.col(y) < low_limit, err)).alias("low_mae"))


def weighted_mae(y: Column, p: Column) -> Column:
    """Errors count double below 400 kWh and threefold below 200."""
    weight = F.when(y < 200, 3.0).when(y < 400, 2.0).otherwise(1.0)
    return F.avg(F.abs(y - p) * weight)


def confusion_matrix(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    out = df.agg(F.count_if(truth & predicted).alias("tp"), F.count_if(~truth & predicted).alias("fp"),
                 F.count_if(truth & ~predicted).alias("fn"), F.count_if(~truth & ~predicted).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumns({"precision": N.safe_divide(tp, tp + fp, None), "recall": N.safe_divide(tp, tp + fn, None),
                            "f1": N.safe_divide(2.0 * tp, 2 * tp + fp + fn, None)})


def correlation_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """Long correlation matrix; all pairs come out of one aggregate over the data."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    wide = df.agg(*[N.guarded_corr(F.col(a), F.col(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = []
    for i, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)}:
            rows.append(F.struct(F.lit(x).alias("feature"), F.lit(y).alias("other"), F.col(f"c{i}").alias("correlation")))
    return wide.select(F.inline(F.array(*rows)))


def target_correlations(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    wide = df.agg(*[N.guarded_corr(F.col(c), F.col(target)).alias(f"c{i}") for i, c in enumerate(cols)])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"c{i}").alias("correlation")) for i, c in enumerate(cols)])))


def t_test(df: DataFrame, value: str, group: Column, by: list[str] | None = None) -> DataFrame:
    """Two-sample t-test with pooled variance; the p-value is that of Student's distribution with n1 + n2 - 2 degrees."""
    a, b = F.when(group, F.col(value)), F.when(~group, F.col(value))
    out = df.groupBy(*(by or [])).agg(F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("mean1"), F.avg(b).alias("mean2"),
                 F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2"))
    n1, n2 = F.col("n1"), F.col("n2")
    pooled = F.try_divide((n1 - 1) * F.col("v1") + (n2 - 1) * F.col("v2"), (n1 + n2 - 2).cast("double"))
    se = F.sqrt(pooled * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))
    out = out.withColumn("t_statistic", F.try_divide(F.col("mean1") - F.col("mean2"), se))
    p = F.when(n1 + n2 > 2, N.t_two_sided_p(F.col("t_statistic"), n1 + n2 - 2))
    return out.select(*(by or []), "n1", "n2", "mean1", "mean2", "t_statistic", p.alias("p_value"))


def outlier_counts(df: DataFrame, value: str) -> DataFrame:
    """Global 1.5-IQR and three-sigma outlier counts."""
    q = exact_quantiles(df, [], value, {"q1": 0.25, "q3": 0.75})
    m = df.agg(F.struct(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))).scalar()
    b = q.select(F.struct((F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("lo"), (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("hi"))).scalar()
    x = F.col(value)
    return df.select(value, m.alias("m"), b.alias("b")).agg(
        F.count(x).alias("n"), F.count_if((x < F.col("b.lo")) | (x > F.col("b.hi"))).alias("iqr_outliers"),
        F.count_if(F.abs(x - F.col("m.m")) > 3 * F.col("m.s")).alias("z_outliers"))


def fold_summary(metrics: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, spread and stability label over folds."""
    out = metrics.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    cv = F.try_divide(F.col("std"), F.nullif(F.col("mean"), F.lit(0.0)))
    return out.withColumn("cv", cv).withColumn("stability", F.when(F.col("cv") < 0.1, "very stable").when(F.col("cv") < 0.2, "stable")
                                               .when(F.col("cv") < 0.3, "moderate").otherwise("unstable"))
