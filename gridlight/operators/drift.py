"""Drift of errors, features and clusters, and the alert summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridlight import constants as C
from gridlight.functions.numeric import kolmogorov_p
from gridlight.operators.ordered import ks_statistic


def error_history(df: DataFrame, by: list[str], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """MAE per run; ``by`` are the run keys (series, then time)."""
    return df.groupBy(*by).agg(F.avg(F.abs(F.col(y) - F.col(p))).alias("mae"), F.count(F.lit(1)).alias("n_samples"))


def prediction_drift(history: DataFrame, by: list[str], order: list[str], window: int = C.DRIFT_WINDOW, threshold: float = C.DRIFT_THRESHOLD) -> DataFrame:
    """Last ``window`` runs against the ``window`` before them, per series."""
    w = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    last = history.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 2 * window)
    recent, base = F.when(F.col("_r") <= window, F.col("mae")), F.when(F.col("_r") > window, F.col("mae"))
    out = last.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), F.avg(recent).alias("recent_mae"), F.avg(base).alias("baseline_mae"), F.stddev_pop(base).alias("_s"))
    out = out.where(F.col("runs") == 2 * window)
    z = F.try_divide(F.col("recent_mae") - F.col("baseline_mae"), F.nullif(F.col("_s"), F.lit(0.0)))
    out = out.withColumn("z_score", z).drop("_s", "runs")
    hit = F.coalesce(F.abs(F.col("z_score")) > threshold, F.lit(False))
    return out.withColumns({"drift_detected": hit, "severity": F.when(hit, F.when(F.abs(F.col("z_score")) > threshold * 1.5, "high").otherwise("medium"))})


def each_drift(history: DataFrame, by: list[str], at: str, window: int = C.DRIFT_WINDOW, threshold: float = C.DRIFT_THRESHOLD) -> DataFrame:
    """``prediction_drift`` as it stands after every run: each run with the ``window - 1`` before it against the ``window`` runs
    before those.  All columns stay; a run with fewer runs before it has no z-score and no drift."""
    order = Window.partitionBy(*by).orderBy(at)
    recent, base = order.rowsBetween(1 - window, 0), order.rowsBetween(1 - 2 * window, -window)
    out = history.withColumns({"_n": F.count(F.lit(1)).over(base), "recent_mae": F.avg("mae").over(recent), "baseline_mae": F.avg("mae").over(base),
                               "_s": F.stddev_pop("mae").over(base)})
    z = F.when(F.col("_n") == window, F.try_divide(F.col("recent_mae") - F.col("baseline_mae"), F.nullif(F.col("_s"), F.lit(0.0))))
    out = out.withColumn("z_score", z).drop("_n", "_s")
    hit = F.coalesce(F.abs(F.col("z_score")) > threshold, F.lit(False))
    return out.withColumns({"drift_detected": hit, "severity": F.when(hit, F.when(F.abs(F.col("z_score")) > threshold * 1.5, "high").otherwise("medium"))})


def feature_drift(df: DataFrame, by: list[str], features: list[str], is_recent: Column, is_baseline: Column, alpha: float = 0.05) -> DataFrame:
    """Two-sample KS test of every feature, recent rows against baseline rows."""
    items = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features])
    rows = df.where(is_recent | is_baseline).select(*by, is_recent.alias("_recent"), F.explode(items).alias("e")).select(*by, "_recent", "e.feature", "e.x")
    ks = ks_statistic(rows, [*by, "feature"], "x", F.col("_recent"))
    n1, n2 = F.col("n_recent").cast("double"), F.col("n_baseline").cast("double")
    p = F.when((n1 >= 5) & (n2 >= 5), kolmogorov_p(F.col("ks_statistic"), n1, n2))
    return ks.withColumn("p_value", p).withColumn("drifted", F.coalesce(F.col("p_value") < alpha, F.lit(False)))


def cluster_stability(previous: DataFrame, current: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of accounts that kept their cluster."""
    by = by or []
    both = previous.select(*by, "account_id", F.col("cluster").alias("_old")).join(current.select(*by, "account_id", "cluster"), [*by, "account_id"])
    out = both.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("_old") != F.col("cluster")).alias("changed"))
    out = out.withColumn("stability", F.when(F.col("total") > 0, 1 - F.col("changed") / F.col("total")).otherwise(1.0))
    return out.withColumns({"drift_detected": F.col("stability") < 0.8,
                            "severity": F.when(F.col("stability") < 0.6, "high").when(F.col("stability") < 0.8, "medium")})


def drift_summary(alerts: DataFrame, latest: int = 5) -> DataFrame:
    """Counts by type and severity, the latest alerts and the advice; ``alerts`` has (at, type, severity, key)."""
    counts = alerts.groupBy("type", "severity").agg(F.count(F.lit(1)).alias("n"))           # a handful of rows
    of = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    head = counts.agg(of(F.lit(True)).alias("total_alerts"), of(F.col("severity") == "high").alias("high"), of(F.col("severity") == "medium").alias("medium"),
                      of(F.col("type") == "prediction_error_drift").alias("prediction_error_drift"), of(F.col("type") == "feature_drift").alias("feature_drift"),
                      of(F.col("type") == "cluster_instability").alias("cluster_instability"))
    recent = alerts.orderBy(F.col("at").desc(), "type", "key").limit(latest)
    recent = recent.agg(F.sort_array(F.collect_list(F.struct("at", "type", "key")), asc=False)).scalar()
    advice = (F.when(F.col("high") > 0, "URGENT: Model retraining recommended immediately")
              .when(F.col("medium") > 3, "WARNING: Consider retraining model within 1 month")
              .when(F.col("feature_drift") > 0, "INFO: Feature distributions changing - monitor closely").otherwise("OK: No action needed"))
    return head.withColumns({"status": F.when(F.col("total_alerts") > 0, "drift_detected").otherwise("healthy"), "recent_alerts": recent, "recommendation": advice})
