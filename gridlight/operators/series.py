"""Lag, rolling and sequence features over each account's months.

All features of a frame share one partitioning and order, so Spark plans a
single exchange and a single sort for them.  An account's group is its number
of months; ``monthly`` input (one row per account and month) is assumed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridlight import constants as C
from gridlight.functions import calendar as CAL
from gridlight.functions.numeric import guarded_corr, lookup, right_closed_bin, one_hot

LAGS, WINDOWS = [1, 2, 3, 6, 12], [3, 6, 12]


def by_account(account: str = "account_id") -> Window:
    return Window.partitionBy(account).orderBy("YEAR", "MONTH")


def lag_features(df: DataFrame, value: str = "NET_CONSUMPTION_kWh", lags: list[int] = LAGS) -> DataFrame:
    w = by_account()
    return df.withColumns({f"lag_{n}": F.lag(value, n).over(w) for n in lags})


def rolling_features(df: DataFrame, value: str = "NET_CONSUMPTION_kWh", windows: list[int] = WINDOWS) -> DataFrame:
    """Statistics of the previous rows; the current row is never inside its own window."""
    out = {}
    for n in windows:
        w = by_account().rowsBetween(-n, -1)
        for name, agg in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)):
            out[f"rolling_{name}_{n}"] = agg(value).over(w)
    return df.withColumns(out)


def difference_features(df: DataFrame, value: str = "NET_CONSUMPTION_kWh", steps: tuple[int, ...] = (1, 12)) -> DataFrame:
    w, v = by_account(), F.col(value)
    out = {}
    for n in steps:
        prev = F.lag(value, n).over(w)
        out[f"diff_{n}"] = v - prev
        out[f"pct_change_{n}"] = F.try_divide(v - prev, prev) * 100
    return df.withColumns(out)


def ratio_features(df: DataFrame, value: str = "NET_CONSUMPTION_kWh", windows: list[int] = WINDOWS) -> DataFrame:
    """Ratio to the expanding mean (current row included) and to the previous rolling means."""
    v = F.col(value)
    out = {"consumption_vs_avg": F.try_divide(v, F.avg(value).over(
        by_account().rowsBetween(Window.unboundedPreceding, 0)))}
    for n in windows:
        out[f"consumption_vs_rolling_{n}"] = F.try_divide(v, F.avg(value).over(by_account().rowsBetween(-n, -1)))
    return df.withColumns(out)


def fill_expanding(df: DataFrame, cols: list[str], fallback: float | Column = 0.0) -> DataFrame:
    """Null features take the mean of the account's earlier values of the same feature."""
    w = by_account().rowsBetween(Window.unboundedPreceding, 0)
    last = F.lit(fallback) if isinstance(fallback, (int, float)) else fallback
    return df.withColumns({c: F.coalesce(F.col(c), F.avg(c).over(w), last) for c in cols})


def training_features(df: DataFrame) -> DataFrame:
    """The whole feature frame: calendar, lags, rollings, differences, ratios, one-hot codes."""
    m = F.col("MONTH")
    sin, cos = CAL.encode_cyclic(m, 12)
    q = CAL.quarter_of(m)
    qs, qc = CAL.encode_cyclic(q, 4)
    out = difference_features(rolling_features(lag_features(df)))
    out = ratio_features(out)
    flags = {"month_sin": sin, "month_cos": cos, "quarter": q, "quarter_sin": qs, "quarter_cos": qc,
             **CAL.season_flags(m), **one_hot(F.col("CAL_TARIFF"), C.VALID_TARIFFS, "tariff"),
             **one_hot(F.col("PHASE"), C.VALID_PHASES, "phase")}
    return out.withColumns(flags)


def smooth_circular(df: DataFrame, keys: list[str], value: str, month: str = "month") -> DataFrame:
    """Weights 1/4, 1/2, 1/4 over neighbouring months, December next to January (twelve rows per key)."""
    w = Window.partitionBy(*keys).orderBy(month)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag(value).over(w), F.last(value).over(whole))
    after = F.coalesce(F.lead(value).over(w), F.first(value).over(whole))
    return df.withColumn(value, before * 0.25 + F.col(value) * 0.5 + after * 0.25)


def sequences(df: DataFrame, features: list[str], lookback: int, horizon: int, value: str = "NET_CONSUMPTION_kWh") -> DataFrame:
    """Windows of ``lookback`` feature rows and the following ``horizon`` values, never across accounts.

    Each output row holds ``lookback + horizon`` rows, so the frame is bounded
    whatever the length of the history.
    """
    w = by_account()
    x = F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in features])).over(w.rowsBetween(-lookback + 1, 0))
    y = F.collect_list(value).over(w.rowsBetween(1, horizon))
    return (df.select("account_id", "YEAR", "MONTH", x.alias("x"), y.alias("y"))
            .where((F.size("x") == lookback) & (F.size("y") == horizon)))


def lag_correlations(df: DataFrame, value: str = "NET_CONSUMPTION_kWh", lags: list[int] = LAGS) -> DataFrame:
    """Correlation of each lag with the value, one row per lag."""
    wide = lag_features(df, value, lags).agg(*[guarded_corr(F.col(f"lag_{n}"), F.col(value)).alias(f"c{n}") for n in lags])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(n).alias("lag"), F.col(f"c{n}").alias("correlation")) for n in lags])))


def densify_year(readings: DataFrame, keys: list[str], measured: list[int] | None = None) -> DataFrame:
    """Twelve months per account (and year): measured months as they are, the others from the account's
    mean times seasonal and solar factors, clipped, labelled SYNTHETIC.

    The twelve months come from a literal sequence, not from a join, so the only
    shuffles are those on the account.
    """
    use = readings.where(F.col("MONTH").isin(measured)) if measured else readings
    base = use.groupBy(*keys).agg(
        F.avg("NET_CONSUMPTION_kWh").alias("avg_net"), F.avg("EXPORT_kWh").alias("avg_export"),
        F.max("HAS_SOLAR").alias("HAS_SOLAR"),
        F.map_from_entries(F.collect_list(F.struct("MONTH", F.struct(
            "IMPORT_kWh", "EXPORT_kWh", "NET_CONSUMPTION_kWh", "DATA_QUALITY")))).alias("known"))
    grid = base.withColumn("MONTH", F.explode(F.sequence(F.lit(1), F.lit(12))))
    k = F.try_element_at(F.col("known"), F.col("MONTH"))
    solar = F.col("HAS_SOLAR") == 1
    net = F.greatest(F.lit(50.0), F.least(F.lit(2000.0), F.col("avg_net") * lookup(F.col("MONTH"), C.EXPANSION_SEASONAL)))
    exp = F.when(solar, F.least(F.lit(1000.0), F.col("avg_export") * lookup(F.col("MONTH"), C.EXPANSION_SOLAR))).otherwise(0.0)
    grid = grid.withColumns({"_net": net, "_exp": exp})
    imp = F.least(F.lit(2500.0), F.col("_net") + F.col("_exp"))
    r = lambda c: F.round(c + 1e-7, 2)
    return grid.select(*keys, "MONTH", "HAS_SOLAR",
                       F.coalesce(k["IMPORT_kWh"], r(imp)).alias("IMPORT_kWh"),
                       F.coalesce(k["EXPORT_kWh"], r(F.col("_exp"))).alias("EXPORT_kWh"),
                       F.coalesce(k["NET_CONSUMPTION_kWh"], r(F.col("_net"))).alias("NET_CONSUMPTION_kWh"),
                       F.coalesce(k["DATA_QUALITY"], F.lit("SYNTHETIC")).alias("DATA_QUALITY"))
