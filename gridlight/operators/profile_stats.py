"""Exploratory tables: profiles by month, household statistics, contrasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridlight.functions.geo import is_urban
from gridlight.functions.numeric import guarded_corr
from gridlight.operators.ordered import exact_quantiles

NET = "NET_CONSUMPTION_kWh"


def month_profile(df: DataFrame, value: str = NET) -> DataFrame:
    """Mean, median, spread and count of every calendar month, absent months as null rows."""
    stats = df.groupBy("MONTH").agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))
    med = exact_quantiles(df, ["MONTH"], value, {"median": 0.5}).drop("n")
    months = df.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("MONTH"))
    return months.join(stats.join(med, "MONTH"), "MONTH", "left")


def household_statistics(df: DataFrame) -> DataFrame:
    first = F.struct("YEAR", "MONTH")
    return df.groupBy("account_id").agg(
        F.avg(NET).alias("avg_consumption"), F.stddev_samp(NET).alias("std_consumption"), F.min(NET).alias("min_consumption"),
        F.max(NET).alias("max_consumption"), F.count(NET).alias("n_months"), F.min_by("HAS_SOLAR", first).alias("has_solar"),
        F.min_by("CAL_TARIFF", first).alias("tariff"))


def household_summary(stats: DataFrame) -> DataFrame:
    return stats.agg(F.min("avg_consumption").alias("min_avg"), F.max("avg_consumption").alias("max_avg"),
                     F.count_if(F.col("std_consumption") > 100).alias("high_variability"), F.count_if(F.col("n_months") >= 12).alias("complete"))


def account_month_matrix(df: DataFrame, value: str = NET) -> DataFrame:
    """Accounts by twelve month columns; the month list is given, so no extra pass finds it."""
    return df.groupBy("account_id").pivot("MONTH", list(range(1, 13))).agg(F.avg(value))


def quality_matrix(df: DataFrame, labels: list[str]) -> DataFrame:
    return df.groupBy("MONTH").pivot("DATA_QUALITY", labels).count().fillna(0)


def group_means(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(v).alias(f"avg_{v}") for v in values], F.count(F.lit(1)).alias("n"))


def capacity_variation(df: DataFrame, values: list[str]) -> DataFrame:
    """Coefficient of variation of candidate targets over the capacity groups."""
    groups = df.groupBy("INV_CAPACITY").agg(*[F.avg(v).alias(v) for v in values])
    return groups.agg(*[F.try_divide(F.stddev_samp(v), F.avg(v)).alias(f"cv_{v}") for v in values])


def seasonal_contrasts(df: DataFrame) -> DataFrame:
    """Top and bottom months, April boost, monsoon drop, solar and urban contrasts, in one row.

    The readings are read once: everything is folded to (month, solar, urban)
    sums first, which is at most 48 rows.
    """
    urban = is_urban(F.col("CUSTOMER_LAT"), F.col("CUSTOMER_LON"))
    cells = df.groupBy("MONTH", "HAS_SOLAR", urban.alias("urban")).agg(F.sum(NET).alias("s"), F.count(NET).alias("n"))
    months = cells.groupBy("MONTH").agg((F.sum("s") / F.sum("n")).alias("m"))
    m = months.agg(F.avg("m").alias("mean"), F.slice(F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("k"), "MONTH"))), 1, 3)["MONTH"].alias("peak_months"),
                   F.slice(F.array_sort(F.collect_list(F.struct("m", "MONTH"))), 1, 3)["MONTH"].alias("low_months"),
                   F.max(F.when(F.col("MONTH") == 4, F.col("m"))).alias("april"), F.avg(F.when(F.col("MONTH").isin(7, 8), F.col("m"))).alias("monsoon"))
    part = lambda cond: F.try_divide(F.sum(F.when(cond, F.col("s"))), F.sum(F.when(cond, F.col("n"))).cast("double"))
    c = cells.agg(F.struct(part(F.col("HAS_SOLAR") == 1).alias("solar"), part(F.col("HAS_SOLAR") == 0).alias("other"),
                           part(F.col("urban")).alias("urban"), part(~F.col("urban")).alias("rural"))).scalar()
    pct = lambda a, b: (F.try_divide(a, b) - 1) * 100
    return m.withColumn("c", c).select(
        "peak_months", "low_months", pct(F.col("april"), F.col("mean")).alias("april_boost_pct"), (-pct(F.col("monsoon"), F.col("mean"))).alias("monsoon_drop_pct"),
        F.abs(pct(F.col("c.solar"), F.col("c.other"))).alias("solar_contrast_pct"), pct(F.col("c.urban"), F.col("c.rural")).alias("urban_contrast_pct"))


def account_efficiency(df: DataFrame) -> DataFrame:
    """Mean export per account, per kW, and whether it lies outside 1.5 IQRs of all accounts."""
    acc = df.groupBy("account_id").agg(F.avg("EXPORT_kWh").alias("avg_export"), F.max("INV_CAPACITY").alias("capacity"))
    q = exact_quantiles(acc, [], "avg_export", {"q1": 0.25, "q3": 0.75})
    b = q.select(F.struct((F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("lo"), (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("hi"))).scalar()
    return acc.withColumn("b", b).select("account_id", "avg_export", F.try_divide(F.col("avg_export"), F.nullif(F.col("capacity"), F.lit(0.0))).alias("efficiency"),
                                         "capacity", (~F.col("avg_export").between(F.col("b.lo"), F.col("b.hi"))).alias("is_outlier"))


def normalisation_effect(eff: DataFrame) -> DataFrame:
    """Correlation with the capacity before and after dividing by it."""
    return eff.agg(guarded_corr(F.col("avg_export"), F.col("capacity")).alias("before"), guarded_corr(F.col("efficiency"), F.col("capacity")).alias("after"))


def case_account(df: DataFrame) -> DataFrame:
    """The account whose mean is closest to the median of the account means."""
    acc = df.groupBy("account_id").agg(F.avg(NET).alias("m"))
    med = exact_quantiles(acc, [], "m", {"median": 0.5}).select("median").scalar()
    return acc.withColumn("median", med).agg(
        F.min_by("account_id", F.struct(F.round(F.abs(F.col("m") - F.col("median")), 9), F.col("account_id"))).alias("account_id"), F.max("median").alias("median"))
