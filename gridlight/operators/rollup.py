"""Roll-ups of readings to transformers, customers and the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridlight import constants as C
from gridlight.functions.calendar import time_index
from gridlight.functions.geo import haversine_m
from gridlight.functions.numeric import clip, right_closed_bin, safe_divide
from gridlight.operators.ordered import exact_quantiles

DISTANCE_ZONES = ([0, 50, 100, 200, 300, 400, 500, float("inf")],
                  ["0-50m", "50-100m", "100-200m", "200-300m", "300-400m", "400-500m", "500m+"])


def with_distance(readings: DataFrame) -> DataFrame:
    return readings.withColumn("DISTANCE_FROM_TF_M", haversine_m(
        F.col("CUSTOMER_LAT"), F.col("CUSTOMER_LON"), F.col("TRANSFORMER_LAT"), F.col("TRANSFORMER_LON")))


def customers_once(readings: DataFrame) -> DataFrame:
    """One row per (transformer, account), taken from its earliest month.

    Order and values are plain numbers, so the aggregate hashes instead of sorting the readings.
    """
    first = time_index(F.col("YEAR"), F.col("MONTH"))
    return readings.groupBy("TRANSFORMER_CODE", "ACCOUNT_NO").agg(
        F.min_by("INV_CAPACITY", first).alias("INV_CAPACITY"), F.min_by("HAS_SOLAR", first).alias("HAS_SOLAR"))


def transformer_rollup(readings: DataFrame) -> DataFrame:
    """Consumption statistics and deduplicated solar capacity per transformer.

    Everything is folded to (transformer, account) first, so the second, small
    aggregate serves the distinct count, the solar sums and the moments; no
    separate distinct pass and no self-join over the readings.
    """
    first = time_index(F.col("YEAR"), F.col("MONTH"))
    net = F.col("NET_CONSUMPTION_kWh")
    per_account = with_distance(readings).groupBy("TRANSFORMER_CODE", "ACCOUNT_NO").agg(
        F.min(first).alias("_first"), F.min_by("TRANSFORMER_LAT", first).alias("_lat"),
        F.min_by("TRANSFORMER_LON", first).alias("_lon"),
        F.min_by("INV_CAPACITY", first).alias("_cap"), F.min_by("HAS_SOLAR", first).alias("_solar"),
        F.count(net).alias("_n"), F.sum(net).alias("_s"), F.var_pop(net).alias("_v"), F.max(net).alias("_max"),
        F.sum("IMPORT_kWh").alias("_imp"), F.count("IMPORT_kWh").alias("_nimp"),
        F.sum("EXPORT_kWh").alias("_exp"), F.count("EXPORT_kWh").alias("_nexp"),
        F.sum("DISTANCE_FROM_TF_M").alias("_d"), F.count("DISTANCE_FROM_TF_M").alias("_nd"))
    n, mean = F.sum("_n"), F.sum("_s") / F.sum("_n")
    # pooled second moment: within accounts plus between account means
    account_mean = F.try_divide(F.col("_s"), F.col("_n"))
    within = F.sum(F.col("_v") * F.col("_n"))
    between = F.sum(F.col("_n") * account_mean * account_mean) - n * mean * mean
    return per_account.groupBy("TRANSFORMER_CODE").agg(
        F.min_by("_lat", F.struct("_first", "ACCOUNT_NO")).alias("TRANSFORMER_LAT"), F.min_by("_lon", F.struct("_first", "ACCOUNT_NO")).alias("TRANSFORMER_LON"),
        mean.alias("avg_consumption"),
        F.when(n > 1, F.sqrt(F.greatest(within + between, F.lit(0.0)) / (n - 1))).alias("consumption_std"),
        F.max("_max").alias("max_consumption"), (F.sum("_imp") / F.sum("_nimp")).alias("avg_import"),
        (F.sum("_exp") / F.sum("_nexp")).alias("avg_export"), F.count(F.lit(1)).alias("num_customers"),
        (F.sum("_d") / F.sum("_nd")).alias("avg_distance_from_tf"), n.alias("data_points"),
        F.coalesce(F.sum("_cap"), F.lit(0.0)).alias("total_solar_capacity"),
        F.coalesce(F.sum("_solar"), F.lit(0)).alias("solar_connections"))


def transformer_features(rollup: DataFrame, capacity_kw: float = C.TRANSFORMER_CAPACITY_KW,
                         load_basis: str = "customer") -> DataFrame:
    """Load, utilisation, headroom, penetration, volatility and export ratio.

    ``load_basis='customer'`` uses the mean kWh of a customer month, ``'total'``
    that mean times the number of customers.
    """
    per_row = F.coalesce(F.col("avg_consumption"), F.lit(0.0)) / C.HOURS_PER_MONTH
    load = per_row * F.col("num_customers") if load_basis == "total" else per_row
    cap = F.lit(float(capacity_kw))
    return (rollup.withColumn("ESTIMATED_CAPACITY_kW", cap).withColumn("current_load_kW", load)
            .withColumns({
                "utilization_rate": clip(F.col("current_load_kW") / cap, 0.0, 1.0),
                "available_headroom": cap - F.col("current_load_kW") - F.col("total_solar_capacity"),
                "solar_penetration": clip(F.col("total_solar_capacity") / cap, 0.0),
                "demand_volatility": F.coalesce(F.col("consumption_std") / C.HOURS_PER_MONTH, F.lit(0.0)),
                "export_ratio": safe_divide(F.col("avg_export"), F.col("avg_import") + 1)})
            .fillna(0.0))


ACCOUNT_ATTRIBUTES = ["TRANSFORMER_CODE", "HAS_SOLAR", "INV_CAPACITY", "CAL_TARIFF", "PHASE", "CUSTOMER_LAT", "CUSTOMER_LON"]


def customer_profiles(readings: DataFrame) -> DataFrame:
    """One row per account: month maps, annual statistics and attributes.

    The readings meet one hash aggregate of plain numbers (the attributes are part
    of its key, as they hardly ever change); what follows works on a dozen rows per
    account, however long its history is.
    """
    net, imp, exp = "NET_CONSUMPTION_kWh", "IMPORT_kWh", "EXPORT_kWh"
    folded = readings.groupBy("account_id", "ACCOUNT_NO", "MONTH", *ACCOUNT_ATTRIBUTES).agg(
        F.min(time_index(F.col("YEAR"), F.col("MONTH"))).alias("_t"),
        *[x for c in (net, imp, exp) for x in (F.sum(c).alias(f"_s_{c}"), F.count(c).alias(f"_n_{c}"))])
    mean = lambda c: F.try_divide(F.sum(f"_s_{c}"), F.sum(f"_n_{c}").cast("double"))
    months = folded.groupBy("account_id", "ACCOUNT_NO", "MONTH").agg(
        mean(net).alias("net"), mean(imp).alias("imp"), mean(exp).alias("exp"),
        F.min("_t").alias("_t"), F.min_by(F.struct(*ACCOUNT_ATTRIBUTES), "_t").alias("_a"))
    pattern = F.map_from_entries(F.sort_array(F.collect_list(F.struct(
        F.col("MONTH"), F.struct(F.col("net").alias("net_consumption"), F.col("imp").alias("import"), F.col("exp").alias("export"))))))
    out = months.groupBy("account_id", "ACCOUNT_NO").agg(
        F.min_by("_a", "_t").alias("_a"), pattern.alias("monthly_pattern"),
        F.count(F.lit(1)).cast("int").alias("months_with_data"), F.count_if(F.col("net") < 10).cast("int").alias("low_months"),
        F.percentile("net", F.lit(0.5)).alias("household_median"), F.sum("net").alias("annual_total"), F.avg("net").alias("annual_average"), F.stddev_pop("net").alias("annual_std"),
        F.min("net").alias("annual_min"), F.max("net").alias("annual_max"),
        F.max_by("MONTH", F.struct(F.col("net"), -F.col("MONTH"))).alias("peak_month"))
    return out.select("account_id", "ACCOUNT_NO", *[F.col(f"_a.{c}").alias(c) for c in ACCOUNT_ATTRIBUTES],
                      *[c for c in out.columns if c not in ("account_id", "ACCOUNT_NO", "_a")])


def profiles_by_tariff(profiles: DataFrame, tariff: str) -> DataFrame:
    return profiles.where(F.col("CAL_TARIFF") == tariff)


def dataset_statistics(readings: DataFrame) -> DataFrame:
    """One row: counts, month range, moments, the exact median and the readings of every tariff.

    Distinct accounts and transformers are counted among the few rows that readings fold to, one for each account, transformer
    and tariff."""
    net = F.col("NET_CONSUMPTION_kWh")
    folded = readings.groupBy("ACCOUNT_NO", "TRANSFORMER_CODE", "CAL_TARIFF").agg(F.count(F.lit(1)).alias("n"))
    tariffs = folded.groupBy("CAL_TARIFF").agg(F.sum("n").alias("n"))
    # accounts may have several tariffs and transformers, so they are told apart once more
    accounts = folded.groupBy("ACCOUNT_NO").agg(F.count(F.lit(1)).alias("k")).agg(F.count("ACCOUNT_NO").alias("a")).scalar()
    transformers = folded.groupBy("TRANSFORMER_CODE").agg(F.count(F.lit(1)).alias("k")).agg(F.count("TRANSFORMER_CODE").alias("a")).scalar()
    known = tariffs.where(F.col("CAL_TARIFF").isNotNull())
    spread = known.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("CAL_TARIFF", "n")))).alias("m")).scalar()
    head = readings.agg(
        F.count(F.lit(1)).alias("total_records"), F.min("MONTH").alias("month_min"), F.max("MONTH").alias("month_max"), F.avg(net).alias("mean_kwh"), F.stddev_samp(net).alias("std_kwh"),
        F.min(net).alias("min_kwh"), F.max(net).alias("max_kwh"), F.sum("HAS_SOLAR").alias("solar_records"))
    median = exact_quantiles(readings, [], "NET_CONSUMPTION_kWh", {"m": 0.5}).select("m").scalar()
    return head.withColumns({"unique_accounts": accounts, "unique_transformers": transformers, "tariff_distribution": spread, "median_kwh": median})


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Counts with percentages; the total is taken over the few distinct values, not the rows."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("t")).scalar()
    return counts.withColumn("pct", F.col("n") / total * 100)


def month_iqr_bounds(df: DataFrame, value: str = "EXPORT_kWh", threshold: float = 1.5, month: str = "MONTH") -> DataFrame:
    """Lower and upper bound per month, fitted exactly on any number of rows."""
    q = exact_quantiles(df, [month], value, {"q1": 0.25, "q3": 0.75})
    spread = threshold * (F.col("q3") - F.col("q1"))
    return q.select(month, "q1", "q3", (F.col("q1") - spread).alias("lower_bound"), (F.col("q3") + spread).alias("upper_bound"))


def drop_month_outliers(df: DataFrame, bounds: DataFrame, value: str = "EXPORT_kWh", month: str = "MONTH") -> DataFrame:
    """Rows within the bounds of their month; months without bounds are kept.

    How ``bounds``, one row per month, is joined is left to the optimizer, which sees its size at run time.
    """
    b = bounds.select(month, "lower_bound", "upper_bound")
    keep = F.col("lower_bound").isNull() | F.col(value).isNull() | F.col(value).between(F.col("lower_bound"), F.col("upper_bound"))
    return df.join(b, month, "left").where(keep).drop("lower_bound", "upper_bound")


def month_outlier_counts(df: DataFrame, bounds: DataFrame, value: str = "EXPORT_kWh", month: str = "MONTH") -> DataFrame:
    b = bounds.select(month, "lower_bound", "upper_bound")
    out = ~F.col(value).between(F.col("lower_bound"), F.col("upper_bound"))
    return df.join(b, month, "left").groupBy(month).agg(F.count(F.lit(1)).alias("n"), F.count_if(out).alias("removed"))


def transformer_summary(readings: DataFrame, transformers: DataFrame) -> DataFrame:
    """Connections, headroom in connections and solar share per transformer."""
    accounts = readings.groupBy("TRANSFORMER_CODE", "ACCOUNT_NO").agg(F.max("HAS_SOLAR").alias("s"))
    per_tf = accounts.groupBy("TRANSFORMER_CODE").agg(F.count(F.lit(1)).alias("c"), F.sum("s").alias("s"))
    conn, solar = F.coalesce("c", F.lit(0)), F.coalesce("s", F.lit(0))
    return transformers.join(per_tf, "TRANSFORMER_CODE", "left").select(
        "TRANSFORMER_CODE", F.col("TRANSFORMER_LAT").alias("LATITUDE"), F.col("TRANSFORMER_LON").alias("LONGITUDE"),
        "DESCRIPTION", "MAX_CAPACITY", conn.alias("CURRENT_CONNECTIONS"), (F.col("MAX_CAPACITY") - conn).alias("HEADROOM"),
        solar.alias("SOLAR_ACCOUNTS"), F.round(safe_divide(solar * 100.0, conn) + 1e-7, 1).alias("SOLAR_PERCENTAGE"))


def grand_totals(summary: DataFrame) -> DataFrame:
    return summary.agg(F.count(F.lit(1)).alias("transformers"), F.sum("CURRENT_CONNECTIONS").alias("connections"),
                       F.sum("SOLAR_ACCOUNTS").alias("solar_accounts"), F.sum("HEADROOM").alias("headroom"))


def solar_penetration(readings: DataFrame, source: str = "DATA_QUALITY") -> DataFrame:
    accounts = readings.groupBy(source, "ACCOUNT_NO").agg(F.max("HAS_SOLAR").alias("s"))
    return accounts.groupBy(source).agg(
        F.count(F.lit(1)).alias("accounts"), F.sum("s").alias("solar_accounts"),
        (F.sum("s") / F.count(F.lit(1)) * 100).alias("solar_pct"))


def distance_zones(readings: DataFrame) -> DataFrame:
    zones = right_closed_bin(F.col("DISTANCE_FROM_TF_M"), *DISTANCE_ZONES)
    return value_counts(with_distance(readings).withColumn("zone", zones), "zone")


def reconciliation_summary(readings: DataFrame) -> DataFrame:
    per_account = with_distance(readings).groupBy("TRANSFORMER_CODE", "ACCOUNT_NO").agg(
        F.max("HAS_SOLAR").alias("s"), F.count_if(F.col("DATA_QUALITY") == "REAL").alias("r"),
        F.count_if(F.col("DATA_QUALITY") != "REAL").alias("f"), F.count(F.lit(1)).alias("n"),
        F.sum("DISTANCE_FROM_TF_M").alias("d"), F.max("DISTANCE_FROM_TF_M").alias("dm"))
    return per_account.groupBy("TRANSFORMER_CODE").agg(
        F.count(F.lit(1)).alias("accounts"), F.sum("s").alias("solar_accounts"), F.sum("r").alias("real_records"),
        F.sum("f").alias("filled_records"), F.sum("n").alias("total_records"),
        (F.sum("d") / F.sum("n")).alias("avg_distance_m"), F.max("dm").alias("max_distance_m"))


def real_patterns(readings: DataFrame) -> DataFrame:
    solar = F.col("HAS_SOLAR") == 1
    return readings.groupBy("TRANSFORMER_CODE").agg(
        (F.avg("HAS_SOLAR") * 100).alias("solar_percentage"), F.avg("NET_CONSUMPTION_kWh").alias("avg_consumption"),
        F.stddev_samp("NET_CONSUMPTION_kWh").alias("std_consumption"),
        F.coalesce(F.avg(F.when(solar, F.col("EXPORT_kWh"))), F.lit(0.0)).alias("avg_export"))
