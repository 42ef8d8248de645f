"""Data-quality report, its history and advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridlight import constants as C
from gridlight.functions import numeric as N
from gridlight.operators.clean import numeric_columns
from gridlight.operators.ordered import exact_quantiles, known, same


def _long(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """(by, name, x) rows of the numeric columns; a narrow step, no shuffle."""
    items = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in cols])
    return df.select(*by, F.explode(items).alias("e")).select(*by, "e.name", "e.x")


def missing_report(df: DataFrame, by: list[str] | None = None, cols: list[str] | None = None) -> DataFrame:
    """Missing count and percentage per column: one aggregate over the rows, unpivoted afterwards."""
    by = by or []
    cols = cols or [c for c in df.columns if c not in by]
    wide = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"_m{i}") for i, c in enumerate(cols)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_m{i}").alias("missing")) for i, c in enumerate(cols)])
    return wide.select(*by, "_n", F.inline(rows)).select(*by, "column", "missing", (F.col("missing") / F.col("_n") * 100).alias("pct"))


def outlier_report(df: DataFrame, by: list[str] | None = None, cols: list[str] | None = None, spread: float = 3.0) -> DataFrame:
    """Values beyond ``spread`` IQRs per numeric column.

    The bounds, one row per group and column, meet the readings where these are, and only counts are exchanged.
    """
    by = by or []
    cols = cols or [c for c in numeric_columns(df) if c not in by]
    long = _long(df, by, cols).where(F.col("x").isNotNull())
    q = exact_quantiles(long, [*by, "name"], "x", {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    bounds = known(q.select(*by, "name", (F.col("q1") - spread * iqr).alias("lo"), (F.col("q3") + spread * iqr).alias("hi")))
    hit = (F.col("x") < F.col("lo")) | (F.col("x") > F.col("hi"))
    return same(long, bounds, [*by, "name"]).groupBy(*by, F.col("name").alias("column")).agg(F.count_if(hit).alias("outliers"))


def sign_counts(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    net = F.col("NET_CONSUMPTION_kWh")
    return df.groupBy(*(by or [])).agg(F.count_if((net == 0) & (F.col("HAS_SOLAR") == 0)).alias("zero_months"), F.count_if(net < 0).alias("negative_months"))


def seasonal_consistency(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Score from the ranks of April and October (high) and July and August (low) among the month means.

    A group has at most twelve month means, so the average-tie ranks are counted
    inside one small array.
    """
    by = by or []
    return _seasonal_score(df.groupBy(*by, "MONTH").agg(F.avg("NET_CONSUMPTION_kWh").alias("m")), by)


def _seasonal_score(means: DataFrame, by: list[str]) -> DataFrame:
    maps = means.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("MONTH", "m"))).alias("means"))

    def rank(month: int, descending: bool) -> Column:
        v = F.try_element_at("means", F.lit(month))
        values = F.map_values("means")
        before = F.filter(values, (lambda x: x > v) if descending else (lambda x: x < v))
        ties = F.filter(values, lambda x: x == v)
        return F.when(v.isNull(), F.lit(6.0)).otherwise(F.size(before) + (F.size(ties) + 1) / 2.0)

    score = (((13 - rank(4, True)) + (13 - rank(10, True))) / 24 + ((13 - rank(7, False)) + (13 - rank(8, False))) / 24) / 2
    return maps.select(*by, score.alias("seasonal_score"))


def completeness(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of accounts with all twelve months."""
    by = by or []
    months = df.select(*by, "account_id", "MONTH").distinct().groupBy(*by, "account_id").agg(F.count(F.lit(1)).alias("k"))
    return months.groupBy(*by).agg(F.avg((F.col("k") == 12).cast("int")).alias("completeness"))


def quality_report(df: DataFrame, by: list[str]) -> DataFrame:
    """One row per group: counts, scores, issue list and overall score in 0.1..1.

    ``by`` names the run (a load date, a year); reports of all runs come out of one plan.
    """
    numeric = [c for c in numeric_columns(df) if c not in by and c != "account_id"]
    columns = [c for c in df.columns if c not in by]
    bad_lat, bad_lon = ~F.col("CUSTOMER_LAT").between(C.BOUNDS["lat_min"], C.BOUNDS["lat_max"]), ~F.col("CUSTOMER_LON").between(C.BOUNDS["lon_min"], C.BOUNDS["lon_max"])
    net = F.col("NET_CONSUMPTION_kWh")
    # every count that needs no account comes out of one aggregate with tiny map-side results
    head = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_records"), (F.count_if(bad_lat) + F.count_if(bad_lon)).alias("invalid_locations"),
        F.count_if(~F.col("CAL_TARIFF").isin(C.VALID_TARIFFS)).alias("invalid_tariffs"),
        F.count_if((net == 0) & (F.col("HAS_SOLAR") == 0)).alias("zero_months"), F.count_if(net < 0).alias("negative_months"),
        *[F.count_if(F.col(c).isNull()).alias(f"_m{i}") for i, c in enumerate(columns)])
    gaps = F.filter(F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"_m{i}").alias("value")) for i, c in enumerate(columns)]), lambda e: e["value"] > 0)
    head = head.withColumn("missing_values", F.map_from_entries(F.array_sort(gaps))).drop(*[f"_m{i}" for i in range(len(columns))])
    # account months once, for completeness, distinct accounts and month means
    cells = df.groupBy(*by, "account_id", "MONTH").agg(F.sum(net).alias("s"), F.count(net).alias("k"))
    accounts = cells.groupBy(*by, "account_id").agg(F.count(F.lit(1)).alias("months")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("unique_accounts"), F.avg((F.col("months") == 12).cast("int")).alias("completeness"))
    means = cells.groupBy(*by, "MONTH").agg((F.sum("s") / F.sum("k")).alias("m"))
    entries = lambda name, value: F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, value))))
    outliers = outlier_report(df, by, numeric).where("outliers > 0").groupBy(*by).agg(entries("column", "outliers").alias("outlier_counts"))
    out = head.join(accounts, by).join(_seasonal_score(means, by), by).join(outliers, by, "left")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    out = out.withColumn("outlier_counts", F.coalesce("outlier_counts", empty))
    n = F.col("total_records")
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("bigint"), lambda a, x: a + x)
    heavy = F.filter(F.map_entries("outlier_counts"), lambda e: e["value"] > n * 0.01)
    text = lambda fmt, *cols: F.format_string(fmt, *cols)
    flags = [(F.col("zero_months") > 0, text("Zero consumption records: %d", F.col("zero_months")), 0.05 * F.col("zero_months") / n),
             (F.col("negative_months") > 0, text("Negative consumption records: %d", F.col("negative_months")), 0.1 * F.col("negative_months") / n),
             (F.col("seasonal_score") < 0.7, text("Low seasonal consistency: %.2f", F.col("seasonal_score")), F.lit(0.1)),
             (F.col("completeness") < 0.8, text("Low data completeness: %.2f", F.col("completeness")), F.lit(0.1)),
             (F.col("invalid_locations") > 0, text("Invalid locations: %d", F.col("invalid_locations")), F.lit(0.05)),
             (F.col("invalid_tariffs") > 0, text("Invalid tariffs: %d", F.col("invalid_tariffs")), F.lit(0.05))]
    issues = F.concat(
        F.transform(F.map_entries("missing_values"), lambda e: text("Missing values in %s: %d", e["key"], e["value"])),
        F.transform(heavy, lambda e: text("High outliers in %s: %d", e["key"], e["value"])),
        F.array_compact(F.array(*[F.when(c, t) for c, t, _ in flags])))
    score = 1.0 - 0.05 * total("missing_values") / n - 0.1 * F.size(heavy)
    for cond, _, penalty in flags:
        score = score - F.when(cond, penalty).otherwise(0.0)
    return out.withColumns({"quality_issues": issues, "overall_score": N.clip(score, 0.1, 1.0)})


def quality_trend(history: DataFrame, run: str, by: list[str] | None = None) -> DataFrame:
    """Trend of the score over the runs."""
    slope = F.regr_slope(F.col("overall_score"), F.col(run))
    return history.groupBy(*(by or [])).agg(
        slope.alias("slope"), F.max_by("overall_score", run).alias("current_score"), F.min("overall_score").alias("min_score"),
        F.max("overall_score").alias("max_score"), F.stddev_pop("overall_score").alias("volatility"), F.count(F.lit(1)).alias("runs")
    ).withColumn("trend", F.when(F.col("runs") < 2, "insufficient_data").when(F.col("slope") > 0.01, "improving")
                 .when(F.col("slope") < -0.01, "degrading").otherwise("stable"))


def quality_advice(report: DataFrame) -> DataFrame:
    has = lambda words: F.exists("quality_issues", lambda i: i.contains(words))
    advice = F.array_compact(F.array(
        F.when(F.col("overall_score") < 0.5, "URGENT: Major data quality issues - investigate immediately"),
        F.when(has("Missing values"), "Address missing values through imputation or filtering"),
        F.when(has("outliers"), "Review outlier handling - consider robust scaling"),
        F.when(has("Zero consumption"), "Investigate zero consumption records - possible meter issues"),
        F.when(has("seasonal consistency"), "Seasonal patterns deviate from expectations - review data source")))
    return report.withColumn("recommendations", F.when(F.size(advice) > 0, advice).otherwise(
        F.array(F.lit("Data quality acceptable - continue monitoring"))))
