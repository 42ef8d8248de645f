"""Filters, coercions and fills over meter readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gridlight import constants as C
from gridlight.functions.geo import in_bounds
from gridlight.functions.numeric import all_of, null_sentinel
from gridlight.operators.ordered import exact_quantiles


def strip_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def resolve_columns(df: DataFrame, wanted: dict[str, tuple[list[str], object]]) -> DataFrame:
    """Select columns by the words their headers hold.

    ``wanted`` maps a target name to (words, default): the first header that holds
    every word (any case) is taken, else the default literal.
    """
    cols = []
    for name, (words, default) in wanted.items():
        hit = next((c for c in df.columns if all(w.lower() in c.lower() for w in words)), None)
        cols.append((F.col(f"`{hit}`") if hit is not None else F.lit(default)).alias(name))
    return df.select(*cols)


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Text to double; whatever does not parse, and NaN, becomes null."""
    def num(c):
        x = F.expr(f"try_cast(`{c}` AS DOUBLE)")
        return F.when(~F.isnan(x), x)
    return df.withColumns({c: num(c) for c in cols})


def trim_strings(df: DataFrame) -> DataFrame:
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.trim(F.col(c)) for c in names})


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def solar_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("HAS_SOLAR") == 1).drop("HAS_SOLAR")


def within_bounds(df: DataFrame, lat: str = "CUSTOMER_LAT", lon: str = "CUSTOMER_LON", box: dict = C.BOUNDS) -> DataFrame:
    return df.where(in_bounds(F.col(lat), F.col(lon), box))


def plausible_range(df: DataFrame, col: str = "NET_CONSUMPTION_kWh", lo: float = C.MIN_NET_KWH,
                    hi: float = C.MAX_NET_KWH) -> DataFrame:
    return df.where(F.col(col).between(lo, hi))


def residential_only(df: DataFrame, max_kw: float = C.RESIDENTIAL_MAX_KW) -> DataFrame:
    return df.where(F.col("INV_CAPACITY") <= max_kw)


def sentinels_to_null(df: DataFrame, limit: float = C.SENTINEL_LIMIT) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: null_sentinel(F.col(c), limit) for c in doubles})


def drop_listed(df: DataFrame, cols: list[str] = C.SOLAR_DROP_COLUMNS) -> DataFrame:
    return df.drop(*cols)


def in_months(df: DataFrame, months: list[int], col: str = "MONTH") -> DataFrame:
    return df.where(F.col(col).isin(months))


def reading_sanity(df: DataFrame) -> DataFrame:
    """Implausible imports and exports become null with quality CAPPED; no solar means no export."""
    capped = (F.col("IMPORT_kWh") > C.MAX_IMPORT_KWH) | (F.col("EXPORT_kWh") > C.MAX_EXPORT_KWH)
    imp = F.when(F.col("IMPORT_kWh") <= C.MAX_IMPORT_KWH, F.col("IMPORT_kWh"))
    exp = F.when(F.col("HAS_SOLAR") == 0, 0.0).when(F.col("EXPORT_kWh") <= C.MAX_EXPORT_KWH, F.col("EXPORT_kWh"))
    out = df.withColumns({"IMPORT_kWh": imp, "EXPORT_kWh": exp,
                          "DATA_QUALITY": F.when(capped, "CAPPED").otherwise(F.col("DATA_QUALITY"))})
    return out.withColumn("NET_CONSUMPTION_kWh", F.col("IMPORT_kWh") - F.col("EXPORT_kWh"))


def fill_with_statistics(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Null numerics take the column's median (0 if there is none), null strings the most frequent value."""
    if numeric:
        long = df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in numeric])).alias("e")
        ).select("e.name", "e.x")
        medians = exact_quantiles(long, ["name"], "x", {"median": 0.5})
        stats = medians.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("name", "median"))).alias("m"))
        found = stats.scalar()                      # one map with one entry per column
        df = df.withColumn("_medians", found)
        df = df.withColumns({c: F.coalesce(F.col(c), F.try_element_at(F.col("_medians"), F.lit(c)), F.lit(0.0))
                             for c in numeric}).drop("_medians")
    for c in categorical:
        counts = df.where(F.col(c).isNotNull()).groupBy(c).count()
        mode = counts.agg(F.max_by(F.col(c), F.struct(F.col("count"), F.col(c))))
        df = df.withColumn(c, F.coalesce(F.col(c), mode.scalar(), F.lit("unknown")))
    return df


def impute_irradiance(df: DataFrame, history: DataFrame, start_year: int, end_year: int,
                      months: list[int] = C.GHI_IMPUTE_MONTHS, cols: tuple[str, ...] = ("Solar_Irradiance_GHI", "Clear_Sky_GHI"),
                      site: str = "SITE_ID") -> DataFrame:
    """Overwrite the listed months with the site's multi-year mean, if any irradiance is missing at all.

    The means are one row per site and listed month.
    """
    means = (history.where(F.col("Month").isin(months) & F.col("Year").between(start_year, end_year))
             .groupBy(site, "Month").agg(*[F.round(F.avg(c) + 1e-7, 2).alias(f"_mean_{c}") for c in cols]))
    any_missing = df.agg(F.max(F.when(F.greatest(*[F.col(c).isNull() for c in cols]), 1).otherwise(0))).scalar()
    joined = df.join(means, [site, "Month"], "left").withColumn("_any", any_missing)
    fill = (F.col("_any") == 1) & F.col("Month").isin(months)
    return joined.withColumns({c: F.when(fill & F.col(f"_mean_{c}").isNotNull(), F.col(f"_mean_{c}")).otherwise(F.col(c))
                               for c in cols}).drop("_any", *[f"_mean_{c}" for c in cols])


def household_outlier_filter(df: DataFrame, account: str = "account_id", value: str = "NET_CONSUMPTION_kWh") -> DataFrame:
    """Keep 10..2000 kWh and 0.3..3 times the household's median (a household is a few dozen months)."""
    med = F.expr(f"percentile({value}, 0.5)").over(Window.partitionBy(account))
    return (df.withColumn("household_median", med)
            .where(F.col(value).between(C.MIN_NET_KWH, C.MAX_NET_KWH)
                   & F.col(value).between(0.3 * F.col("household_median"), 3.0 * F.col("household_median"))))


def validate_requests(df: DataFrame) -> DataFrame:
    """Adds defaults and an ``errors`` array to forecast requests (empty array = accepted).

    Expects latitude, longitude, consumption_months (map of month to kWh) and the
    optional tariff, phase, has_solar, household_size.
    """
    defaults = {"tariff": C.DEFAULT_TARIFF, "phase": "SP", "has_solar": 0, "household_size": 4}
    for c, d in defaults.items():
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(d)) if c in df.columns else F.lit(d))
    months, kwh = F.map_keys("consumption_months"), F.map_values("consumption_months")
    lat, lon = F.col("latitude"), F.col("longitude")
    checks = [
        (lat.isNull(), "Missing required field: latitude"),
        (lon.isNull(), "Missing required field: longitude"),
        (~lat.between(C.BOUNDS["lat_min"], C.BOUNDS["lat_max"]), "latitude out of range"),
        (~lon.between(C.BOUNDS["lon_min"], C.BOUNDS["lon_max"]), "longitude out of range"),
        (F.exists(months, lambda m: (m < 1) | (m > 12)), "month out of range"),
        (F.exists(kwh, lambda k: (k < 0) | (k > C.MAX_NET_KWH)), "consumption out of range"),
        (F.size("consumption_months") < 2, "at least 2 months required"),
        (~F.col("tariff").isin(C.VALID_TARIFFS), "invalid tariff"),
        (~F.col("phase").isin(C.VALID_PHASES), "invalid phase"),
    ]
    return df.withColumn("errors", F.array_compact(F.array(*[F.when(c, m) for c, m in checks])))


def split_requests(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    return validated.where(F.size("errors") == 0), validated.where(F.size("errors") > 0)
