"""Solar physics features and weather unit conversions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gridlight import constants as C
from gridlight.functions.numeric import clip, lookup


def temp_efficiency(temperature: Column) -> Column:
    return F.round(1 + (temperature - C.TEMP_REFERENCE) * C.TEMP_COEFFICIENT, 3)


def cloud_factor(ghi: Column, clear_sky: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(ghi, F.nullif(clear_sky, F.lit(0.0))), F.lit(1.0)), 2)


def physics_yield(ghi: Column, days: Column) -> Column:
    """kWh per installed kW."""
    return ghi * C.PERFORMANCE_RATIO * days


def kelvin_to_celsius(k: Column) -> Column:
    return F.round(k - 273.15, 2)


def relative_humidity(dewpoint_c: Column, temperature_c: Column) -> Column:
    """Magnus formula, capped at 100 %."""
    def vapour(t):
        return F.exp(17.625 * t / (243.04 + t))
    return F.round(F.least(100 * vapour(dewpoint_c) / vapour(temperature_c), F.lit(100.0)), 1)


def irradiance_kwh_per_day(watts_per_m2: Column) -> Column:
    return F.round(watts_per_m2 * 86400 / 3_600_000, 3)


def rain_mm_per_day(metres: Column, days: Column) -> Column:
    return F.round(metres * 1000 / days, 3)


def wind_speed(u: Column, v: Column) -> Column:
    return F.round(F.sqrt(u * u + v * v), 2)


def heat_index(temperature: Column, humidity: Column) -> Column:
    return temperature + 0.1 * humidity


def static_climate(month: Column) -> dict[str, Column]:
    """Month values used where no weather row exists."""
    return {"Temperature": lookup(month, C.STATIC_TEMPERATURE), "Humidity": lookup(month, C.STATIC_HUMIDITY),
            "Precipitation": lookup(month, C.STATIC_RAINFALL)}


def generation_band(efficiency: Column, size_kw: Column, tariff: float = C.NET_PLUS_TARIFF,
                    mae_per_kw: float = C.MAE_KWH_PER_KW) -> dict[str, Column]:
    """kWh, band, confidence and income of a month from its kWh per kW."""
    kwh = F.greatest(efficiency, F.lit(0.0)) * size_kw
    margin = mae_per_kw * size_kw
    confidence = F.when(kwh > 0, clip(1 - F.try_divide(margin, kwh), 0.0, 1.0) * 100).otherwise(0.0)
    return {"Predicted_Export_kWh": kwh, "Lower_kWh": F.greatest(kwh - margin, F.lit(0.0)),
            "Upper_kWh": kwh + margin, "Confidence_Pct": confidence, "Estimated_Income_LKR": kwh * tariff}
