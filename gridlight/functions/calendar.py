"""Months, seasons and cyclic encodings as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from gridlight import constants as C
from gridlight.functions.numeric import lookup


def encode_cyclic(x: Column, period: float, offset: float = 0.0) -> tuple[Column, Column]:
    """Sine and cosine of ``2*pi*(x - offset)/period``."""
    angle = (x - offset) * (2 * math.pi) / period
    return F.sin(angle), F.cos(angle)


def decode_month(sin: Column, cos: Column) -> Column:
    """Inverse of the month encoding with offset 1 (rounded, not truncated)."""
    step = F.round(F.atan2(sin, cos) * 12 / (2 * math.pi)).cast("int")
    return F.pmod(step, F.lit(12)) + 1


def cyclic_features(month: Column | None = None, day_of_week: Column | None = None, hour: Column | None = None,
                    day: Column | None = None, week: Column | None = None, quarter: Column | None = None
                    ) -> dict[str, Column]:
    """All encoders for the parts given, named ``<part>_sin`` / ``<part>_cos``."""
    parts = [("month", month, 12, 1), ("dow", day_of_week, 7, 0), ("hour", hour, 24, 0),
             ("dom", day, 30, 1), ("week", week, 52, 1), ("quarter", quarter, 4, 1)]
    out = {}
    for name, col, period, offset in parts:
        if col is not None:
            out[f"{name}_sin"], out[f"{name}_cos"] = encode_cyclic(col, period, offset)
    return out


def quarter_of(month: Column) -> Column:
    return (F.floor((month - 1) / 3) + 1).cast("int")


def days_in_month(month: Column) -> Column:
    return lookup(month, C.DAYS_IN_MONTH)


def month_name(month: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(m) for m in C.MONTH_NAMES]), month - 1),
                      F.concat(F.lit("Month "), month.cast("string")))


def month_abbr(month: Column) -> Column:
    return F.get(F.array(*[F.lit(m) for m in C.MONTH_ABBR]), month - 1)


def season(month: Column) -> Column:
    return (F.when(month.isin(12, 1, 2), "NE Monsoon").when(month.isin(3, 4), "Dry Season")
            .when(month.between(5, 9), "SW Monsoon").otherwise("Dry Season"))


def validation_season(month: Column) -> Column:
    return (F.when(month.isin(12, 1, 2), "NE_Monsoon").when(month.isin(3, 4), "Dry_Season")
            .when(month.between(5, 9), "SW_Monsoon").otherwise("Inter_Monsoon"))


def season_band(month: Column) -> Column:
    """Peak / low / normal band of the monthly ranking."""
    return F.when(month.isin(2, 3, 4, 12), "peak").when(month.isin(6, 7, 8), "low").otherwise("normal")


def season_flags(month: Column, serving: bool = False) -> dict[str, Column]:
    """0/1 season and holiday flags; ``serving`` picks the serving definition of wet / intermediate."""
    wet = C.SERVING_WET_MONTHS if serving else C.WET_MONTHS
    mid = C.SERVING_INTERMEDIATE_MONTHS if serving else C.INTERMEDIATE_MONTHS
    sets = {"is_dry_season": C.DRY_MONTHS, "is_wet_season": wet, "is_intermediate": mid,
            "is_holiday_month": C.HOLIDAY_MONTHS, "is_pre_holiday": C.PRE_HOLIDAY_MONTHS,
            "is_post_holiday": C.POST_HOLIDAY_MONTHS}
    return {name: month.isin(months).cast("int") for name, months in sets.items()}


def time_index(year: Column, month: Column) -> Column:
    return year * 12 + month


def add_months(year: Column, month: Column, step: Column) -> tuple[Column, Column]:
    """Year and month ``step`` months later."""
    idx = year * 12 + (month - 1) + step
    return F.floor(idx / 12).cast("int"), (F.pmod(idx, F.lit(12)) + 1).cast("int")


def lead_time(init_year: Column, init_month: Column, year: Column, month: Column) -> Column:
    return (year - init_year) * 12 + (month - init_month)


def circular_month_distance(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.least(d, 12 - d)
