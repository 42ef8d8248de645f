"""Display strings, masks, keys and column-name matching."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def format_currency(x: Column) -> Column:
    return (F.when(x >= 1_000_000, F.format_string("Rs. %.2fM", x / 1_000_000))
            .when(x >= 1_000, F.format_string("Rs. %.1fK", x / 1_000))
            .otherwise(F.concat(F.lit("Rs. "), F.format_number(x, 0))))


def format_consumption(kwh: Column) -> Column:
    return (F.when(kwh >= 1000, F.format_string("%.1f MWh", kwh / 1000))
            .otherwise(F.concat(F.format_number(kwh, 0), F.lit(" kWh"))))


def mask_account(account: Column) -> Column:
    return F.concat(F.substring(account, 1, 8), F.lit("..."))


def request_key(*cols: Column) -> Column:
    """md5 of a canonical JSON of the request fields."""
    return F.md5(F.to_json(F.struct(*cols)))
