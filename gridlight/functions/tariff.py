"""Increasing-block bills as column expressions.

A schedule is a small mapping (see ``constants.TARIFFS``); every charge is an
unrolled sum over its blocks, so a bill is arithmetic inside code generation
and needs no join, whatever the number of readings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from gridlight import constants as C
from gridlight.functions.numeric import safe_divide


def _sized_blocks(blocks, inclusive: bool) -> list[tuple[str, float, float, float]]:
    """(range label, kWh below the block, block size, rate).

    ``inclusive`` counts both ends of a block (the first then holds 31 kWh of 0-30).
    """
    out, below = [], 0.0
    for lo, hi, rate in blocks:
        size = float(hi - lo + 1) if inclusive or lo > 0 else float(hi - lo)
        out.append((f"{lo}-{hi}", below, size, float(rate)))
        below += size
    return out


def _charge(kwh: Column, sized) -> Column:
    parts = [F.greatest(F.lit(0.0), F.least(kwh - below, F.lit(size))) * rate for _, below, size, rate in sized]
    return reduce(lambda a, b: a + b, parts)


def _per_tariff(tariff: Column, value_of, schedules: dict) -> Column:
    """CASE over the tariff codes; an unknown code falls back to the default tariff."""
    code = F.upper(tariff)
    out = None
    for name, spec in schedules.items():
        if name == C.DEFAULT_TARIFF:
            continue
        out = F.when(code == name, value_of(spec)) if out is None else out.when(code == name, value_of(spec))
    default = value_of(schedules[C.DEFAULT_TARIFF])
    return default if out is None else out.otherwise(default)


def energy_charge(kwh: Column, tariff: Column, schedules: dict = C.TARIFFS, inclusive_blocks: bool = True) -> Column:
    """Energy charge; kWh above the last block are not billed."""
    return _per_tariff(tariff, lambda s: _charge(kwh, _sized_blocks(s["blocks"], inclusive_blocks)), schedules)


def sized_charge(kwh: Column, blocks: list[tuple[float, float]]) -> Column:
    """Energy charge over (size, rate) blocks given in order."""
    below, sized = 0.0, []
    for size, rate in blocks:
        sized.append(("", below, float(size), float(rate)))
        below += size
    return _charge(kwh, sized)


def block_details(kwh: Column, tariff: Column, schedules: dict = C.TARIFFS, inclusive_blocks: bool = True) -> Column:
    """Array of (block_range, kwh_in_block, rate, charge) for the blocks in use."""
    def rows(spec):
        items = []
        for label, below, size, rate in _sized_blocks(spec["blocks"], inclusive_blocks):
            used = F.greatest(F.lit(0.0), F.least(kwh - below, F.lit(size)))
            items.append(F.struct(F.lit(label).alias("block_range"), used.alias("kwh_in_block"),
                                  F.lit(rate).alias("rate"), (used * rate).alias("charge")))
        return F.array(*items)
    return F.filter(_per_tariff(tariff, rows, schedules), lambda b: b["kwh_in_block"] > 0)


def scalar_of(tariff: Column, name: str, schedules: dict = C.TARIFFS) -> Column:
    return _per_tariff(tariff, lambda s: F.lit(float(s[name])), schedules)


def highest_block_rate(tariff: Column, schedules: dict = C.TARIFFS) -> Column:
    return _per_tariff(tariff, lambda s: F.lit(float(max(b[2] for b in s["blocks"]))), schedules)


def fixed_charge(tariff: Column, schedules: dict = C.TARIFFS) -> Column:
    return scalar_of(tariff, "fixed_charge", schedules)


def bill(kwh: Column, tariff: Column, schedules: dict = C.TARIFFS, inclusive_blocks: bool = True) -> dict[str, Column]:
    """Unrounded bill parts."""
    energy = energy_charge(kwh, tariff, schedules, inclusive_blocks)
    fixed = fixed_charge(tariff, schedules)
    fuel = energy * scalar_of(tariff, "fuel_adjustment", schedules)
    subtotal = energy + fixed + fuel
    vat = subtotal * scalar_of(tariff, "vat_rate", schedules)
    total = subtotal + vat
    return {"energy_charge_lkr": energy, "fixed_charge_lkr": fixed, "fuel_adjustment_lkr": fuel,
            "subtotal_lkr": subtotal, "vat_lkr": vat, "total_bill_lkr": total,
            "effective_rate_lkr_per_kwh": F.when(kwh > 0, safe_divide(total, kwh)).otherwise(0.0)}


def dashboard_bill(kwh: Column) -> Column:
    """Quick bill: thirty-kWh blocks, fixed charge and VAT, whole rupees, no fuel adjustment."""
    return F.bround((sized_charge(kwh, C.DASHBOARD_BLOCKS) + 180.0) * 1.18, 0)


def money(x: Column, places: int = 2) -> Column:
    """Round half up with a small lift, so that binary noise below a tie does not decide."""
    return F.round(x + 1e-7, places)


def export_tariff(size_kw: Column) -> Column:
    return F.when(size_kw <= 5, C.EXPORT_TARIFF_UNDER_5).otherwise(C.EXPORT_TARIFF_OVER_5)
