"""Monthly and annual bills, and the net-metering credit ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridlight import constants as C
from gridlight.functions import tariff as TF


def monthly_bills(readings: DataFrame, kwh: str = "NET_CONSUMPTION_kWh", tariff: str = "CAL_TARIFF",
                  schedules: dict = C.TARIFFS, inclusive_blocks: bool = True) -> DataFrame:
    """Adds the bill parts, rounded to cents."""
    parts = TF.bill(F.col(kwh), F.col(tariff), schedules, inclusive_blocks)
    return readings.withColumns({name: TF.money(col) for name, col in parts.items()})


def bill_details(readings: DataFrame, keys: list[str], kwh: str = "NET_CONSUMPTION_kWh",
                 tariff: str = "CAL_TARIFF") -> DataFrame:
    """One row per reading and block in use."""
    details = TF.block_details(F.col(kwh), F.col(tariff))
    return (readings.select(*keys, F.posexplode(details).alias("pos", "b"))
            .select(*keys, (F.col("pos") + 1).alias("block_no"), "b.block_range",
                    TF.money(F.col("b.kwh_in_block")).alias("kwh_in_block"), F.col("b.rate").alias("rate"),
                    TF.money(F.col("b.charge")).alias("charge")))


def annual_bills(bills: DataFrame, keys: list[str], kwh: str = "NET_CONSUMPTION_kWh") -> DataFrame:
    """Sums of the rounded monthly parts with twelve-month averages and the effective rate."""
    total, used = F.sum("total_bill_lkr"), F.sum(kwh)
    return bills.groupBy(*keys).agg(
        used.alias("total_consumption_kwh"),
        F.sum("energy_charge_lkr").alias("total_energy_charge_lkr"),
        F.sum("fixed_charge_lkr").alias("total_fixed_charge_lkr"),
        F.sum("fuel_adjustment_lkr").alias("total_fuel_adjustment_lkr"),
        F.sum("vat_lkr").alias("total_vat_lkr"), total.alias("total_bill_lkr"),
        (used / 12).alias("monthly_average_consumption_kwh"), (total / 12).alias("monthly_average_bill_lkr"),
        F.when(used > 0, F.try_divide(total, used)).otherwise(0.0).alias("effective_rate_lkr_per_kwh"))


LEDGER_ROW = ("month int, consumption_kwh double, generation_kwh double, net_kwh double, bill_lkr double, "
              "credit_earned double, credits_used double, credit_balance double")


def net_metering_ledger(readings: DataFrame, keys: list[str], consumption: str = "IMPORT_kWh",
                        generation: str = "EXPORT_kWh", tariff: str = "CAL_TARIFF") -> DataFrame:
    """Credit ledger per account and year (``keys``), month by month; the balance lapses at year end.

    Months are summed first (an account has one tariff in a month), so a group is at most twelve elements and the fold
    over them needs neither Python nor an unbounded buffer.  The bill, the credit
    and the floor of each month are computed before the fold, inside code generation.
    """
    monthly = readings.groupBy(*keys, "MONTH", F.col(tariff).alias("t")).agg(F.sum(consumption).alias("c"), F.sum(generation).alias("g"))
    priced = monthly.withColumns(month_terms(F.col("c"), F.col("g"), F.col("t")))
    months = priced.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(
        "MONTH", "c", "g", "net", "gross", "credit", "floor"))).alias("months"))
    return months.select(*keys, F.inline(ledger_rows(F.col("months"))))


def month_terms(c: Column, g: Column, tariff: Column) -> dict[str, Column]:
    """What the ledger needs of a month beside its sums: none of it depends on the balance."""
    net = c - g
    return {"net": net, "gross": TF.money(TF.bill(F.greatest(net, F.lit(0.0)), tariff)["total_bill_lkr"]),
            "credit": F.greatest(-net, F.lit(0.0)) * TF.highest_block_rate(tariff), "floor": TF.fixed_charge(tariff)}


def ledger_rows(months: Column) -> Column:
    """The ledger of a year as an array: ``months`` holds (MONTH, c, g, net, gross, credit, floor) in their order."""
    def step(acc, m):
        balance = acc["balance"]
        importing = m["net"] >= 0
        due = F.when(balance > 0, F.greatest(m["floor"], m["gross"] - balance)).otherwise(m["gross"])
        used = F.when(importing, m["gross"] - due).otherwise(0.0)
        after = F.when(importing, F.when(balance > 0, F.greatest(F.lit(0.0), balance - used)).otherwise(balance)) \
            .otherwise(balance + m["credit"])
        row = F.struct(m["MONTH"].alias("month"), m["c"].alias("consumption_kwh"), m["g"].alias("generation_kwh"),
                       m["net"].alias("net_kwh"), F.when(importing, due).otherwise(m["floor"]).alias("bill_lkr"),
                       F.when(importing, 0.0).otherwise(m["credit"]).alias("credit_earned"),
                       used.alias("credits_used"), after.alias("credit_balance"))
        return F.struct(after.alias("balance"), F.concat(acc["rows"], F.array(row)).alias("rows"))

    start = F.struct(F.lit(0.0).alias("balance"), F.array().cast(f"array<struct<{_as_struct(LEDGER_ROW)}>>").alias("rows"))
    return F.aggregate(months, start, step, lambda acc: acc["rows"])


def _as_struct(ddl: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (c.strip().split(" ") for c in ddl.split(",")))


def credit_summary(ledger: DataFrame, keys: list[str]) -> DataFrame:
    excess = F.col("credit_earned") > 0
    return ledger.groupBy(*keys).agg(
        F.sum("credit_earned").alias("total_credits_earned"),
        F.sum("credits_used").alias("total_credits_used"),
        F.sum("bill_lkr").alias("total_bill_lkr"),
        F.count_if(excess).alias("months_with_excess"),
        F.coalesce(F.avg(F.when(excess, F.col("credit_earned"))), F.lit(0.0)).alias("average_monthly_credit"),
        F.max_by("credit_balance", "month").alias("expired_credits"))
