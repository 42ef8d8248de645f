"""Adapters from the benchmark tables to utility tables, and the query registry.

Every adapter is one SQL text that Spark and the SQL check both run, so the two
sides start from the same rows.  ``{name}`` stands for another table.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
               "embeddings", "pages", "benchmark", "labels", "conversations"]

# name -> (tables used, text)
ADAPTERS: dict[str, tuple[list[str], str]] = {
    "accounts": (["supplier"], """
SELECT s_suppkey AS account_id, concat('ACC', lpad(CAST(s_suppkey AS STRING), 6, '0')) AS ACCOUNT_NO,
       concat('TF', lpad(CAST(s_nationkey AS STRING), 3, '0')) AS TRANSFORMER_CODE,
       6.80e0 + (s_suppkey * 37 % 101) * 0.001e0 AS CUSTOMER_LAT,
       79.88e0 + (s_suppkey * 53 % 97) * 0.001e0 AS CUSTOMER_LON,
       CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 0 END AS HAS_SOLAR,
       CASE WHEN s_suppkey % 4 = 0 THEN 3e0 + (s_suppkey % 7) ELSE 0e0 END AS INV_CAPACITY,
       CASE WHEN s_suppkey % 5 = 0 THEN 'GP1' ELSE 'D1' END AS CAL_TARIFF,
       CASE WHEN s_suppkey % 6 = 0 THEN 'TP' ELSE 'SP' END AS PHASE
FROM {supplier}"""),
    "transformers": (["nation"], """
SELECT concat('TF', lpad(CAST(n_nationkey AS STRING), 3, '0')) AS TRANSFORMER_CODE,
       6.80e0 + (n_nationkey * 17 % 101) * 0.001e0 AS TRANSFORMER_LAT,
       79.88e0 + (n_nationkey * 29 % 97) * 0.001e0 AS TRANSFORMER_LON,
       n_name AS DESCRIPTION, 160 AS MAX_CAPACITY, n_nationkey AS SITE_ID
FROM {nation}"""),
    "readings": (["lineitem", "accounts", "transformers"], """
SELECT a.account_id, a.ACCOUNT_NO, a.TRANSFORMER_CODE, t.TRANSFORMER_LAT, t.TRANSFORMER_LON,
       a.CUSTOMER_LAT, a.CUSTOMER_LON, r.YEAR, r.MONTH, r.import_kwh AS IMPORT_kWh,
       CASE WHEN a.HAS_SOLAR = 1 THEN r.exp_kwh ELSE 0e0 END AS EXPORT_kWh,
       r.import_kwh - CASE WHEN a.HAS_SOLAR = 1 THEN r.exp_kwh ELSE 0e0 END AS NET_CONSUMPTION_kWh,
       a.HAS_SOLAR, a.INV_CAPACITY, a.CAL_TARIFF, a.PHASE, t.SITE_ID,
       CASE WHEN r.MONTH IN (9, 10, 11) THEN 'REAL' ELSE 'SYNTHETIC' END AS DATA_QUALITY
FROM (SELECT l_suppkey, CAST(year(l_shipdate) AS INT) AS YEAR, CAST(month(l_shipdate) AS INT) AS MONTH,
             sum(l_quantity) AS import_kwh, round(sum(l_quantity * l_discount) * 5e0 + 1e-7, 2) AS exp_kwh
      FROM {lineitem} GROUP BY l_suppkey, year(l_shipdate), month(l_shipdate)) r
JOIN {accounts} a ON a.account_id = r.l_suppkey
JOIN {transformers} t ON t.TRANSFORMER_CODE = a.TRANSFORMER_CODE"""),
    # every observed month of every site, no gaps
    "weather_history": (["lineitem", "supplier"], """
SELECT SITE_ID, Year, Month, round(g + 1e-7, 3) AS Solar_Irradiance_GHI, round(g + 0.8e0 + d * 5 + 1e-7, 3) AS Clear_Sky_GHI,
       round(t + 1e-7, 2) AS Temperature, round(t + 1e-7, 2) + 3e0 AS Max_Temperature,
       round(t + 1e-7, 2) - 3e0 AS Min_Temperature, round(h + 1e-7, 1) AS Humidity,
       round(d * 100 + 1e-7, 2) AS Precipitation, round(2e0 + d * 20 + (Month % 3) * 0.5e0 + 1e-7, 2) AS Wind_Speed
FROM (SELECT s.s_nationkey AS SITE_ID, CAST(year(l.l_shipdate) AS INT) AS Year, CAST(month(l.l_shipdate) AS INT) AS Month,
             3.4e0 + avg(l.l_quantity) * 0.05e0 + (month(l.l_shipdate) * 7 % 5) * 0.3e0 AS g,
             25e0 + avg(l.l_tax) * 50 + (month(l.l_shipdate) * 3 % 4) * 0.5e0 AS t,
             70e0 + avg(l.l_linenumber) * 2 AS h, avg(l.l_discount) AS d
      FROM {lineitem} l JOIN {supplier} s ON s.s_suppkey = l.l_suppkey
      GROUP BY s.s_nationkey, year(l.l_shipdate), month(l.l_shipdate)) w"""),
    # as it arrives: irradiance of the last years is missing in November and December
    "weather": (["weather_history"], """
SELECT SITE_ID, Year, Month,
       CASE WHEN Year >= 1999 AND Month IN (11, 12) THEN NULL ELSE Solar_Irradiance_GHI END AS Solar_Irradiance_GHI,
       CASE WHEN Year >= 1999 AND Month IN (11, 12) THEN NULL ELSE Clear_Sky_GHI END AS Clear_Sky_GHI,
       Temperature, Max_Temperature, Min_Temperature, Humidity, Precipitation, Wind_Speed
FROM {weather_history}"""),
    "users": (["customer"], """
SELECT c_custkey AS user_id, 6.80e0 + (c_custkey * 41 % 103) * 0.001e0 AS latitude,
       79.88e0 + (c_custkey * 59 % 89) * 0.001e0 AS longitude,
       120e0 + (c_custkey * 13 % 240) AS kwh_m09, 125e0 + (c_custkey * 17 % 240) AS kwh_m10,
       118e0 + (c_custkey * 19 % 240) AS kwh_m11,
       CASE WHEN c_custkey % 5 = 0 THEN 'GP1' ELSE 'D1' END AS tariff,
       CASE WHEN c_custkey % 6 = 0 THEN 'TP' ELSE 'SP' END AS phase,
       CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS has_solar, 2000e0 AS search_radius_m
FROM {customer}"""),
    "forecasts": (["readings"], """
SELECT account_id, YEAR, MONTH, NET_CONSUMPTION_kWh AS y_true,
       NET_CONSUMPTION_kWh * (0.90e0 + ((account_id * 31 + YEAR * 7 + MONTH * 17) % 21) * 0.01e0) AS y_pred,
       NET_CONSUMPTION_kWh * (0.88e0 + ((account_id * 17 + YEAR * 11 + MONTH * 5) % 25) * 0.01e0) AS y_pred2
FROM {readings}"""),
    "systems": (["part"], """
SELECT p_partkey AS system_id, 1.5e0 + (p_partkey % 19) AS size_kw,
       (1.5e0 + (p_partkey % 19)) * (1200e0 + (p_partkey * 7 % 400)) AS annual_generation_kwh,
       p_retailprice * 4e0 AS annual_consumption_kwh
FROM {part}"""),
    "vendor_prices": ([], """
SELECT * FROM (VALUES ('V1',3e0,655000e0),('V1',3.5e0,750000e0),('V1',4e0,790000e0),('V1',5e0,820000e0),
       ('V1',8e0,1480000e0),('V1',10e0,1850000e0),('V2',3e0,640000e0),('V2',3.5e0,730000e0),('V2',4e0,770000e0),
       ('V2',5e0,795000e0),('V2',8e0,1450000e0),('V2',10e0,1820000e0)) AS v(vendor,size_kw,price_lkr)"""),
    "order_months": (["orders"], """
SELECT o_custkey AS account_id, CAST(year(o_orderdate) AS INT) AS YEAR, CAST(month(o_orderdate) AS INT) AS MONTH,
       sum(o_totalprice) / 1000e0 AS IMPORT_kWh, CAST(count(*) AS BIGINT) AS n
FROM {orders} GROUP BY o_custkey, year(o_orderdate), month(o_orderdate)"""),
}


class Tables:
    """Base and adapted tables of one data directory as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._made = spark, folder, {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in ADAPTERS:
                needs, text = ADAPTERS[name]
                self._made[name] = self.spark.sql(text, **{n: self(n) for n in needs})
            else:
                self._made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._made[name]


def with_adapters(sql: str, needs: list[str]) -> str:
    """``sql`` behind the CTEs of the adapters it needs (and theirs)."""
    order: list[str] = []

    def visit(name: str):
        if name in ADAPTERS and name not in order:
            for dep in ADAPTERS[name][0]:
                visit(dep)
            order.append(name)

    for name in needs:
        visit(name)
    ctes = [f"{n} AS ({ADAPTERS[n][1].format(**{d: d for d in ADAPTERS[n][0]})})" for n in order]
    body = sql.strip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(head):
            return head + ",\n".join([*ctes, body[len(head):]])
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


# Averages of two-digit amounts often end exactly on a rounding tie, where the last bit of
# the sum (which depends on its order) decides.  Both sides lift outputs of 4, 6 or 8 digits
# by this much before rounding.
TIE_LIFT, LIFTED_DIGITS = 1e-9, (4, 6, 8)


def lift_ties(sql: str) -> str:
    """``round(x, n)`` to ``round(x + 1e-9, n)`` for the digits of ``LIFTED_DIGITS``, unless ``x`` has its own lift."""
    out, pos = [], 0
    while (start := sql.find("round(", pos)) >= 0:
        depth, comma, end = 0, None, start + 5
        for end in range(start + 5, len(sql)):
            ch = sql[end]
            depth += (ch in "([") - (ch in ")]")
            if ch == "," and depth == 1:
                comma = end
            if depth == 0:
                break
        inner = sql[start + 6:comma if comma else end]
        digits = sql[comma + 1:end].strip() if comma else ""
        own = re.search(r"\+1e-\d+$", inner.strip())
        lift = "+1e-9" if digits.isdigit() and int(digits) in LIFTED_DIGITS and not own else ""
        out.append(sql[pos:start] + "round(" + lift_ties(inner) + lift + (sql[comma:end] if comma else "") + ")")
        pos = end + 1
    return "".join(out) + sql[pos:]


QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, needs: list[str] | None = None, sql: str | None = None):
    """Register a query; ``sql`` is its twin over the base tables and the adapters in ``needs``."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_adapters(lift_ties(sql), needs or [])
        return fn
    return add
