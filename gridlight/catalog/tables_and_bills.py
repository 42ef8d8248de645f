"""Cleaning, roll-ups, bills and series features over the readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlight import constants as C
from gridlight.catalog.base import LIFTED_DIGITS, TIE_LIFT, query
from gridlight.functions import calendar as CAL, geo as G, numeric as N, tariff as TF, text as TX
from gridlight.operators import billing as BL, clean as CL, rollup as RU, series as SE


def r(col, n=4):
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c + TIE_LIFT if n in LIFTED_DIGITS else c, n)


def rounded(df, cols, n=4):
    return df.withColumns({c: r(c, n) for c in cols})


def long(*names):
    return [F.col(n).cast("long").alias(n) for n in names]


BLOCKS = """blocks AS (SELECT * FROM (VALUES ('D1',0e0,31e0,8e0),('D1',31e0,30e0,10e0),('D1',61e0,30e0,16e0),('D1',91e0,30e0,50e0),
 ('D1',121e0,60e0,75e0),('D1',181e0,9819e0,100e0),('GP1',0e0,101e0,45e0),('GP1',101e0,9899e0,55e0)) AS v(tariff,below,size,rate)),
energy AS (SELECT r.account_id, r.YEAR, r.MONTH, r.CAL_TARIFF, r.NET_CONSUMPTION_kWh AS kwh,
  sum(greatest(0e0, least(r.NET_CONSUMPTION_kWh - b.below, b.size)) * b.rate) AS e
  FROM readings r JOIN blocks b ON b.tariff = r.CAL_TARIFF
  WHERE r.NET_CONSUMPTION_kWh BETWEEN 10 AND 2000 GROUP BY ALL),
parts AS (SELECT *, CASE WHEN CAL_TARIFF = 'GP1' THEN 240e0 ELSE 180e0 END AS f, e * 0.18e0 AS fuel FROM energy),
bills AS (SELECT account_id, YEAR, MONTH, CAL_TARIFF, kwh, round(e + 1e-7, 2) AS energy_charge_lkr, f AS fixed_charge_lkr,
  round(fuel + 1e-7, 2) AS fuel_adjustment_lkr, round(e + f + fuel + 1e-7, 2) AS subtotal_lkr,
  round((e + f + fuel) * 0.18e0 + 1e-7, 2) AS vat_lkr,
  round((e + f + fuel) + (e + f + fuel) * 0.18e0 + 1e-7, 2) AS total_bill_lkr,
  round(((e + f + fuel) + (e + f + fuel) * 0.18e0) / kwh + 1e-7, 2) AS effective_rate_lkr_per_kwh FROM parts)"""


def bills(t):
    return BL.monthly_bills(CL.plausible_range(t("readings")))


@query("h22_monthly_bill", ["readings"], f"WITH {BLOCKS} SELECT * FROM bills")
def monthly_bill(t):
    return bills(t).select("account_id", "YEAR", "MONTH", "CAL_TARIFF", F.col("NET_CONSUMPTION_kWh").alias("kwh"),
                           "energy_charge_lkr", "fixed_charge_lkr", "fuel_adjustment_lkr", "subtotal_lkr", "vat_lkr",
                           "total_bill_lkr", "effective_rate_lkr_per_kwh")


@query("d54_annual_bill", ["readings"], f"""WITH {BLOCKS}
SELECT account_id, YEAR, CAL_TARIFF, round(sum(kwh),2) total_consumption_kwh, round(sum(energy_charge_lkr),2) total_energy_charge_lkr,
 round(sum(fixed_charge_lkr),2) total_fixed_charge_lkr, round(sum(fuel_adjustment_lkr),2) total_fuel_adjustment_lkr,
 round(sum(vat_lkr),2) total_vat_lkr, round(sum(total_bill_lkr),2) total_bill_lkr,
 round(sum(kwh)/12,4) monthly_average_consumption_kwh, round(sum(total_bill_lkr)/12+1e-7,3) monthly_average_bill_lkr,
 round(sum(total_bill_lkr)/sum(kwh),4) effective_rate_lkr_per_kwh FROM bills GROUP BY ALL""")
def annual_bill(t):
    out = BL.annual_bills(bills(t), ["account_id", "YEAR", "CAL_TARIFF"])
    two = ["total_consumption_kwh", "total_energy_charge_lkr", "total_fixed_charge_lkr", "total_fuel_adjustment_lkr",
           "total_vat_lkr", "total_bill_lkr"]
    out = rounded(rounded(out, two, 2), ["monthly_average_consumption_kwh", "effective_rate_lkr_per_kwh"])
    return out.withColumn("monthly_average_bill_lkr", F.round(F.col("monthly_average_bill_lkr") + 1e-7, 3))


@query("h21_block_details", ["readings"], """WITH b AS (SELECT * FROM (VALUES ('D1',1,'0-30',0e0,31e0,8e0),('D1',2,'31-60',31e0,30e0,10e0),
 ('D1',3,'61-90',61e0,30e0,16e0),('D1',4,'91-120',91e0,30e0,50e0),('D1',5,'121-180',121e0,60e0,75e0),('D1',6,'181-9999',181e0,9819e0,100e0),
 ('GP1',1,'0-100',0e0,101e0,45e0),('GP1',2,'101-9999',101e0,9899e0,55e0)) AS v(tariff,block_no,block_range,below,size,rate))
SELECT account_id, YEAR, MONTH, block_no, block_range, round(least(NET_CONSUMPTION_kWh - below, size)+1e-7,2) AS kwh_in_block, rate,
 round(least(NET_CONSUMPTION_kWh - below, size)*rate+1e-7,2) AS charge
FROM readings JOIN b ON tariff = CAL_TARIFF WHERE NET_CONSUMPTION_kWh > below""")
def block_details(t):
    return BL.bill_details(t("readings"), ["account_id", "YEAR", "MONTH"])


@query("h23_dashboard_bill", ["readings"], """SELECT account_id, YEAR, MONTH, round_even((least(k,30)*8e0
 + greatest(0e0,least(k-30,30))*10 + greatest(0e0,least(k-60,30))*16 + greatest(0e0,least(k-90,30))*50
 + greatest(0e0,least(k-120,60))*75 + greatest(0e0,k-180)*100 + 180)*1.18e0, 0) AS bill
 FROM (SELECT *, greatest(NET_CONSUMPTION_kWh,0e0) AS k FROM readings)""")
def dashboard_bill(t):
    return t("readings").select("account_id", "YEAR", "MONTH", TF.dashboard_bill(F.col("NET_CONSUMPTION_kWh")).alias("bill"))


@query("h24_tariff_scalars", ["accounts"], """SELECT CAL_TARIFF, count(*) AS accounts,
 CASE WHEN CAL_TARIFF='GP1' THEN 55e0 ELSE 100e0 END AS highest_rate, CASE WHEN CAL_TARIFF='GP1' THEN 240e0 ELSE 180e0 END AS fixed
 FROM accounts GROUP BY CAL_TARIFF""")
def tariff_scalars(t):
    return (t("accounts").groupBy("CAL_TARIFF").agg(F.count(F.lit(1)).alias("accounts"))
            .withColumns({"highest_rate": TF.highest_block_rate(F.col("CAL_TARIFF")), "fixed": TF.fixed_charge(F.col("CAL_TARIFF"))}))


LEDGER_SQL = """WITH RECURSIVE b AS (SELECT * FROM (VALUES ('D1',0e0,31e0,8e0),('D1',31e0,30e0,10e0),('D1',61e0,30e0,16e0),('D1',91e0,30e0,50e0),
 ('D1',121e0,60e0,75e0),('D1',181e0,9819e0,100e0),('GP1',0e0,101e0,45e0),('GP1',101e0,9899e0,55e0)) AS v(tariff,below,size,rate)),
m AS (SELECT account_id, YEAR, MONTH, CAL_TARIFF, IMPORT_kWh c, EXPORT_kWh*3 g, IMPORT_kWh-EXPORT_kWh*3 net,
  CASE WHEN CAL_TARIFF='GP1' THEN 240e0 ELSE 180e0 END f, CASE WHEN CAL_TARIFF='GP1' THEN 55e0 ELSE 100e0 END hi,
  row_number() OVER (PARTITION BY account_id, YEAR ORDER BY MONTH) AS rn FROM readings),
e AS (SELECT m.account_id, m.YEAR, m.MONTH, m.rn, any_value(c) c, any_value(g) g, any_value(net) net, any_value(f) f, any_value(hi) hi,
  round((sum(greatest(0e0, least(greatest(net,0e0)-b.below,b.size))*b.rate)*1.18e0+any_value(f))*1.18e0 + 1e-7, 2) AS gross
  FROM m JOIN b ON b.tariff=m.CAL_TARIFF GROUP BY m.account_id, m.YEAR, m.MONTH, m.rn),
l AS (SELECT account_id, YEAR, MONTH, rn, c, g, net,
   CASE WHEN net>=0 THEN gross ELSE f END AS bill, CASE WHEN net<0 THEN -net*hi ELSE 0e0 END AS earned, 0e0 AS used,
   CASE WHEN net<0 THEN -net*hi ELSE 0e0 END AS balance FROM e WHERE rn=1
 UNION ALL SELECT e.account_id, e.YEAR, e.MONTH, e.rn, e.c, e.g, e.net,
   CASE WHEN e.net<0 THEN e.f WHEN l.balance>0 THEN greatest(e.f, e.gross-l.balance) ELSE e.gross END,
   CASE WHEN e.net<0 THEN -e.net*e.hi ELSE 0e0 END,
   CASE WHEN e.net>=0 AND l.balance>0 THEN e.gross-greatest(e.f, e.gross-l.balance) ELSE 0e0 END,
   CASE WHEN e.net<0 THEN l.balance - e.net*e.hi WHEN l.balance>0 THEN greatest(0e0, l.balance-(e.gross-greatest(e.f, e.gross-l.balance))) ELSE l.balance END
 FROM l JOIN e ON e.account_id=l.account_id AND e.YEAR=l.YEAR AND e.rn=l.rn+1)"""


def ledger(t):
    # three times the metered export, so that credits are earned as well as used
    return BL.net_metering_ledger(t("readings").withColumn("EXPORT_kWh", F.col("EXPORT_kWh") * 3), ["account_id", "YEAR"])


@query("e14_net_metering_ledger", ["readings"], LEDGER_SQL + """ SELECT account_id, YEAR, MONTH AS month, round(c,2) consumption_kwh,
 round(g,2) generation_kwh, round(net,2) net_kwh, round(bill+1e-7,2) bill_lkr, round(earned,2) credit_earned, round(used,2) credits_used,
 round(balance+1e-7,2) credit_balance FROM l""")
def net_metering(t):
    out = rounded(ledger(t), ["consumption_kwh", "generation_kwh", "net_kwh", "credit_earned", "credits_used"], 2)
    return out.withColumns({c: F.round(F.col(c) + 1e-7, 2) for c in ("bill_lkr", "credit_balance")})


@query("d55_credit_summary", ["readings"], LEDGER_SQL + """ SELECT account_id, YEAR, round(sum(earned),2) total_credits_earned,
 round(sum(used),2) total_credits_used, round(sum(bill)+1e-6,2) total_bill_lkr, count(*) FILTER (earned>0) AS months_with_excess,
 round(coalesce(avg(earned) FILTER (earned>0),0),3) average_monthly_credit, round(max_by(balance, MONTH)+1e-6,2) expired_credits FROM l GROUP BY ALL""")
def credit_summary(t):
    out = BL.credit_summary(ledger(t), ["account_id", "YEAR"])
    out = rounded(out, ["total_credits_earned", "total_credits_used"], 2)
    return out.withColumns({"total_bill_lkr": F.round(F.col("total_bill_lkr") + 1e-6, 2), "average_monthly_credit": r("average_monthly_credit", 3),
                            "expired_credits": F.round(F.col("expired_credits") + 1e-6, 2)})


# ---- filters and coercion -------------------------------------------------------

@query("a5_resolve_columns", [], """SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS INV_CAPACITY, p_type AS CAL_TARIFF, 'SP' AS PHASE FROM part""")
def resolve(t):
    raw = t("part").select(F.col("p_partkey").alias(" id "), F.col("p_size").alias("Inv. Capacity (kW)"),
                           F.col("p_type").alias("CAL TARIFF code"))
    clean = CL.strip_headers(raw)
    out = CL.resolve_columns(clean, {"id": (["id"], None), "INV_CAPACITY": (["inv", "capacity"], 0.0),
                                     "CAL_TARIFF": (["tariff"], "D1"), "PHASE": (["phase"], "SP")})
    return CL.require_columns(out, ["id", "PHASE"]).withColumn("INV_CAPACITY", F.col("INV_CAPACITY").cast("double"))


@query("a7_coerce_numeric", [], """SELECT event_id, TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS value,
 TRY_CAST(trim(event_type) AS DOUBLE) AS event_type, user_id FROM events""")
def coerce(t):
    raw = t("events").select("event_id", F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("value"),
                             "event_type", "user_id")
    return CL.coerce_numeric(CL.trim_strings(raw), ["value", "event_type"])


@query("b1_b4_solar_residential", ["readings"], """SELECT account_id, YEAR, MONTH, INV_CAPACITY, NET_CONSUMPTION_kWh FROM readings
 WHERE HAS_SOLAR = 1 AND INV_CAPACITY <= 8""")
def solar_residential(t):
    return CL.residential_only(CL.solar_only(t("readings")), 8.0).select("account_id", "YEAR", "MONTH", "INV_CAPACITY", "NET_CONSUMPTION_kWh")


@query("b2_b3_bounds_and_range", ["readings"], """SELECT account_id, YEAR, MONTH, NET_CONSUMPTION_kWh FROM readings
 WHERE CUSTOMER_LAT BETWEEN 5.9 AND 9.8 AND CUSTOMER_LON BETWEEN 79.6 AND 81.9 AND NET_CONSUMPTION_kWh BETWEEN 10 AND 2000""")
def bounds_range(t):
    return CL.plausible_range(CL.within_bounds(t("readings"))).select("account_id", "YEAR", "MONTH", "NET_CONSUMPTION_kWh")


@query("b5_sentinels", ["weather"], """SELECT SITE_ID, Year, Month, Solar_Irradiance_GHI, Clear_Sky_GHI, Temperature FROM weather""")
def sentinels(t):
    raw = t("weather").select("SITE_ID", "Year", "Month", F.coalesce("Solar_Irradiance_GHI", F.lit(-999.0)).alias("Solar_Irradiance_GHI"),
                              F.coalesce("Clear_Sky_GHI", F.lit(-999.0)).alias("Clear_Sky_GHI"), "Temperature")
    return CL.sentinels_to_null(raw)


@query("b6_b7_essential_real_months", ["readings"], """SELECT account_id, ACCOUNT_NO, MONTH, EXPORT_kWh, INV_CAPACITY, account_id % 7 AS grp
 FROM readings WHERE MONTH IN (9,10,11)""")
def essential(t):
    kept = CL.drop_listed(CL.in_months(t("readings"), [9, 10, 11]))
    return kept.drop("SITE_ID").withColumn("grp", F.col("account_id") % 7)


@query("b8_validate_requests", ["users"], """SELECT user_id, CAST((CASE WHEN lat < 5.9 OR lat > 9.8 THEN 1 ELSE 0 END)
 + (CASE WHEN k < 0 OR k > 2000 THEN 1 ELSE 0 END) + (CASE WHEN tariff = 'X9' THEN 1 ELSE 0 END) AS INT) AS n_errors,
 CASE WHEN tariff IS NULL THEN 'D1' ELSE tariff END AS tariff, 4 AS household_size
 FROM (SELECT user_id, CASE WHEN user_id % 50 = 0 THEN 12e0 ELSE latitude END AS lat, CASE WHEN user_id % 30 = 0 THEN 2500e0 ELSE kwh_m09 END AS k,
  CASE WHEN user_id % 40 = 0 THEN 'X9' WHEN user_id % 41 = 0 THEN NULL ELSE tariff END AS tariff FROM users)""")
def validate(t):
    u = t("users")
    raw = u.select("user_id", F.when(F.col("user_id") % 50 == 0, 12.0).otherwise(F.col("latitude")).alias("latitude"), "longitude",
                   F.create_map(F.lit(9), F.when(F.col("user_id") % 30 == 0, 2500.0).otherwise(F.col("kwh_m09")),
                                F.lit(10), F.col("kwh_m10")).alias("consumption_months"),
                   F.when(F.col("user_id") % 40 == 0, "X9").when(F.col("user_id") % 41 != 0, F.col("tariff")).alias("tariff"), "phase", "has_solar")
    return CL.validate_requests(raw).select("user_id", F.size("errors").alias("n_errors"), "tariff", "household_size")


@query("b9_reading_sanity", ["readings"], """SELECT account_id, YEAR, MONTH, CASE WHEN i <= 5000 THEN i END AS IMPORT_kWh,
 CASE WHEN HAS_SOLAR=0 THEN 0e0 WHEN x <= 2000 THEN x END AS EXPORT_kWh, CASE WHEN i > 5000 OR x > 2000 THEN 'CAPPED' ELSE DATA_QUALITY END AS DATA_QUALITY
 FROM (SELECT *, IMPORT_kWh*12 AS i, EXPORT_kWh*20+1 AS x FROM readings)""")
def sanity(t):
    raw = t("readings").withColumns({"IMPORT_kWh": F.col("IMPORT_kWh") * 12, "EXPORT_kWh": F.col("EXPORT_kWh") * 20 + 1})
    return CL.reading_sanity(raw).select("account_id", "YEAR", "MONTH", "IMPORT_kWh", "EXPORT_kWh", "DATA_QUALITY")


@query("b10_b12_fill_missing", ["readings"], """WITH x AS (SELECT account_id, YEAR, MONTH, CASE WHEN MONTH % 5 <> 0 THEN NET_CONSUMPTION_kWh END AS net,
  CASE WHEN MONTH <> 7 THEN IMPORT_kWh END AS imp, CASE WHEN account_id % 9 <> 0 THEN CAL_TARIFF END AS tariff FROM readings)
SELECT account_id, YEAR, MONTH, round(coalesce(net, (SELECT quantile_cont(net, 0.5) FROM x)),4) AS net,
 round(coalesce(imp, (SELECT quantile_cont(imp, 0.5) FROM x)),4) AS imp,
 coalesce(tariff, (SELECT tariff FROM x WHERE tariff IS NOT NULL GROUP BY tariff ORDER BY count(*) DESC, tariff DESC LIMIT 1)) AS tariff FROM x""")
def fill_missing(t):
    raw = t("readings").select("account_id", "YEAR", "MONTH",
                               F.when(F.col("MONTH") % 5 != 0, F.col("NET_CONSUMPTION_kWh")).alias("net"),
                               F.when(F.col("MONTH") != 7, F.col("IMPORT_kWh")).alias("imp"),
                               F.when(F.col("account_id") % 9 != 0, F.col("CAL_TARIFF")).alias("tariff"))
    return rounded(CL.fill_with_statistics(raw, ["net", "imp"], ["tariff"]), ["net", "imp"])


@query("b13_impute_irradiance", ["weather", "weather_history"], """WITH m AS (SELECT SITE_ID, Month, round(avg(Solar_Irradiance_GHI)+1e-7,2) g, round(avg(Clear_Sky_GHI)+1e-7,2) c
  FROM weather_history WHERE Year BETWEEN 1995 AND 1998 AND Month IN (11,12) GROUP BY 1,2)
SELECT w.SITE_ID, w.Year, w.Month, coalesce(m.g, w.Solar_Irradiance_GHI) AS Solar_Irradiance_GHI, coalesce(m.c, w.Clear_Sky_GHI) AS Clear_Sky_GHI
FROM weather w LEFT JOIN m ON m.SITE_ID=w.SITE_ID AND m.Month=w.Month""")
def impute(t):
    return CL.impute_irradiance(t("weather"), t("weather_history"), 1995, 1998).select(
        "SITE_ID", "Year", "Month", "Solar_Irradiance_GHI", "Clear_Sky_GHI")


@query("b14_mask_accounts", ["accounts"], "SELECT account_id, concat(substr(ACCOUNT_NO,1,8),'...') AS masked FROM accounts")
def mask(t):
    return t("accounts").select("account_id", TX.mask_account(F.col("ACCOUNT_NO")).alias("masked"))


@query("b16_urban_split", ["readings"], """SELECT CUSTOMER_LAT > 6.8 AND CUSTOMER_LAT < 7.0 AND CUSTOMER_LON > 79.8 AND CUSTOMER_LON < 79.93 AS urban,
 count(*) AS n, round(avg(NET_CONSUMPTION_kWh),4) AS avg_net FROM readings GROUP BY 1""")
def urban(t):
    box = {**C.URBAN_BOX, "lon_max": 79.93}
    return t("readings").groupBy(G.is_urban(F.col("CUSTOMER_LAT"), F.col("CUSTOMER_LON"), box).alias("urban")).agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("NET_CONSUMPTION_kWh")).alias("avg_net"))


@query("b17_household_outliers", ["readings"], """SELECT account_id, YEAR, MONTH, NET_CONSUMPTION_kWh, round(med,4) AS household_median
 FROM (SELECT r.*, m.med FROM readings r JOIN (SELECT account_id, quantile_cont(NET_CONSUMPTION_kWh,0.5) med FROM readings GROUP BY 1) m USING (account_id))
 WHERE NET_CONSUMPTION_kWh BETWEEN 10 AND 2000 AND NET_CONSUMPTION_kWh BETWEEN 0.3e0*med AND 3e0*med""")
def household_outliers(t):
    return rounded(CL.household_outlier_filter(t("readings")), ["household_median"]).select(
        "account_id", "YEAR", "MONTH", "NET_CONSUMPTION_kWh", "household_median")


@query("b19_skip_zero_coordinates", ["readings"], """SELECT TRANSFORMER_CODE, count(*) AS n FROM readings WHERE TRANSFORMER_LAT <> 0 AND TRANSFORMER_LON <> 0
 AND TRANSFORMER_CODE <> 'TF003' GROUP BY 1""")
def skip_zero(t):
    lat = F.when(F.col("TRANSFORMER_CODE") == "TF003", 0.0).otherwise(F.col("TRANSFORMER_LAT"))
    return (t("readings").withColumn("TRANSFORMER_LAT", lat).where((F.col("TRANSFORMER_LAT") != 0) & (F.col("TRANSFORMER_LON") != 0))
            .groupBy("TRANSFORMER_CODE").agg(F.count(F.lit(1)).alias("n")))


# ---- roll-ups --------------------------------------------------------------------

HAV = """2*6371000e0*atan2(sqrt(h), sqrt(greatest(1-h,0e0)))"""


def hav(lat1, lon1, lat2, lon2):
    a = (f"(pow(sin(radians({lat2}-{lat1})/2),2)+cos(radians({lat1}))*cos(radians({lat2}))*pow(sin(radians({lon2}-{lon1})/2),2))")
    return f"(2*6371000e0*atan2(sqrt({a}),sqrt(greatest(1-{a},0e0))))"


RD_DIST = f"""rd AS (SELECT *, {hav('CUSTOMER_LAT', 'CUSTOMER_LON', 'TRANSFORMER_LAT', 'TRANSFORMER_LON')} AS d FROM readings)"""
ROLLUP_SQL = RD_DIST + """, c AS (SELECT TRANSFORMER_CODE, ACCOUNT_NO, min_by(INV_CAPACITY, YEAR*12+MONTH) cap, min_by(HAS_SOLAR, YEAR*12+MONTH) sol FROM readings GROUP BY 1,2),
s AS (SELECT TRANSFORMER_CODE, sum(cap) total_solar_capacity, CAST(sum(sol) AS BIGINT) solar_connections FROM c GROUP BY 1),
u AS (SELECT rd.TRANSFORMER_CODE, min(TRANSFORMER_LAT) TRANSFORMER_LAT, min(TRANSFORMER_LON) TRANSFORMER_LON, avg(NET_CONSUMPTION_kWh) avg_consumption,
 stddev_samp(NET_CONSUMPTION_kWh) consumption_std, max(NET_CONSUMPTION_kWh) max_consumption, avg(IMPORT_kWh) avg_import, avg(EXPORT_kWh) avg_export,
 count(DISTINCT ACCOUNT_NO) num_customers, avg(d) avg_distance_from_tf, count(*) data_points FROM rd GROUP BY 1),
ru AS (SELECT * FROM u JOIN s USING (TRANSFORMER_CODE)),
tf AS (SELECT *, 100e0 AS ESTIMATED_CAPACITY_kW, avg_consumption/720 AS current_load_kW, greatest(0e0,least(1e0,avg_consumption/720/100)) AS utilization_rate,
 100e0-avg_consumption/720-total_solar_capacity AS available_headroom, greatest(0e0,total_solar_capacity/100) AS solar_penetration,
 coalesce(consumption_std/720,0) AS demand_volatility, coalesce(avg_export/(avg_import+1),0) AS export_ratio FROM ru)"""


@query("d1_transformer_rollup", ["readings"], "WITH " + ROLLUP_SQL + """ SELECT TRANSFORMER_CODE, TRANSFORMER_LAT, TRANSFORMER_LON, round(avg_consumption,4) avg_consumption,
 round(consumption_std,4) consumption_std, max_consumption, round(avg_import,4) avg_import, round(avg_export,4) avg_export, num_customers,
 round(avg_distance_from_tf,4) avg_distance_from_tf, data_points, total_solar_capacity, solar_connections FROM ru""")
def rollup(t):
    return rounded(RU.transformer_rollup(t("readings")), ["avg_consumption", "consumption_std", "avg_import", "avg_export", "avg_distance_from_tf"])


@query("d2_customers_once", ["readings"], """SELECT TRANSFORMER_CODE, ACCOUNT_NO, min_by(INV_CAPACITY, YEAR*12+MONTH) AS INV_CAPACITY,
 min_by(HAS_SOLAR, YEAR*12+MONTH) AS HAS_SOLAR FROM readings GROUP BY 1,2""")
def customers_once(t):
    return RU.customers_once(t("readings"))


@query("d3_transformer_features", ["readings"], "WITH " + ROLLUP_SQL + """ SELECT TRANSFORMER_CODE, round(current_load_kW,6) current_load_kW, round(utilization_rate,6) utilization_rate,
 round(available_headroom,6) available_headroom, round(solar_penetration,6) solar_penetration, round(demand_volatility,6) demand_volatility, round(export_ratio,6) export_ratio FROM tf""")
def features(t):
    f = RU.transformer_features(RU.transformer_rollup(t("readings")))
    cols = ["current_load_kW", "utilization_rate", "available_headroom", "solar_penetration", "demand_volatility", "export_ratio"]
    return rounded(f, cols, 6).select("TRANSFORMER_CODE", *cols)


PROFILE_SQL = """pm AS (SELECT account_id, ACCOUNT_NO, MONTH, avg(NET_CONSUMPTION_kWh) net, avg(IMPORT_kWh) imp, avg(EXPORT_kWh) ex FROM readings GROUP BY 1,2,3),
pf AS (SELECT account_id, ACCOUNT_NO, CAST(count(*) AS INT) months_with_data, CAST(count(*) FILTER (net<10) AS INT) low_months, sum(net) annual_total, avg(net) annual_average,
 stddev_pop(net) annual_std, min(net) annual_min, max(net) annual_max, arg_max(MONTH, net) peak_month FROM pm GROUP BY 1,2),
pa AS (SELECT pf.*, a.TRANSFORMER_CODE, a.HAS_SOLAR, a.INV_CAPACITY, a.CAL_TARIFF, a.PHASE, a.CUSTOMER_LAT, a.CUSTOMER_LON FROM pf JOIN accounts a USING (account_id))"""


@query("d4_customer_profiles", ["readings"], "WITH " + PROFILE_SQL + """ SELECT account_id, ACCOUNT_NO, TRANSFORMER_CODE, HAS_SOLAR, CAL_TARIFF, months_with_data, low_months,
 round(annual_total,4) annual_total, round(annual_average,4) annual_average, round(annual_std,4) annual_std, round(annual_min,4) annual_min, round(annual_max,4) annual_max, peak_month,
 (SELECT round(sum(MONTH*net),3) FROM pm WHERE pm.account_id=pa.account_id) AS pattern_check FROM pa""")
def profiles(t):
    p = RU.customer_profiles(t("readings"))
    check = F.aggregate(F.map_entries("monthly_pattern"), F.lit(0.0), lambda acc, e: acc + e["key"] * e["value"]["net_consumption"])
    p = p.withColumn("pattern_check", F.round(check, 3))
    return rounded(p, ["annual_total", "annual_average", "annual_std", "annual_min", "annual_max"]).select(
        "account_id", "ACCOUNT_NO", "TRANSFORMER_CODE", "HAS_SOLAR", "CAL_TARIFF", "months_with_data", "low_months", "annual_total",
        "annual_average", "annual_std", "annual_min", "annual_max", "peak_month", "pattern_check")


@query("d5_dataset_statistics", ["readings"], """SELECT count(*) total_records, count(DISTINCT ACCOUNT_NO) unique_accounts, count(DISTINCT TRANSFORMER_CODE) unique_transformers,
 min(MONTH) month_min, max(MONTH) month_max, round(avg(NET_CONSUMPTION_kWh),4) mean_kwh, round(stddev_samp(NET_CONSUMPTION_kWh),4) std_kwh, min(NET_CONSUMPTION_kWh) min_kwh,
 max(NET_CONSUMPTION_kWh) max_kwh, CAST(sum(HAS_SOLAR) AS BIGINT) solar_records, round(quantile_cont(NET_CONSUMPTION_kWh,0.5),4) median_kwh FROM readings""")
def statistics(t):
    return rounded(RU.dataset_statistics(t("readings")).drop("tariff_distribution"), ["mean_kwh", "std_kwh", "median_kwh"])


@query("d5_tariff_distribution", ["readings"], "SELECT CAL_TARIFF, count(*) AS readings FROM readings GROUP BY 1")
def tariff_distribution(t):
    return RU.dataset_statistics(t("readings")).select(F.explode("tariff_distribution").alias("CAL_TARIFF", "readings"))


@query("d6_profiles_by_tariff", ["readings"], "WITH " + PROFILE_SQL + " SELECT account_id, round(annual_total,4) AS annual_total FROM pa WHERE CAL_TARIFF='GP1'")
def by_tariff(t):
    return rounded(RU.profiles_by_tariff(RU.customer_profiles(t("readings")), "GP1"), ["annual_total"]).select("account_id", "annual_total")


IQR_SQL = """q AS (SELECT MONTH, quantile_cont(EXPORT_kWh,0.25) q1, quantile_cont(EXPORT_kWh,0.75) q3 FROM sr GROUP BY 1),
bd AS (SELECT MONTH, q1, q3, q1-1.5e0*(q3-q1) lo, q3+1.5e0*(q3-q1) hi FROM q)"""


@query("d7_month_iqr_bounds", ["readings"], f"""WITH sr AS (SELECT * FROM readings WHERE HAS_SOLAR=1), {IQR_SQL}
SELECT MONTH, round(q1,4) q1, round(q3,4) q3, round(lo,4) lower_bound, round(hi,4) upper_bound FROM bd""")
def iqr_bounds(t):
    return rounded(RU.month_iqr_bounds(t("readings").where("HAS_SOLAR = 1")), ["q1", "q3", "lower_bound", "upper_bound"])


@query("d8_drop_month_outliers", ["readings"], f"""WITH sr AS (SELECT * FROM readings WHERE HAS_SOLAR=1), {IQR_SQL}
SELECT account_id, YEAR, MONTH, EXPORT_kWh FROM sr JOIN bd USING (MONTH) WHERE EXPORT_kWh BETWEEN lo-1e-9 AND hi+1e-9""")
def drop_outliers(t):
    sr = t("readings").where("HAS_SOLAR = 1")
    return RU.drop_month_outliers(sr, RU.month_iqr_bounds(sr)).select("account_id", "YEAR", "MONTH", "EXPORT_kWh")


@query("d8_month_outlier_counts", ["readings"], f"""WITH sr AS (SELECT * FROM readings WHERE HAS_SOLAR=1), {IQR_SQL}
SELECT MONTH, count(*) n, count(*) FILTER (EXPORT_kWh < lo-1e-9 OR EXPORT_kWh > hi+1e-9) removed FROM sr JOIN bd USING (MONTH) GROUP BY 1""")
def outlier_counts(t):
    sr = t("readings").where("HAS_SOLAR = 1")
    return RU.month_outlier_counts(sr, RU.month_iqr_bounds(sr))


@query("d27_value_counts", ["readings"], """SELECT DATA_QUALITY, count(*) n, round(count(*)*100e0/(SELECT count(*) FROM readings),4) pct FROM readings GROUP BY 1""")
def value_counts(t):
    return rounded(RU.value_counts(t("readings"), "DATA_QUALITY"), ["pct"])


SUMMARY_SQL = """a AS (SELECT TRANSFORMER_CODE, ACCOUNT_NO, max(HAS_SOLAR) s FROM readings GROUP BY 1,2), p AS (SELECT TRANSFORMER_CODE, count(*) c, CAST(sum(s) AS BIGINT) s FROM a GROUP BY 1),
ts AS (SELECT t.TRANSFORMER_CODE, TRANSFORMER_LAT LATITUDE, TRANSFORMER_LON LONGITUDE, DESCRIPTION, MAX_CAPACITY, coalesce(c,0) CURRENT_CONNECTIONS,
 MAX_CAPACITY-coalesce(c,0) HEADROOM, coalesce(s,0) SOLAR_ACCOUNTS, round(coalesce(s*100e0/nullif(c,0),0)+1e-7,1) SOLAR_PERCENTAGE FROM transformers t LEFT JOIN p USING (TRANSFORMER_CODE))"""


@query("d44_transformer_summary", ["readings", "transformers"], f"WITH {SUMMARY_SQL} SELECT * FROM ts")
def summary(t):
    return RU.transformer_summary(t("readings"), t("transformers"))


@query("d44_grand_totals", ["readings", "transformers"], f"""WITH {SUMMARY_SQL} SELECT count(*) transformers, CAST(sum(CURRENT_CONNECTIONS) AS BIGINT) connections,
 CAST(sum(SOLAR_ACCOUNTS) AS BIGINT) solar_accounts, CAST(sum(HEADROOM) AS BIGINT) headroom FROM ts""")
def totals(t):
    return RU.grand_totals(RU.transformer_summary(t("readings"), t("transformers")))


@query("d45_solar_penetration", ["readings"], """SELECT DATA_QUALITY, count(*) accounts, CAST(sum(s) AS BIGINT) solar_accounts, round(sum(s)*100e0/count(*),4) solar_pct
 FROM (SELECT DATA_QUALITY, ACCOUNT_NO, max(HAS_SOLAR) s FROM readings GROUP BY 1,2) GROUP BY 1""")
def penetration(t):
    return rounded(RU.solar_penetration(t("readings")), ["solar_pct"])


@query("d46_distance_zones", ["readings"], f"""WITH {RD_DIST} SELECT CASE WHEN d<=0 THEN NULL WHEN d<=50 THEN '0-50m' WHEN d<=100 THEN '50-100m' WHEN d<=200 THEN '100-200m' WHEN d<=300 THEN '200-300m'
 WHEN d<=400 THEN '300-400m' WHEN d<=500 THEN '400-500m' ELSE '500m+' END AS zone, count(*) n, round(count(*)*100e0/(SELECT count(*) FROM rd),4) pct FROM rd GROUP BY 1""")
def zones(t):
    return rounded(RU.distance_zones(t("readings")), ["pct"])


@query("d47_reconciliation", ["readings"], f"""WITH {RD_DIST} SELECT TRANSFORMER_CODE, count(DISTINCT ACCOUNT_NO) accounts, count(DISTINCT CASE WHEN HAS_SOLAR=1 THEN ACCOUNT_NO END) solar_accounts,
 count(*) FILTER (DATA_QUALITY='REAL') real_records, count(*) FILTER (DATA_QUALITY<>'REAL') filled_records, count(*) total_records, round(avg(d),4) avg_distance_m, round(max(d),4) max_distance_m FROM rd GROUP BY 1""")
def reconciliation(t):
    return rounded(RU.reconciliation_summary(t("readings")), ["avg_distance_m", "max_distance_m"])


@query("d48_real_patterns", ["readings"], """SELECT TRANSFORMER_CODE, round(avg(HAS_SOLAR)*100,4) solar_percentage, round(avg(NET_CONSUMPTION_kWh),6) avg_consumption,
 round(stddev_samp(NET_CONSUMPTION_kWh),4) std_consumption, round(coalesce(avg(EXPORT_kWh) FILTER (HAS_SOLAR=1),0),4) avg_export FROM readings GROUP BY 1""")
def patterns(t):
    out = rounded(RU.real_patterns(t("readings")), ["avg_consumption"], 6)
    return rounded(out, ["solar_percentage", "std_consumption", "avg_export"])


# ---- series ----------------------------------------------------------------------

W = "PARTITION BY account_id ORDER BY YEAR, MONTH"


@query("e1_lags", ["readings"], f"""SELECT account_id, YEAR, MONTH, {', '.join(f'lag(NET_CONSUMPTION_kWh,{n}) OVER ({W}) AS lag_{n}' for n in (1, 2, 3, 6, 12))} FROM readings""")
def lags(t):
    return SE.lag_features(t("readings")).select("account_id", "YEAR", "MONTH", *[f"lag_{n}" for n in SE.LAGS])


@query("e2_rolling_stats", ["readings"], "SELECT account_id, YEAR, MONTH, " + ", ".join(
    f"round({fn}(NET_CONSUMPTION_kWh) OVER ({W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING),4) AS rolling_{nm}_{n}"
    for n in (3, 6, 12) for nm, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))) + " FROM readings")
def rolling(t):
    cols = [f"rolling_{nm}_{n}" for n in SE.WINDOWS for nm in ("mean", "std", "min", "max")]
    return rounded(SE.rolling_features(t("readings")), cols).select("account_id", "YEAR", "MONTH", *cols)


@query("e3_differences", ["readings"], "SELECT account_id, YEAR, MONTH, " + ", ".join(
    f"round(NET_CONSUMPTION_kWh-lag(NET_CONSUMPTION_kWh,{n}) OVER ({W}),4) AS diff_{n}, round((NET_CONSUMPTION_kWh-lag(NET_CONSUMPTION_kWh,{n}) OVER ({W}))/nullif(lag(NET_CONSUMPTION_kWh,{n}) OVER ({W}),0)*100,4) AS pct_change_{n}"
    for n in (1, 12)) + " FROM readings")
def differences(t):
    cols = ["diff_1", "pct_change_1", "diff_12", "pct_change_12"]
    return rounded(SE.difference_features(t("readings")), cols).select("account_id", "YEAR", "MONTH", *cols)


@query("e4_ratios", ["readings"], f"SELECT account_id, YEAR, MONTH, round(NET_CONSUMPTION_kWh/nullif(avg(NET_CONSUMPTION_kWh) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),0),6) AS consumption_vs_avg, " + ", ".join(
    f"round(NET_CONSUMPTION_kWh/nullif(avg(NET_CONSUMPTION_kWh) OVER ({W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING),0),6) AS consumption_vs_rolling_{n}" for n in (3, 6, 12)) + " FROM readings")
def ratios(t):
    cols = ["consumption_vs_avg"] + [f"consumption_vs_rolling_{n}" for n in SE.WINDOWS]
    return rounded(SE.ratio_features(t("readings")), cols, 6).select("account_id", "YEAR", "MONTH", *cols)


@query("e5_fill_expanding", ["readings"], f"""WITH x AS (SELECT account_id, YEAR, MONTH, lag(NET_CONSUMPTION_kWh,3) OVER ({W}) AS l, CASE WHEN MONTH % 4 <> 0 THEN NET_CONSUMPTION_kWh END AS v FROM readings)
SELECT account_id, YEAR, MONTH, round(coalesce(l, avg(l) OVER w, 0),6) AS lag_3, round(coalesce(v, avg(v) OVER w, 0),6) AS v FROM x WINDOW w AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def fill(t):
    x = SE.lag_features(t("readings"), lags=[3]).withColumn("v", F.when(F.col("MONTH") % 4 != 0, F.col("NET_CONSUMPTION_kWh")))
    return rounded(SE.fill_expanding(x, ["lag_3", "v"]), ["lag_3", "v"], 6).select("account_id", "YEAR", "MONTH", "lag_3", "v")


@query("e7_circular_smoothing", ["readings"], """WITH p AS (SELECT account_id, MONTH, avg(NET_CONSUMPTION_kWh) v FROM readings GROUP BY 1,2)
SELECT a.account_id, a.MONTH AS month, round(b.v*0.25+a.v*0.5+c.v*0.25,4) AS v FROM p a JOIN p b ON b.account_id=a.account_id AND b.MONTH=(a.MONTH+10)%12+1
 JOIN p c ON c.account_id=a.account_id AND c.MONTH=a.MONTH%12+1""")
def smoothing(t):
    p = t("readings").groupBy("account_id", F.col("MONTH").alias("month")).agg(F.avg("NET_CONSUMPTION_kWh").alias("v"))
    return rounded(SE.smooth_circular(p, ["account_id"], "v"), ["v"])


@query("e8_sequence_windows", ["readings"], f"""WITH x AS (SELECT account_id, YEAR, MONTH, list(NET_CONSUMPTION_kWh) OVER ({W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS x,
 list(NET_CONSUMPTION_kWh) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING) AS y FROM readings)
SELECT account_id, YEAR, MONTH, round(list_sum(x),3) AS x_sum, x[1] AS x_first, round(list_sum(y),3) AS y_sum, y[12] AS y_last FROM x WHERE len(x)=12 AND len(y)=12""")
def windows(t):
    s = SE.sequences(t("readings"), ["NET_CONSUMPTION_kWh", "MONTH"], 12, 12)
    x = F.transform("x", lambda e: e["NET_CONSUMPTION_kWh"])
    return s.select("account_id", "YEAR", "MONTH", r(N.array_sum(x), 3).alias("x_sum"), F.get(x, 0).alias("x_first"),
                    r(N.array_sum(F.col("y")), 3).alias("y_sum"), F.get("y", 11).alias("y_last"))


@query("c12_densify_year", ["readings"], """WITH u AS (SELECT account_id, YEAR, avg(NET_CONSUMPTION_kWh) an, avg(EXPORT_kWh) ae, max(HAS_SOLAR) hs FROM readings WHERE MONTH IN (9,10,11) GROUP BY 1,2),
g AS (SELECT u.*, m.MONTH, s.f, s.sf FROM u CROSS JOIN (SELECT CAST(unnest(range(1,13)) AS INT) AS MONTH) m JOIN (SELECT unnest(range(1,13)) mm, unnest([0.90e0,0.95,1.15,1.25,1.20,1.00,0.95,0.90,1.00,1.10,1.05,0.95]) f,
  unnest([1.10e0,1.15,1.20,1.15,1.00,0.60,0.65,0.70,0.95,1.05,1.00,1.10]) sf) s ON s.mm=m.MONTH),
c AS (SELECT *, greatest(50e0,least(2000e0,an*f)) net, CASE WHEN hs=1 THEN least(1000e0,ae*sf) ELSE 0e0 END ex FROM g)
SELECT c.account_id, c.YEAR, c.MONTH, hs AS HAS_SOLAR, coalesce(r.IMPORT_kWh, round(least(2500e0,net+ex)+1e-7,2)) IMPORT_kWh, coalesce(r.EXPORT_kWh, round(ex+1e-7,2)) EXPORT_kWh,
 coalesce(r.NET_CONSUMPTION_kWh, round(net+1e-7,2)) NET_CONSUMPTION_kWh, coalesce(r.DATA_QUALITY,'SYNTHETIC') DATA_QUALITY
FROM c LEFT JOIN readings r ON r.account_id=c.account_id AND r.YEAR=c.YEAR AND r.MONTH=c.MONTH AND r.MONTH IN (9,10,11)""")
def densify(t):
    return SE.densify_year(t("readings"), ["account_id", "YEAR"], [9, 10, 11])


@query("h3_h8_calendar_features", ["readings"], """SELECT account_id, YEAR, MONTH, round(sin(2*pi()*(MONTH-1)/12),6) month_sin, round(cos(2*pi()*(MONTH-1)/12),6) month_cos, round(sin(2*pi()*MONTH/12),4) sin0,
 CAST((MONTH-1)//3+1 AS INT) AS quarter, CAST(MONTH AS INT) AS decoded, CASE WHEN MONTH IN (12,1,2) THEN 'NE Monsoon' WHEN MONTH IN (5,6,7,8,9) THEN 'SW Monsoon' ELSE 'Dry Season' END AS season,
 CASE WHEN MONTH IN (12,1,2) THEN 'NE_Monsoon' WHEN MONTH IN (3,4) THEN 'Dry_Season' WHEN MONTH IN (5,6,7,8,9) THEN 'SW_Monsoon' ELSE 'Inter_Monsoon' END AS season4,
 CAST(MONTH IN (5,6,9,10,11) AS INT) is_wet_season, CAST(MONTH IN (1,4,5,12) AS INT) is_holiday_month, CAST(MONTH IN (3,11) AS INT) is_pre_holiday, CAST(MONTH IN (2,6) AS INT) is_post_holiday,
 YEAR*12+MONTH time_idx, CASE WHEN MONTH=2 THEN 28 WHEN MONTH IN (4,6,9,11) THEN 30 ELSE 31 END dim, CAST(YEAR+(MONTH+2)//12 AS INT) y3, CAST((MONTH+2)%12+1 AS INT) m3,
 least(abs(MONTH-9),12-abs(MONTH-9)) circ, (YEAR-1995)*12+MONTH-1 lead FROM readings""")
def calendar(t):
    m, y = F.col("MONTH"), F.col("YEAR")
    s, c = CAL.encode_cyclic(m, 12, 1)
    f = CAL.season_flags(m)
    y3, m3 = CAL.add_months(y, m, F.lit(3))
    return t("readings").select("account_id", "YEAR", "MONTH", r(s, 6).alias("month_sin"), r(c, 6).alias("month_cos"), r(CAL.encode_cyclic(m, 12)[0]).alias("sin0"),
                                CAL.quarter_of(m).alias("quarter"), CAL.decode_month(s, c).alias("decoded"), CAL.season(m).alias("season"),
                                CAL.validation_season(m).alias("season4"), *[f[k].alias(k) for k in ("is_wet_season", "is_holiday_month", "is_pre_holiday", "is_post_holiday")],
                                CAL.time_index(y, m).alias("time_idx"), CAL.days_in_month(m).alias("dim"), y3.alias("y3"), m3.alias("m3"),
                                CAL.circular_month_distance(m, F.lit(9)).alias("circ"), CAL.lead_time(F.lit(1995), F.lit(1), y, m).alias("lead"))


@query("h3_event_cyclic_encoders", [], """SELECT event_id, round(sin(2*pi()*hour(ts)/24),6) hour_sin, round(cos(2*pi()*hour(ts)/24),6) hour_cos, round(sin(2*pi()*dayofweek(ts)/7),6) dow_sin,
 round(cos(2*pi()*dayofweek(ts)/7),6) dow_cos, round(sin(2*pi()*(day(ts)-1)/30),6) dom_sin, round(cos(2*pi()*(day(ts)-1)/30),6) dom_cos, round(sin(2*pi()*(week(ts)-1)/52),6) week_sin,
 round(cos(2*pi()*(week(ts)-1)/52),6) week_cos, round(sin(2*pi()*(quarter(ts)-1)/4),6) quarter_sin, round(cos(2*pi()*(quarter(ts)-1)/4),6) quarter_cos FROM events""")
def event_encoders(t):
    ts = F.col("ts")
    cols = CAL.cyclic_features(day_of_week=F.dayofweek(ts) - 1, hour=F.hour(ts), day=F.dayofmonth(ts), week=F.weekofyear(ts), quarter=F.quarter(ts))
    return t("events").select("event_id", *[r(c, 6).alias(n) for n, c in cols.items()])


@query("h53_h60_formatting", ["readings"], """SELECT account_id, YEAR, MONTH, CASE WHEN v>=1000000 THEN printf('Rs. %.2fM', v/1000000) WHEN v>=1000 THEN printf('Rs. %.1fK', v/1000) ELSE printf('Rs. %.0f', v) END cur,
 CASE WHEN k>=1000 THEN printf('%.1f MWh', k/1000) ELSE printf('%.0f kWh', k) END con, monthname(make_date(YEAR,MONTH,1)) mon, CAL_TARIFF='D1' AS is_d1, CAST(CAL_TARIFF='GP1' AS INT) tariff_GP1,
 CAST(PHASE='TP' AS INT) phase_TP, round(coalesce(EXPORT_kWh/nullif(INV_CAPACITY,0),0),4) ratio, CASE WHEN NET_CONSUMPTION_kWh<=0 THEN NULL WHEN NET_CONSUMPTION_kWh<=90 THEN 'Low' WHEN NET_CONSUMPTION_kWh<=150 THEN 'Medium-Low' WHEN NET_CONSUMPTION_kWh<=300 THEN 'Medium-High' WHEN NET_CONSUMPTION_kWh<=2000 THEN 'High' END lvl
 FROM (SELECT *, IMPORT_kWh*4011.37e0 v, IMPORT_kWh*4.013e0 k FROM readings)""")
def formatting(t):
    oh = {**N.one_hot(F.col("CAL_TARIFF"), C.VALID_TARIFFS, "tariff"), **N.one_hot(F.col("PHASE"), C.VALID_PHASES, "phase")}
    return t("readings").select("account_id", "YEAR", "MONTH", TX.format_currency(F.col("IMPORT_kWh") * 4011.37).alias("cur"),
                                TX.format_consumption(F.col("IMPORT_kWh") * 4.013).alias("con"), CAL.month_name(F.col("MONTH")).alias("mon"),
                                (F.upper(F.trim(F.lower("CAL_TARIFF"))) == "D1").alias("is_d1"), oh["tariff_GP1"].alias("tariff_GP1"), oh["phase_TP"].alias("phase_TP"),
                                r(N.safe_divide(F.col("EXPORT_kWh"), F.col("INV_CAPACITY"))).alias("ratio"),
                                N.right_closed_bin(F.col("NET_CONSUMPTION_kWh"), [0, 90, 150, 300, 2000], ["Low", "Medium-Low", "Medium-High", "High"]).alias("lvl"))
