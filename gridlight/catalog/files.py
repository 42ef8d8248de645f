"""Round trips through the readers and writers, in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridlight.catalog.base import query
from gridlight.session import shared_folder
from gridlight.sources import readers as RD, sinks as SK


def folder(t, name: str) -> str:
    return f"{shared_folder(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("a1_a15_readings_round_trip", ["readings"], """SELECT account_id, ACCOUNT_NO, TRANSFORMER_CODE, YEAR, MONTH, round("IMPORT_kWh",4) AS "IMPORT_kWh", round("NET_CONSUMPTION_kWh",4) AS "NET_CONSUMPTION_kWh", DATA_QUALITY AS "SOURCE" FROM readings""")
def readings_round_trip(t):
    path = folder(t, "readings")
    SK.write_readings(t("readings").withColumnRenamed("DATA_QUALITY", "SOURCE"), path)
    return RD.read_readings(t.spark, path).select("account_id", "ACCOUNT_NO", "TRANSFORMER_CODE", "YEAR", "MONTH", F.round("IMPORT_kWh", 4).alias("IMPORT_kWh"),
                                                  F.round("NET_CONSUMPTION_kWh", 4).alias("NET_CONSUMPTION_kWh"), "SOURCE")


@query("a3_customer_sheets", ["accounts"], """WITH a AS (SELECT *, CAST(substr(TRANSFORMER_CODE, 3) AS INT) % 3 kind FROM accounts)
SELECT ACCOUNT_NO, TRANSFORMER_CODE, "INV_CAPACITY", CASE kind WHEN 0 THEN "CAL_TARIFF" ELSE 'D1' END AS "CAL_TARIFF", CASE kind WHEN 0 THEN 'SP' ELSE PHASE END AS PHASE, CASE WHEN "INV_CAPACITY" > 0 THEN 1 ELSE 0 END AS "HAS_SOLAR", NULL AS problem FROM a WHERE kind < 2
UNION ALL SELECT DISTINCT NULL, TRANSFORMER_CODE, NULL, NULL, NULL, NULL, 'no account column' FROM a WHERE kind = 2""")
def customer_sheets(t):
    """Sheets of three kinds: as expected; the capacity only to be told by its numbers; no column of accounts."""
    kinds = [{"Account No": "ACCOUNT_NO", "Inv. Capacity (kW)": "INV_CAPACITY", "CAL TARIFF": "CAL_TARIFF"},
             {"ACCOUNT": "ACCOUNT_NO", "Phase": "PHASE", "Remark": "concat('no ', account_id)", "Rating": "INV_CAPACITY", "Serial": "account_id"}, {"Customer": "ACCOUNT_NO", "Inv Capacity": "INV_CAPACITY"}]
    base = folder(t, "sheets")
    for kind, columns in enumerate(kinds):
        rows = t("accounts").where(F.expr(f"CAST(substr(TRANSFORMER_CODE, 3) AS INT) % 3 = {kind}"))
        rows.select("TRANSFORMER_CODE", *[F.expr(e).alias(c) for c, e in columns.items()]).repartition("TRANSFORMER_CODE").write.mode("append").partitionBy("TRANSFORMER_CODE").csv(base, header=True)
    out = RD.read_customer_sheets(t.spark, base, "*/*.csv", r"TRANSFORMER_CODE=([^/]+)/")
    return out.select("ACCOUNT_NO", "TRANSFORMER_CODE", "INV_CAPACITY", "CAL_TARIFF", "PHASE", "HAS_SOLAR", "problem")


@query("a4_month_files", ["readings"], """SELECT ACCOUNT_NO, TRANSFORMER_CODE, CAST(1 + MONTH % 3 AS INT) AS "MONTH", YEAR, round(sum("IMPORT_kWh"),2) import_kwh, CASE WHEN MONTH % 3 = 2 THEN 0e0 ELSE round(sum("EXPORT_kWh"),2) END export_kwh, NULL AS problem
 FROM readings GROUP BY ACCOUNT_NO, TRANSFORMER_CODE, YEAR, MONTH % 3""")
def month_files(t):
    """Three sets of files with their columns in other orders and under other headers; the last has no export."""
    heads = [["Account No", "Import Total (kWh)", "EXPORT TOTAL"], ["Total export", "ACCOUNT_NO", "total import"], ["IMPORT_TOTAL", "account"]]
    manifest, paths = None, []
    for part, head in enumerate(heads):
        rows = t("readings").where(F.col("MONTH") % 3 == part).groupBy("YEAR", "TRANSFORMER_CODE", "ACCOUNT_NO").agg(F.sum("IMPORT_kWh").alias("i"), F.sum("EXPORT_kWh").alias("e"))
        of = lambda h: F.col("ACCOUNT_NO" if "account" in h.lower() else "i" if "import" in h.lower() else "e").alias(h)
        path = folder(t, f"months-{part}")
        rows.select("YEAR", "TRANSFORMER_CODE", *[of(h) for h in head]).repartition("YEAR", "TRANSFORMER_CODE").write.partitionBy("YEAR", "TRANSFORMER_CODE").csv(path, header=True)
        files = t.spark.read.text(f"{path}/*/*/*.csv").select(F.col("_metadata.file_path").alias("path")).distinct()
        files = files.select("path", F.regexp_extract("path", "TRANSFORMER_CODE=([^/]+)", 1).alias("TRANSFORMER_CODE"), F.lit(1 + part).alias("MONTH"), F.regexp_extract("path", "YEAR=([^/]+)", 1).cast("int").alias("YEAR"))
        manifest = files if manifest is None else manifest.unionByName(files)
        paths.append(f"{path}/*/*/*.csv")
    out = RD.read_month_files(t.spark, manifest, paths)
    return out.select("ACCOUNT_NO", "TRANSFORMER_CODE", "MONTH", "YEAR", F.round("IMPORT_kWh", 2).alias("import_kwh"), F.round("EXPORT_kWh", 2).alias("export_kwh"), "problem")


@query("a12_a16_requests_round_trip", ["users"], "SELECT user_id, latitude, longitude, kwh_m09 september, kwh_m10 october, tariff, has_solar FROM users")
def requests_round_trip(t):
    path = folder(t, "requests")
    months = F.create_map(F.lit("9:2025"), "kwh_m09", F.lit(" 10 "), "kwh_m10", F.lit("x"), F.lit(1.0))
    SK.write_json(t("users").withColumn("consumption_months", months).drop("kwh_m09", "kwh_m10", "kwh_m11"), path)
    got = RD.read_requests(t.spark, path)
    return got.select("user_id", "latitude", "longitude", F.col("consumption_months")[9].alias("september"), F.col("consumption_months")[10].alias("october"), "tariff", "has_solar")


@query("a17_append_log", ["users"], "SELECT user_id, tariff, CAST(count(*) AS BIGINT) AS entries FROM (SELECT user_id, tariff FROM users UNION ALL SELECT user_id, tariff FROM users WHERE has_solar = 1) GROUP BY 1,2")
def append_log(t):
    path = folder(t, "log")
    rows = t("users").select("user_id", "tariff", "has_solar")
    SK.append_log(rows, path)
    SK.append_log(rows.where("has_solar = 1"), path)
    return t.spark.read.schema("user_id long, tariff string, logged_at string").json(path).groupBy("user_id", "tariff").agg(F.count(F.lit(1)).alias("entries"))


@query("a18_parameters_round_trip", ["readings"], "SELECT TRANSFORMER_CODE, round(avg(\"IMPORT_kWh\"),6) AS mean, CAST(count(*) AS BIGINT) AS n FROM readings GROUP BY 1")
def parameters_round_trip(t):
    path = folder(t, "parameters")
    SK.write_parameters(t("readings").groupBy("TRANSFORMER_CODE").agg(F.round(F.avg("IMPORT_kWh"), 6).alias("mean"), F.count(F.lit(1)).alias("n")), path)
    return t.spark.read.parquet(path)
