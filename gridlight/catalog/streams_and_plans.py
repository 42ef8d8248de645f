"""Streaming jobs run to completion over the event table, and the all-in-one plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlight import constants as C
from gridlight.catalog.base import query
from gridlight.catalog.households import FC_SQL, requests, sites
from gridlight.catalog.solar_and_finance import solar_frame
from gridlight.catalog.tables_and_bills import LEDGER_SQL, r, rounded
from gridlight.plans import assessment as AS, consumption as CO, integrated as IN, solar_training as ST
from gridlight.streaming import jobs as J

def event_stream(t):
    stream = J.read_stream(t.spark, t.folder, t("events").schema, "events.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def event_rows(t):
    return t("events").withColumn("ts", F.col("ts").cast("timestamp"))


def plain_times(df):
    """Window bounds without a zone, as the event table has them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end") if c in df.columns})


@query("j1_error_monitor", [], """WITH e AS (SELECT date_trunc('day', ts) AS s, event_type, abs(value - CAST(json_extract_string(props,'$.k') AS DOUBLE)) er FROM events)
 SELECT s AS start, s + INTERVAL 1 DAY AS "end", event_type, round(avg(er),6) mae, count(*) n_samples FROM e GROUP BY 1,2,3""")
def error_monitor(t):
    k = F.get_json_object("props", "$.k").cast("double")
    job = lambda df: J.error_monitor(df, F.col("value"), k, keys=["event_type"])
    return plain_times(J.run_to_end(job, event_stream(t), event_rows(t), "error_monitor", "1 day")).withColumn("mae", r("mae", 6))


@query("j1_drift_alerts", [], """WITH e AS (SELECT date_trunc('day', ts) AS s, event_type, abs(value - CAST(json_extract_string(props,'$.k') AS DOUBLE)) er FROM events),
m AS (SELECT s, event_type, avg(er) mae, count(*) n FROM e GROUP BY 1,2 HAVING s + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events)),
d AS (SELECT *, count(*) OVER b nb, avg(mae) OVER a ra, avg(mae) OVER b rb, stddev_pop(mae) OVER b sb FROM m
 WINDOW a AS (PARTITION BY event_type ORDER BY s ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), b AS (PARTITION BY event_type ORDER BY s ROWS BETWEEN 11 PRECEDING AND 6 PRECEDING)),
z AS (SELECT *, (ra-rb)/nullif(sb,0) z FROM d WHERE nb=6)
SELECT s AS start, event_type, n AS n_samples, round(mae,6) mae, round(ra,6) recent_mae, round(rb,6) baseline_mae, round(z,4) z_score, CASE WHEN abs(z)>1.5 THEN 'high' ELSE 'medium' END severity FROM z WHERE abs(z)>1""")
def drift_alerts(t):
    """Alerts of every finished day that is off by more than one deviation, the events landing in four runs of one query."""
    rows = event_rows(t)
    folder, base = J.new_base(t.spark, "events"), J.new_base(t.spark, "drift")
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    quarter = F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(first))) * 4 / (F.unix_micros(F.lit(last)) - F.unix_micros(F.lit(first)) + 1))
    k = F.get_json_object("props", "$.k").cast("double")
    for part in range(4):
        rows.where(quarter == part).write.mode("append").parquet(folder)
        monitor = J.error_monitor(J.read_stream(t.spark, folder, rows.schema), F.col("value"), k, keys=["event_type"])
        J.drift_on_batches(monitor, base, f"{base}/checkpoint", ["event_type"], threshold=1.0).start().awaitTermination()
    out = plain_times(t.spark.read.parquet(f"{base}/alerts"))
    out = out.withColumns({c: r(c, 6) for c in ("mae", "recent_mae", "baseline_mae")}).withColumn("z_score", r("z_score"))
    return out.select("start", "event_type", "n_samples", "mae", "recent_mae", "baseline_mae", "z_score", "severity")


@query("j2_streaming_ledger", ["readings"], LEDGER_SQL + " SELECT account_id, YEAR, MONTH, round(net,2) net_kwh, round(bill+1e-7,2) bill_lkr, round(used,2) credits_used, round(balance+1e-7,2) credit_balance FROM l")
def streaming_ledger(t):
    """All readings, landed in four runs of one query: the years up to 1994, the later ones, then a second reading of
    every June, and at last the months of March that a fifth of the accounts sent late."""
    rows = t("readings").select("account_id", "YEAR", "MONTH", "IMPORT_kWh", (F.col("EXPORT_kWh") * 3).alias("EXPORT_kWh"), "CAL_TARIFF")
    late = (F.col("MONTH") == 3) & (F.col("account_id") % 5 == 0)
    share = lambda x: rows.withColumns({c: F.when(F.col("MONTH") == 6, F.col(c) * x).otherwise(F.col(c)) for c in ("IMPORT_kWh", "EXPORT_kWh")})
    parts = [share(0.25).where(~late & (F.col("YEAR") <= 1994)), share(0.25).where(~late & (F.col("YEAR") > 1994)), share(0.75).where(F.col("MONTH") == 6), rows.where(late)]
    folder, base = J.new_base(t.spark, "readings"), J.new_base(t.spark, "ledger")
    for part in parts:
        part.write.mode("append").parquet(folder)
        log = J.run_to_table(J.streaming_ledger(J.read_stream(t.spark, folder, rows.schema)), "ledger", base=base, rocksdb=True)
    out = rounded(J.latest_revisions(log), ["net_kwh", "credits_used"], 2)
    return out.withColumns({c: F.round(F.col(c) + 1e-7, 2) for c in ("bill_lkr", "credit_balance")})


@query("j3_quality_counters", [], """SELECT date_trunc('day', ts) AS start, count(*) AS "rows", count(*)-count(value) nulls, count(*) FILTER (value<0) negatives, count(*) FILTER (value<0 OR value>50) out_of_range FROM events GROUP BY 1""")
def quality_counters(t):
    return plain_times(J.run_to_end(lambda df: J.quality_counters(df, hi=50.0), event_stream(t), event_rows(t), "quality", "1 day").drop("end"))


@query("j4_sliding_profile", [], """WITH w AS (SELECT user_id, value, date_trunc('day', ts) - to_days(CAST(k AS INT)) AS s FROM events CROSS JOIN (SELECT unnest(range(0,7)) k))
 SELECT s AS start, s + INTERVAL 7 DAY AS "end", user_id, round(sum(value),4) total, round(avg(value),6) mean, count(*) n FROM w GROUP BY 1,2,3""")
def sliding_profile(t):
    out = plain_times(J.run_to_end(J.sliding_profile, event_stream(t), event_rows(t), "sliding", "7 days"))
    return out.withColumns({"total": r("total"), "mean": r("mean", 6)})


@query("j4_session_profile", [], """WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) k FROM g)
 SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", user_id, round(sum(value),4) total, count(*) n FROM s GROUP BY user_id, k""")
def session_profile(t):
    return plain_times(J.run_to_end(J.session_profile, event_stream(t), event_rows(t), "session", None, key="user_id")).withColumn("total", r("total"))


@query("c19_integrated_analysis", ["users", "readings"])
def integrated(t):
    yields = solar_frame(t).groupBy("MONTH").agg(F.avg("Efficiency").alias("Efficiency"))
    return IN.analyse(requests(t), t("readings"), yields, max_radius_m=2000.0)


# the flow keeps plausible readings only, so its profiles start from those
BILLS_SQL = "WITH rok AS (SELECT * FROM readings WHERE NET_CONSUMPTION_kWh BETWEEN 10 AND 2000), " + FC_SQL.replace("FROM readings GROUP BY 1,2,3)", "FROM rok GROUP BY 1,2,3)") + """,
ua AS (SELECT user_id, avg(k) ua FROM um GROUP BY 1), ma AS (SELECT user_id, avg(kwh) ma FROM fc GROUP BY 1),
kk AS (SELECT user_id, month, tariff, kwh*ua/ma k FROM fc JOIN ua USING (user_id) JOIN ma USING (user_id) JOIN users USING (user_id)),
bk AS (SELECT * FROM (VALUES ('D1',0e0,31e0,8e0),('D1',31e0,30e0,10e0),('D1',61e0,30e0,16e0),('D1',91e0,30e0,50e0),('D1',121e0,60e0,75e0),('D1',181e0,9819e0,100e0),('GP1',0e0,101e0,45e0),('GP1',101e0,9899e0,55e0)) AS v(bt,below,size,rate)),
en AS (SELECT user_id, month, any_value(k) k, sum(greatest(0e0,least(k-below,size))*rate) e, CASE WHEN any_value(tariff)='GP1' THEN 240e0 ELSE 180e0 END f FROM kk JOIN bk ON bt=tariff GROUP BY 1,2)
SELECT user_id, round(sum(k),3) total_consumption_kwh, round(sum(round((e*1.18e0+f)*1.18e0+1e-7,2)),2) total_bill_lkr FROM en GROUP BY 1"""


@query("plan_consumption_bills", ["users", "readings"], BILLS_SQL)
def consumption_bills(t):
    u = requests(t)
    a = CO.annual(CO.bills(CO.forecast(u, t("readings")), u))
    return a.select("user_id", r("total_consumption_kwh", 3).alias("total_consumption_kwh"), r("total_bill_lkr", 2).alias("total_bill_lkr"))


@query("plan_solar_training_table", ["readings", "weather", "weather_history"])
def training_table(t):
    table = ST.training_table(t("readings"), t("weather"), t("weather_history"), 1995, 1998)
    train, test = ST.split_and_clean(table)
    return train.groupBy("Month").agg(F.count(F.lit(1)).alias("n"), F.avg("Efficiency").alias("mean_efficiency"))


@query("plan_transformer_assessment", ["users", "readings"])
def assessment(t):
    out = AS.assess_sites(sites(t), AS.transformer_table(t("readings")), max_radius_m=2000.0)
    return out.select("user_id", "TRANSFORMER_CODE", "rank", "score", "ml_score", "risk_tier", "future_load_kW", "label")
