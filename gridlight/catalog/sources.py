"""Documents and texts made from the tables, parsed back; joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlight import constants as C
from gridlight.catalog.base import query
from gridlight.catalog.tables_and_bills import r, rounded
from gridlight.operators import finance as FI, rollup as RU, splits as SP
from gridlight.sources import readers as RD, sinks as SK

PARAMS = {p: c for p, c in C.WEATHER_PARAMETERS.items() if c in ("Solar_Irradiance_GHI", "Temperature", "Humidity", "Clear_Sky_GHI")}


def weather_docs(t, per=("SITE_ID",)):
    """Weather rows as service documents with missing values as -999."""
    w = t("weather")
    period = F.concat(F.col("Year").cast("string"), F.lpad(F.col("Month").cast("string"), 2, "0"))
    series = [F.map_from_entries(F.collect_list(F.struct(period, F.coalesce(F.col(c), F.lit(-999.0))))).alias(p) for p, c in PARAMS.items()]
    docs = w.groupBy(*per).agg(*series)
    return docs.select(*per, F.to_json(F.struct(F.struct(F.struct(*PARAMS).alias("parameter")).alias("properties"))).alias("doc"))


@query("a8_a10_monthly_weather_json", ["weather"], 'SELECT SITE_ID, Year, Month, Solar_Irradiance_GHI, Temperature, Humidity, Clear_Sky_GHI FROM weather')
def weather_json(t):
    return RD.monthly_weather(weather_docs(t), "doc", ["SITE_ID"], PARAMS)


@query("a9_climatology_json", ["weather_history"], "SELECT SITE_ID, Month, round(avg(Temperature),6) \"Temperature\", round(avg(Humidity),6) \"Humidity\" FROM weather_history GROUP BY 1,2")
def climatology(t):
    names = F.array(*[F.lit(k) for k in C.CLIMATOLOGY_KEYS])
    c = t("weather_history").groupBy("SITE_ID", "Month").agg(F.avg("Temperature").alias("t"), F.avg("Humidity").alias("h"))
    docs = c.groupBy("SITE_ID").agg(*[F.map_from_entries(F.collect_list(F.struct(F.get(names, F.col("Month") - 1), F.col(x)))).alias(p) for p, x in (("T2M", "t"), ("RH2M", "h"))])
    docs = docs.select("SITE_ID", F.to_json(F.struct(F.struct(F.struct("T2M", "RH2M").alias("parameter")).alias("properties"))).alias("doc"))
    return rounded(RD.climatology_weather(docs, "doc", ["SITE_ID"], {"T2M": "Temperature", "RH2M": "Humidity"}), ["Temperature", "Humidity"], 6)


@query("a11_weather_cache", [], """SELECT round(user_id%50/7e0,4) latitude, round(user_id%30/9e0,4) longitude, CAST(2024 AS INT) AS year, arg_max(props, ts) AS document, max(ts) ingested_at FROM events
 WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY GROUP BY 1,2""")
def weather_cache(t):
    cache = t("events").select((F.col("user_id") % 50 / 7.0).alias("latitude"), (F.col("user_id") % 30 / 9.0).alias("longitude"), F.lit(2024).alias("year"), F.col("props").alias("document"), F.col("ts").alias("ingested_at"))
    now = cache.agg(F.max("ingested_at")).scalar()
    return RD.cached_weather(cache, now, 10)


@query("a12_a13_request_months", ["users"], "SELECT user_id, kwh_m09, kwh_m10, CAST(2 AS INT) AS n FROM users")
def request_months(t):
    u = t("users")
    text = F.concat(F.lit("9:"), F.col("kwh_m09").cast("string"), F.lit(",10:"), F.col("kwh_m10").cast("string"))
    m = u.select("user_id", RD.parse_month_text(text).alias("a"), RD.month_keys(F.create_map(F.lit("9:2025"), "kwh_m09", F.lit("10"), "kwh_m10")).alias("b"))
    return m.select("user_id", F.element_at("a", 9).alias("kwh_m09"), F.element_at("b", 10).alias("kwh_m10"), F.size("b").alias("n"))


@query("a14_market_prices", ["systems", "vendor_prices"], "SELECT vendor, size_kw, price_lkr, count(*) AS n FROM vendor_prices JOIN systems USING (size_kw) GROUP BY 1,2,3")
def market(t):
    # the vendor list as one market document, read back and joined to the systems of exactly that size
    pts = t("vendor_prices").groupBy("vendor").agg(F.map_from_entries(F.collect_list(F.struct(F.col("size_kw").cast("string"), "price_lkr"))).alias("pricing"))
    doc = pts.agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("vendor").alias("Name"), "pricing")).alias("vendors"))).alias("doc"))
    v = doc.select(F.explode(F.from_json("doc", RD.MARKET_SCHEMA)["vendors"]).alias("v")).select(F.col("v.Name").alias("vendor"), F.explode("v.pricing").alias("k", "price_lkr"))
    v = v.select("vendor", F.col("k").cast("double").alias("size_kw"), "price_lkr")
    return t("systems").join(v, "size_kw").groupBy("vendor", "size_kw", "price_lkr").agg(F.count(F.lit(1)).alias("n"))


PAGES = """px AS (SELECT page_id, CASE WHEN page_id%3=0 THEN concat(url,'/5kw-on-grid') ELSE url END url, concat(html, CASE page_id%3 WHEN 0 THEN concat('<p class="price">LKR ', CAST(700000+page_id*100 AS VARCHAR), '.00</p>')
 WHEN 1 THEN concat('<div>8kW <b>starting from</b> Rs. ', CAST(1300000+page_id*10 AS VARCHAR), '</div>') ELSE concat('<p>10kW system LKR ', CAST(1700000+page_id*10 AS VARCHAR), ' - ', CAST(1900000+page_id*10 AS VARCHAR), '</p>') END) html FROM pages)"""
PRICE_SQL = PAGES + """, tx AS (SELECT page_id, url, html, regexp_replace(html, '<[^>]*>', ' ', 'gs') t FROM px), sz AS (SELECT unnest([3,5,8,10,15,20]) s),
f AS (SELECT page_id, s AS size_kw, 'price_node' AS rule, CASE WHEN regexp_extract(lower(url),'/(\\d+)kw-',1)=CAST(s AS VARCHAR) THEN TRY_CAST(regexp_replace(split_part(regexp_extract(html,'<p[^>]*class="price"[^>]*>(.*?)</p>',1,'is'),'.',1),'\\D','','g') AS BIGINT) END p FROM tx, sz
 UNION ALL SELECT page_id, s, 'starting_from', TRY_CAST(regexp_replace(regexp_extract(t, concat('\\b',CAST(s AS VARCHAR),'kW.*?starting from.*?Rs\\.?\\s*([\\d,]+)'),1,'is'),'\\D','','g') AS BIGINT) FROM tx, sz
 UNION ALL SELECT page_id, s, 'price_range', CAST(floor((TRY_CAST(regexp_replace(regexp_extract(t, concat('\\b',CAST(s AS VARCHAR),'kW system.*?LKR\\s*([\\d,]+)\\s*[-–]\\s*([\\d,]+)'),1,'i'),'\\D','','g') AS BIGINT)+TRY_CAST(regexp_replace(regexp_extract(t, concat('\\b',CAST(s AS VARCHAR),'kW system.*?LKR\\s*([\\d,]+)\\s*[-–]\\s*([\\d,]+)'),2,'i'),'\\D','','g') AS BIGINT))/2) AS BIGINT) FROM tx, sz),
vp AS (SELECT page_id, size_kw, rule, p AS price_lkr FROM f WHERE p>300000 AND p<6000000)"""


def priced_pages(t):
    k, pid = F.col("page_id") % 3, F.col("page_id")
    extra = (F.when(k == 0, F.concat(F.lit('<p class="price">LKR '), (700000 + pid * 100).cast("string"), F.lit(".00</p>")))
             .when(k == 1, F.concat(F.lit("<div>8kW <b>starting from</b> Rs. "), (1300000 + pid * 10).cast("string"), F.lit("</div>")))
             .otherwise(F.concat(F.lit("<p>10kW system LKR "), (1700000 + pid * 10).cast("string"), F.lit(" - "), (1900000 + pid * 10).cast("string"), F.lit("</p>"))))
    return t("pages").select("page_id", F.when(k == 0, F.concat("url", F.lit("/5kw-on-grid"))).otherwise(F.col("url")).alias("url"), F.concat("html", extra).alias("html"))


@query("a20_vendor_page_prices", [], f"WITH {PRICE_SQL} SELECT * FROM vp")
def page_prices(t):
    return RD.vendor_page_prices(priced_pages(t))


@query("d49_median_prices", [], f"WITH {PRICE_SQL}, m AS (SELECT size_kw, CAST(trunc(quantile_cont(price_lkr,0.5)) AS INT) m, count(*) n FROM vp GROUP BY 1) SELECT d.size_kw, coalesce(m,old) price_lkr, coalesce(n,0) sources FROM (SELECT unnest([3,5,8,10,15,20]) size_kw, unnest([750000,800000,1450000,1800000,2600000,2900000]) AS old) d LEFT JOIN m USING (size_kw)")
def median_prices(t):
    return FI.median_prices(RD.vendor_page_prices(priced_pages(t)))


@query("a21_discount_rate", ["readings"], """WITH v AS (SELECT account_id, YEAR, CASE WHEN YEAR<2001 THEN round(avg(NET_CONSUMPTION_kWh)/20,3) END i FROM readings GROUP BY 1,2) SELECT account_id, max(i) FILTER (YEAR=2000) inflation_pct, round(max(i) FILTER (YEAR=2000)/100+1e-9,3)+0.045e0 discount_rate FROM v GROUP BY 1""")
def discount(t):
    v = t("readings").groupBy("account_id", "YEAR").agg(F.round(F.avg("NET_CONSUMPTION_kWh") / 20, 3).alias("i"))
    rows = F.collect_list(F.struct(F.col("YEAR").cast("string").alias("date"), F.when(F.col("YEAR") < 2001, F.col("i")).alias("value")))
    doc = v.groupBy("account_id").agg(F.concat(F.lit('[{"page":1},'), F.to_json(rows), F.lit("]")).alias("doc"))
    return RD.discount_rate(doc, "doc", ["account_id"])


@query("a22_f4_seeded_sample", ["readings"], """SELECT account_id, YEAR, MONTH, "NET_CONSUMPTION_kWh" FROM readings ORDER BY md5(concat_ws('|', account_id, YEAR, MONTH, 42)), account_id, YEAR, MONTH LIMIT 5000""")
def sample(t):
    return SP.hash_sample(t("readings").select("account_id", "YEAR", "MONTH", "NET_CONSUMPTION_kWh"), 5000, ["account_id", "YEAR", "MONTH"])


@query("c2_rollup_join", ["readings"], """WITH c AS (SELECT TRANSFORMER_CODE, avg(NET_CONSUMPTION_kWh) a FROM readings GROUP BY 1), s AS (SELECT TRANSFORMER_CODE, sum(cap) cap FROM (SELECT TRANSFORMER_CODE, ACCOUNT_NO, max(INV_CAPACITY) cap FROM readings GROUP BY 1,2) GROUP BY 1)
 SELECT TRANSFORMER_CODE, round(a,6) avg_consumption, coalesce(cap,0) total_solar_capacity FROM c LEFT JOIN s USING (TRANSFORMER_CODE)""")
def rollup_join(t):
    cons = t("readings").groupBy("TRANSFORMER_CODE").agg(r(F.avg("NET_CONSUMPTION_kWh"), 6).alias("avg_consumption"))
    solar = RU.customers_once(t("readings")).groupBy("TRANSFORMER_CODE").agg(F.sum("INV_CAPACITY").alias("total_solar_capacity"))
    return cons.join(solar, "TRANSFORMER_CODE", "left").fillna(0.0, ["total_solar_capacity"])


@query("c3_attach_customers", ["readings", "accounts"], """SELECT r.account_id, r.YEAR, r.MONTH, CASE WHEN r.account_id%10=0 THEN 0 ELSE a.HAS_SOLAR END HAS_SOLAR, CASE WHEN r.account_id%10=0 THEN 0e0 ELSE a.INV_CAPACITY END INV_CAPACITY,
 CASE WHEN r.account_id%10=0 THEN 'D1' ELSE a.CAL_TARIFF END CAL_TARIFF, CASE WHEN r.account_id%10=0 THEN 'SP' ELSE a.PHASE END PHASE FROM readings r JOIN accounts a USING (account_id)""")
def customers(t):
    # every tenth account has no master row, and every row of the master comes twice
    master = t("accounts").where("account_id % 10 <> 0")
    master = master.unionByName(master)
    base = t("readings").select("account_id", "TRANSFORMER_CODE", "ACCOUNT_NO", "YEAR", "MONTH")
    return RD.attach_customers(base, master).drop("TRANSFORMER_CODE", "ACCOUNT_NO")


@query("g1_g5_sources", ["readings"], """SELECT src AS "SOURCE", count(*) n, count(DISTINCT ACCOUNT_NO) accounts, count(extra) extras FROM (SELECT ACCOUNT_NO, 'REAL' src, NULL::INT extra FROM readings WHERE DATA_QUALITY='REAL' UNION ALL SELECT ACCOUNT_NO, 'SYNTHETIC', 1 FROM readings WHERE DATA_QUALITY<>'REAL') GROUP BY 1""")
def sources(t):
    base = t("readings").select("ACCOUNT_NO", "DATA_QUALITY")
    real = base.where("DATA_QUALITY = 'REAL'").withColumn("SOURCE", F.lit("REAL"))
    synthetic = base.where("DATA_QUALITY <> 'REAL'").withColumns({"SOURCE": F.lit("SYNTHETIC"), "extra": F.lit(1)})
    a, b = SK.split_by_source(SK.union_sources(real, synthetic))
    return SK.union_sources(a, b).groupBy("SOURCE").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ACCOUNT_NO").alias("accounts"), F.count("extra").alias("extras"))


@query("g2_distinct_accounts", ["readings"], "SELECT DISTINCT ACCOUNT_NO FROM readings WHERE MONTH IN (9,10,11)")
def distinct_accounts(t):
    months = [t("readings").where(F.col("MONTH") == m).select("ACCOUNT_NO") for m in (9, 10, 11)]
    return SK.union_sources(*months).distinct()


@query("g3_set_intersection", ["order_months"], "SELECT account_id FROM order_months WHERE YEAR=1996 INTERSECT SELECT account_id FROM order_months WHERE YEAR=1997")
def intersection(t):
    o = t("order_months")
    return o.where("YEAR = 1996").select("account_id").intersect(o.where("YEAR = 1997").select("account_id"))


@query("g4_missing_months", ["order_months"], "SELECT account_id, YEAR, CAST(12-count(*) AS INT) n_missing FROM order_months GROUP BY 1,2")
def missing_months(t):
    have = t("order_months").groupBy("account_id", "YEAR").agg(F.collect_set("MONTH").alias("m"))
    return have.select("account_id", "YEAR", F.size(F.array_except(F.sequence(F.lit(1), F.lit(12)), "m")).alias("n_missing"))


@query("f1_f2_top_features", ["readings"], "SELECT TRANSFORMER_CODE, round(avg(NET_CONSUMPTION_kWh),6) m FROM readings GROUP BY 1 ORDER BY round(avg(NET_CONSUMPTION_kWh),6) DESC, TRANSFORMER_CODE LIMIT 15")
def top_rows(t):
    return t("readings").groupBy("TRANSFORMER_CODE").agg(r(F.avg("NET_CONSUMPTION_kWh"), 6).alias("m")).orderBy(F.col("m").desc(), "TRANSFORMER_CODE").limit(15)


@query("h56_h61_arrays", ["readings"], """WITH p AS (SELECT account_id, YEAR, list(NET_CONSUMPTION_kWh ORDER BY MONTH) v FROM readings GROUP BY 1,2) SELECT account_id, YEAR, round((v[1]-list_min(v))/nullif(list_max(v)-list_min(v),0),6) first_scaled, len(v)::INT n,
 round(CASE WHEN len(v)>=12 THEN v[12] ELSE v[len(v)] END,6) padded_last, round(coalesce(v[3],-1),6) third FROM p""")
def arrays(t):
    from gridlight.functions import numeric as N
    p = t("readings").groupBy("account_id", "YEAR").agg(F.transform(F.array_sort(F.collect_list(F.struct("MONTH", "NET_CONSUMPTION_kWh"))), lambda e: e["NET_CONSUMPTION_kWh"]).alias("v"))
    scaled = N.array_min_max_scale(F.col("v"))
    return p.select("account_id", "YEAR", r(F.get(scaled, 0), 6).alias("first_scaled"), F.size("v").alias("n"), r(F.element_at(N.pad_to(F.col("v"), 12), 12), 6).alias("padded_last"),
                    r(F.coalesce(F.try_element_at("v", F.lit(3)), F.lit(-1.0)), 6).alias("third"))
