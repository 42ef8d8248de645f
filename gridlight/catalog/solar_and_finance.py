"""Weather, solar features, nearest months, generation and finance."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlight import constants as C
from gridlight.catalog.base import query
from gridlight.catalog.tables_and_bills import r, rounded
from gridlight.functions import solar as S
from gridlight.functions.tariff import export_tariff
from gridlight.operators import finance as FI, metrics as ME, solar as SO, splits as SP
from gridlight.session import cut_lineage

RW = "rw AS (SELECT r.*, w.* EXCLUDE (SITE_ID, Year, Month) FROM readings r LEFT JOIN weather w ON w.SITE_ID=r.SITE_ID AND w.Year=r.YEAR AND w.Month=r.MONTH)"
DIM = "CASE WHEN MONTH=2 THEN 28 WHEN MONTH IN (4,6,9,11) THEN 30 ELSE 31 END"
SF = RW + f""", sf0 AS (SELECT *, round(1+(Temperature-25e0)*-0.005e0,3) Temp_Efficiency, round(Max_Temperature-Min_Temperature,2) Temp_Range, round(coalesce(Solar_Irradiance_GHI/nullif(Clear_Sky_GHI,0),1e0),2) Cloud_Factor, {DIM} dim FROM rw WHERE HAS_SOLAR=1),
sf AS (SELECT *, round(Solar_Irradiance_GHI*Temp_Efficiency+1e-7,2) GHI_Adjusted, round(Solar_Irradiance_GHI*0.8e0*dim*INV_CAPACITY+1e-7,2) Expected_Generation, round(Solar_Irradiance_GHI*0.8e0*dim+1e-7,2) Physics_Pred, round(EXPORT_kWh/INV_CAPACITY+1e-7,4) Efficiency FROM sf0)"""
NEEDS = ["readings", "weather"]


def solar_frame(t):
    return SO.solar_features(SO.join_weather(t("readings").where("HAS_SOLAR = 1"), t("weather")))


@query("c1_readings_weather", NEEDS, f"WITH {RW} SELECT account_id, YEAR, MONTH, Solar_Irradiance_GHI, Temperature, Humidity FROM rw")
def readings_weather(t):
    return SO.join_weather(t("readings"), t("weather")).select("account_id", "YEAR", "MONTH", "Solar_Irradiance_GHI", "Temperature", "Humidity")


@query("h12_h16_solar_features", NEEDS, f"WITH {SF} SELECT account_id, YEAR, MONTH, Temp_Efficiency, Temp_Range, Cloud_Factor, GHI_Adjusted, Expected_Generation, Physics_Pred, Efficiency, round(sin(2*pi()*MONTH/12),4)+0e0 Month_Sin, dim Days_In_Month FROM sf")
def solar_features(t):
    return solar_frame(t).select("account_id", "YEAR", "MONTH", "Temp_Efficiency", "Temp_Range", "Cloud_Factor", "GHI_Adjusted", "Expected_Generation",
                                 "Physics_Pred", "Efficiency", "Month_Sin", "Days_In_Month")


@query("i5_physics_baseline", NEEDS, f"WITH {SF} SELECT count(*) n, round(avg(abs(Efficiency-Physics_Pred)),6) mae, round(sqrt(avg(pow(Efficiency-Physics_Pred,2))),6) rmse, round(1-sum(pow(Efficiency-Physics_Pred,2))/(var_pop(Efficiency)*count(*)),6) r2 FROM sf WHERE Physics_Pred IS NOT NULL")
def physics(t):
    f = solar_frame(t).where("Physics_Pred IS NOT NULL")
    return rounded(ME.forecast_metrics(f, y="Efficiency", p="Physics_Pred").select("n", "mae", "rmse", "r2"), ["mae", "rmse", "r2"], 6)


@query("c10_weather_merge", ["weather", "weather_history"], """WITH c AS (SELECT SITE_ID, Month, avg(Solar_Irradiance_GHI) g, avg(Clear_Sky_GHI) k, avg(Temperature) t, avg(Humidity) h, avg(Precipitation) p, avg(Wind_Speed) w FROM weather_history GROUP BY 1,2),
f AS (SELECT SITE_ID, Year, Month, Solar_Irradiance_GHI g, Temperature t, CASE WHEN Month%2=0 THEN Humidity END h, Precipitation p, Wind_Speed w FROM weather WHERE Month<=6 OR Year<2000)
SELECT m.SITE_ID, m.Year, m.Month, round(coalesce(f.g,c.g),6) Solar_Irradiance_GHI, round(coalesce(f.t,c.t),6) Temperature, round(coalesce(f.h,c.h),6) Humidity, round(coalesce(f.p,c.p),6) Precipitation, round(c.k,6) Clear_Sky_GHI,
 CASE WHEN f.SITE_ID IS NULL THEN 'NASA_TMY' WHEN f.g IS NULL OR f.h IS NULL THEN 'HYBRID' ELSE 'C3S' END data_source FROM (SELECT SITE_ID, Year, Month FROM weather) m
 LEFT JOIN f ON f.SITE_ID=m.SITE_ID AND f.Year=m.Year AND f.Month=m.Month LEFT JOIN c ON c.SITE_ID=m.SITE_ID AND c.Month=m.Month""")
def weather_merge(t):
    w = t("weather")
    fc = w.where("Month <= 6 OR Year < 2000").withColumn("Humidity", F.when(F.col("Month") % 2 == 0, F.col("Humidity")))
    out = SO.merge_forecast(w.select("SITE_ID", "Year", "Month"), fc, SO.climatology(t("weather_history")))
    six = ["Solar_Irradiance_GHI", "Temperature", "Humidity", "Precipitation", "Clear_Sky_GHI"]
    return rounded(out, six, 6).select("SITE_ID", "Year", "Month", *six, "data_source")


@query("d23_h18_weather_statistics", ["weather"], " UNION ALL ".join(f"SELECT SITE_ID, '{n}' AS parameter, round(avg({e}),6) mean, round(stddev_pop({e}),6) std, round(min({e}),6) min, round(max({e}),6) max FROM weather GROUP BY 1" for n, e in
                                                                      (("Temperature", "Temperature"), ("Humidity", "Humidity"), ("Solar_Irradiance_GHI", "Solar_Irradiance_GHI"), ("heat_index", "(Temperature+0.1e0*Humidity)"))))
def weather_statistics(t):
    return rounded(SO.weather_statistics(t("weather"), ["Temperature", "Humidity", "Solar_Irradiance_GHI"]), ["mean", "std", "min", "max"], 6)


@query("h17_unit_conversions", ["weather"], """WITH x AS (SELECT SITE_ID, Year, Month, Temperature+273.15e0 tk, Temperature-2-Humidity/50+273.15e0 dk, Wind_Speed*40 ss, Precipitation/1000 tp, Wind_Speed u, Humidity/40 v FROM weather), y AS (SELECT *, round(tk-273.15e0,2) tc FROM x)
SELECT SITE_ID, Year, Month, tc AS Temperature, round(least(100e0,100*exp(17.625e0*(dk-273.15e0)/(243.04e0+(dk-273.15e0)))/exp(17.625e0*tc/(243.04e0+tc))),1) Humidity, round(ss*86400/3600000,3) Solar_Irradiance_GHI, round(tp*1000/(CASE WHEN Month=2 THEN 28 WHEN Month IN (4,6,9,11) THEN 30 ELSE 31 END),3) Precipitation, round(sqrt(u*u+v*v),2) Wind_Speed FROM y""")
def units(t):
    raw = t("weather").select("SITE_ID", "Year", "Month", (F.col("Temperature") + 273.15).alias("t2m_k"), (F.col("Temperature") - 2 - F.col("Humidity") / 50 + 273.15).alias("d2m_k"),
                              (F.col("Wind_Speed") * 40).alias("ssrd_w"), (F.col("Precipitation") / 1000).alias("tp_m"), F.col("Wind_Speed").alias("u10"), (F.col("Humidity") / 40).alias("v10"))
    return SO.convert_units(raw).select("SITE_ID", "Year", "Month", "Temperature", "Humidity", "Solar_Irradiance_GHI", "Precipitation", "Wind_Speed")


@query("h17_nearest_grid_cell", ["accounts", "users"], """SELECT account_id, arg_min(kwh_m09, round(d,12)*1e9 + user_id*1e-6) AS kwh_m09 FROM (SELECT account_id, user_id, kwh_m09, pow(CUSTOMER_LAT-latitude,2)+pow(CUSTOMER_LON-longitude,2) d FROM
 (SELECT * FROM accounts) a JOIN (SELECT latitude, longitude, min(user_id) user_id, max(kwh_m09) kwh_m09 FROM users GROUP BY 1,2) u ON true) GROUP BY 1""")
def nearest_grid_cell(t):
    grid = t("users").groupBy(F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).agg(F.max("kwh_m09").alias("kwh_m09"))
    sites = t("accounts").select("account_id", F.col("CUSTOMER_LAT").alias("lat"), F.col("CUSTOMER_LON").alias("lon"))
    return SO.nearest_cell(sites, grid, ["account_id"], ["kwh_m09"], 0.05)


@query("h19_static_climate", ["readings"], """SELECT account_id, YEAR, MONTH, [26.5e0,27,28,28.5,28.5,28,27.5,27.5,27.5,27,26.5,26][MONTH] AS "Temperature", [75e0,70,70,75,80,80,80,80,80,80,80,80][MONTH] AS "Humidity", [100e0,80,120,200,300,200,150,150,200,300,300,200][MONTH] AS "Precipitation" FROM readings""")
def static_climate(t):
    return t("readings").select("account_id", "YEAR", "MONTH", *[c.alias(n) for n, c in S.static_climate(F.col("MONTH")).items()])


# ---- nearest neighbours ------------------------------------------------------------

KNN = SF + """, ks AS (SELECT *, CASE WHEN substr(md5(concat_ws('|', account_id, 42)), 1, 8) < '33333333' THEN 1 ELSE 0 END te FROM sf WHERE Solar_Irradiance_GHI IS NOT NULL AND Efficiency IS NOT NULL),
st AS (SELECT avg(Solar_Irradiance_GHI) m1, stddev_pop(Solar_Irradiance_GHI) s1, avg(Temperature) m2, stddev_pop(Temperature) s2, avg(Cloud_Factor) m3, stddev_pop(Cloud_Factor) s3 FROM ks WHERE te=0),
qv AS (SELECT DISTINCT Solar_Irradiance_GHI g, Temperature t, Cloud_Factor c FROM ks WHERE te=1),
kp AS (SELECT g, t, c, k.account_id, k.YEAR, k.MONTH, Efficiency, sqrt(pow((g-Solar_Irradiance_GHI)/s1,2)+pow((t-Temperature)/s2,2)+pow((c-Cloud_Factor)/s3,2)) d FROM qv JOIN (SELECT * FROM ks WHERE te=0) k ON true JOIN st ON true),
kn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g,t,c ORDER BY round(d,9), account_id, YEAR, MONTH) rk FROM kp) WHERE rk<=3)"""


def knn_sets(t, metric="euclidean"):
    rows = solar_frame(t).dropna(subset=["Solar_Irradiance_GHI", "Efficiency"])
    # scaling, representatives and queries all start from these rows
    f = cut_lineage(SP.group_split(rows).select("account_id", "YEAR", "MONTH", *C.KNN_FEATURES, "Efficiency", "split"))
    test, train = f.where("split = 'test'"), f.where("split = 'train'")
    return test, SO.nearest_rows(test, train, C.KNN_FEATURES, "Efficiency", ["account_id", "YEAR", "MONTH"], metric=metric)


@query("c9_knn_neighbours", NEEDS, f"WITH {KNN} SELECT g AS Solar_Irradiance_GHI, t AS Temperature, c AS Cloud_Factor, rk AS rank, account_id, YEAR, MONTH, round(d,6) distance, Efficiency FROM kn")
def knn(t):
    _, near = knn_sets(t)
    return near.select(*C.KNN_FEATURES, "rank", "account_id", "YEAR", "MONTH", r("distance", 6).alias("distance"), "Efficiency")


@query("c9_knn_predict", NEEDS, f"WITH {KNN}, pm AS (SELECT g, t, c, avg(Efficiency) p FROM kn GROUP BY 1,2,3) SELECT account_id, YEAR, MONTH, Efficiency, round(p,6) \"predicted_Efficiency\" FROM ks JOIN pm ON g=Solar_Irradiance_GHI AND t=Temperature AND c=Cloud_Factor WHERE te=1")
def knn_predict(t):
    test, near = knn_sets(t)
    return SO.knn_predict(test, near, C.KNN_FEATURES, "Efficiency").select("account_id", "YEAR", "MONTH", "Efficiency", r("predicted_Efficiency", 6).alias("predicted_Efficiency"))


@query("c9_knn_details", NEEDS, f"WITH {KNN} SELECT g AS Solar_Irradiance_GHI, t AS Temperature, c AS Cloud_Factor, " + ", ".join(f"round(max(d) FILTER (rk={i}),6) match_{i}_distance, max(Efficiency) FILTER (rk={i}) AS \"match_{i}_Efficiency\"" for i in (1, 2, 3)) + " FROM kn GROUP BY 1,2,3")
def knn_details(t):
    _, near = knn_sets(t)
    return rounded(SO.knn_details(near, C.KNN_FEATURES, "Efficiency"), [f"match_{i}_distance" for i in (1, 2, 3)], 6)


# the same rows by 1 - cosine of the standardised vectors
COS = KNN.replace("sqrt(pow((g-Solar_Irradiance_GHI)/s1,2)+pow((t-Temperature)/s2,2)+pow((c-Cloud_Factor)/s3,2)) d FROM",
                  "1-((g-m1)/s1*((Solar_Irradiance_GHI-m1)/s1)+(t-m2)/s2*((Temperature-m2)/s2)+(c-m3)/s3*((Cloud_Factor-m3)/s3))/sqrt(pow((g-m1)/s1,2)+pow((t-m2)/s2,2)+pow((c-m3)/s3,2))/sqrt(pow((Solar_Irradiance_GHI-m1)/s1,2)+pow((Temperature-m2)/s2,2)+pow((Cloud_Factor-m3)/s3,2)) d FROM")


@query("c9_knn_cosine", NEEDS, f"WITH {COS} SELECT g AS Solar_Irradiance_GHI, t AS Temperature, c AS Cloud_Factor, rk AS rank, account_id, YEAR, MONTH, round(d,6) distance, Efficiency FROM kn")
def knn_cosine(t):
    _, near = knn_sets(t, "cosine")
    return near.select(*C.KNN_FEATURES, "rank", "account_id", "YEAR", "MONTH", r("distance", 6).alias("distance"), "Efficiency")


GEN = SF + """, ef AS (SELECT SITE_ID, MONTH, avg(Efficiency) e FROM sf GROUP BY 1,2), gf AS (SELECT system_id, MONTH, size_kw, greatest(e,0)*size_kw k FROM systems JOIN ef ON SITE_ID=system_id%25)"""


def generation(t):
    eff = solar_frame(t).groupBy("SITE_ID", "MONTH").agg(F.avg("Efficiency").alias("Efficiency"))
    return SO.generation_forecast(t("systems").withColumn("SITE_ID", (F.col("system_id") % 25).cast("int")), eff, ["SITE_ID"])


@query("h20_generation_forecast", [*NEEDS, "systems"], f"WITH {GEN} SELECT system_id, MONTH, round(k+1e-7,4) \"Predicted_Export_kWh\", round(greatest(k-18*size_kw,0)+1e-7,4) \"Lower_kWh\", round(k+18*size_kw+1e-7,4) \"Upper_kWh\", round(CASE WHEN k>0 THEN greatest(0,least(1,1-18*size_kw/k))*100 ELSE 0 END+1e-7,4) \"Confidence_Pct\", round(k*27.06e0+1e-7,3) \"Estimated_Income_LKR\" FROM gf")
def generation_forecast(t):
    cols = ["Predicted_Export_kWh", "Lower_kWh", "Upper_kWh", "Confidence_Pct"]
    return generation(t).select("system_id", "MONTH", *[F.round(F.col(c) + 1e-7, 4).alias(c) for c in cols], F.round(F.col("Estimated_Income_LKR") + 1e-7, 3).alias("Estimated_Income_LKR"))


@query("d57_annual_generation", [*NEEDS, "systems"], f"WITH {GEN} SELECT system_id, round(sum(k)+1e-7,3) annual_kwh, round(sum(k*27.06e0)+1e-6,2) annual_income_lkr, round(avg(CASE WHEN k>0 THEN greatest(0,least(1,1-18*size_kw/k))*100 ELSE 0 END),4) mean_confidence FROM gf GROUP BY 1")
def annual_generation(t):
    a = SO.annual_generation(generation(t), ["system_id"])
    return a.select("system_id", F.round(F.col("annual_kwh") + 1e-7, 3).alias("annual_kwh"), F.round(F.col("annual_income_lkr") + 1e-6, 2).alias("annual_income_lkr"), r("mean_confidence").alias("mean_confidence"))


@query("d51_model_comparison", NEEDS, f"WITH {SF} SELECT MONTH, round(avg(INV_CAPACITY),6) mean_kw, round(avg(Efficiency)*avg(INV_CAPACITY),4) \"Efficiency_kwh\", round(avg(Physics_Pred)*avg(INV_CAPACITY),4) \"Physics_Pred_kwh\", round(avg(Physics_Pred)*avg(INV_CAPACITY)*27.06e0,3) income_lkr FROM sf GROUP BY 1")
def model_comparison(t):
    m = SO.model_comparison(solar_frame(t), ["Physics_Pred"])
    return m.select("MONTH", r("mean_kw", 6).alias("mean_kw"), r("Efficiency_kwh").alias("Efficiency_kwh"), r("Physics_Pred_kwh").alias("Physics_Pred_kwh"), r("income_lkr", 3).alias("income_lkr"))


# ---- finance -------------------------------------------------------------------------

@query("h45_h51_cost_and_size", ["systems"], """SELECT system_id, CASE size_kw-0.5 WHEN 3 THEN 750000e0 WHEN 5 THEN 800000e0 WHEN 8 THEN 1450000e0 WHEN 10 THEN 1800000e0 WHEN 15 THEN 2600000e0 WHEN 20 THEN 2900000e0 ELSE (size_kw-0.5)*200000e0 END cost,
 greatest(1.5e0,least(20e0,round(annual_consumption_kwh/1200+1e-7,1))) size, CASE WHEN size_kw<=5 THEN 20.9e0 ELSE 19.61e0 END export FROM systems""")
def cost_and_size(t):
    return t("systems").select("system_id", FI.system_cost(F.col("size_kw") - 0.5).alias("cost"), FI.recommended_size(F.col("annual_consumption_kwh")).alias("size"),
                               export_tariff(F.col("size_kw")).alias("export"))


@query("c17_h46_vendor_quotes", ["systems", "vendor_prices"], """WITH x AS (SELECT s.system_id, s.size_kw s, v.vendor, max(v.size_kw) FILTER (v.size_kw<=s.size_kw) l, min(v.size_kw) FILTER (v.size_kw>=s.size_kw) u FROM systems s CROSS JOIN vendor_prices v GROUP BY 1,2,3),
 y AS (SELECT x.*, a.price_lkr lp, b.price_lkr up FROM x LEFT JOIN vendor_prices a ON a.vendor=x.vendor AND a.size_kw=l LEFT JOIN vendor_prices b ON b.vendor=x.vendor AND b.size_kw=u),
 z AS (SELECT system_id, s, vendor, CASE WHEN l IS NULL THEN up WHEN u IS NULL THEN lp WHEN l=u THEN lp ELSE round((lp+(s-l)/(u-l)*(up-lp)+1e-6)/1000)*1000 END price_lkr FROM y)
 SELECT system_id, vendor, price_lkr, round(round((price_lkr/s+1e-6)/100)*100,0) price_per_kw, row_number() OVER (PARTITION BY system_id ORDER BY price_lkr, vendor) rank FROM z""")
def vendor_quotes(t):
    return FI.vendor_quotes(t("systems"), t("vendor_prices")).select("system_id", "vendor", "price_lkr", "price_per_kw", "rank")


FLOW = """fl AS (SELECT s.*, y.year, size_kw*200000e0 cost, annual_generation_kwh*pow(0.9925e0,y.year-1) g, 45e0*pow(1.035e0,y.year-1) t, annual_consumption_kwh u FROM systems s CROSS JOIN (SELECT CAST(unnest(range(1,21)) AS INT) AS year) y),
fn AS (SELECT *, least(g,u)*t+greatest(g-u,0)*CASE WHEN size_kw<=5 THEN 20.9e0 ELSE 19.61e0 END-cost*0.01e0-CASE WHEN year=10 THEN cost*0.25e0 ELSE 0 END net FROM fl),
fc AS (SELECT *, sum(net) OVER w - cost cum, sum(net/pow(1.1e0,year)) OVER w - cost npv FROM fn WINDOW w AS (PARTITION BY system_id ORDER BY year))"""


@query("h47_yearly_cash_flow", ["systems"], f"WITH {FLOW} SELECT system_id, year, round(net+1e-6,2) net_lkr, round(cum+1e-6,2) cumulative_lkr, round(npv+1e-6,2) npv_lkr FROM fc")
def cash_flow(t):
    return FI.yearly_cash_flow(t("systems")).select("system_id", "year", *[F.round(F.col(c) + 1e-6, 2).alias(c) for c in ("net_lkr", "cumulative_lkr", "npv_lkr")])


@query("e15_h48_h49_payback", ["systems"], f"""WITH {FLOW}, p AS (SELECT system_id, any_value(cost) c, coalesce(arg_min(year-1+abs(cum-net)/net, year) FILTER (cum>=0), 21e0) pb, arg_max(npv, year) npv, sum(net) pr FROM fc GROUP BY 1)
 SELECT system_id, c investment_lkr, round(pb,4) payback_years, round(npv,2) npv_lkr, round(pr,2) profit_lkr, round(CASE WHEN pr/c>0 THEN (pow(pr/c,1/20)-1)*100 END,6) annual_roi_pct,
 CASE WHEN npv>c*0.5e0 THEN 'Excellent Investment: Highly resilient to market risks.' WHEN npv>0 THEN 'Good Investment: Profitable over the system lifetime.' ELSE 'High Risk / Marginal Return: Consider a different system size or tariff scheme.' END recommendation FROM p""")
def payback(t):
    p = rounded(FI.payback_summary(FI.yearly_cash_flow(t("systems"))), ["npv_lkr", "profit_lkr"], 2)
    return p.withColumns({"payback_years": r("payback_years"), "annual_roi_pct": r("annual_roi_pct", 6)})


@query("h50_chart_series", ["systems"], """SELECT system_id, year, round(sum(n) OVER (PARTITION BY system_id ORDER BY year)-c,3) cumulative_lkr, round((sum(n) OVER (PARTITION BY system_id ORDER BY year)-c)*0.85e0,3) low_lkr FROM
 (SELECT system_id, size_kw*200000e0 c, y.year, size_kw*200000e0*(0.065e0+system_id%7*0.01e0)/20-CASE WHEN y.year=10 THEN size_kw*50000e0 ELSE 0 END n FROM systems CROSS JOIN (SELECT CAST(unnest(range(1,21)) AS INT) AS year) y)""")
def chart(t):
    s = t("systems").select("system_id", FI.system_cost(F.col("size_kw")).alias("investment_lkr"), (6.5 + F.col("system_id") % 7).alias("roi"))
    return rounded(FI.chart_series(s, "roi"), ["cumulative_lkr", "low_lkr"], 3).select("system_id", "year", "cumulative_lkr", "low_lkr")


@query("h50_dashboard_series", ["systems"], """SELECT system_id, year, e expected_lkr, round(e*0.88e0) low_lkr, round(e*1.10e0) high_lkr FROM (SELECT system_id, y.year, round(-size_kw*200000e0+annual_generation_kwh*30e0*y.year*pow(1.03e0,y.year)/1.03e0) e FROM systems CROSS JOIN (SELECT CAST(unnest(range(0,21)) AS INT) AS year) y)""")
def dashboard_chart(t):
    s = t("systems").select("system_id", FI.system_cost(F.col("size_kw")).alias("investment_lkr"), (F.col("annual_generation_kwh") * 30).alias("savings"))
    return FI.dashboard_series(s, "investment_lkr", "savings").select("system_id", "year", "expected_lkr", "low_lkr", "high_lkr")
