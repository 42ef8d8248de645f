"""Quality, exploratory statistics, forecast validation, drift and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlight import constants as C
from gridlight.catalog.base import query
from gridlight.catalog.tables_and_bills import r, rounded
from gridlight.functions import numeric as N
from gridlight.operators import drift as DR, metrics as ME, profile_stats as PS, quality as QU, series as SE, splits as SP

NET = "NET_CONSUMPTION_kWh"
FEATURES = [NET, "IMPORT_kWh", "EXPORT_kWh", "INV_CAPACITY"]


def quality_input(t):
    """Readings with a few holes and odd values, so that every check has something to find."""
    k = F.col("account_id") * 31 + F.col("YEAR") * 7 + F.col("MONTH") * 17
    return t("readings").select(
        "account_id", "YEAR", "MONTH", "HAS_SOLAR", "CUSTOMER_LAT", "CUSTOMER_LON",
        F.when(k % 97 != 0, F.col("IMPORT_kWh")).alias("IMPORT_kWh"),
        F.when(k % 89 == 0, 0.0).when(k % 83 == 0, -5.0).when(k % 79 == 0, 5000.0).otherwise(F.col(NET)).alias(NET),
        F.when(k % 101 == 0, "XX").otherwise(F.col("CAL_TARIFF")).alias("CAL_TARIFF"))


QI = """qi AS (SELECT account_id, YEAR, MONTH, HAS_SOLAR, CUSTOMER_LAT, CUSTOMER_LON, CASE WHEN k%97<>0 THEN IMPORT_kWh END AS IMPORT_kWh,
 CASE WHEN k%89=0 THEN 0e0 WHEN k%83=0 THEN -5e0 WHEN k%79=0 THEN 5000e0 ELSE NET_CONSUMPTION_kWh END AS NET_CONSUMPTION_kWh, CASE WHEN k%101=0 THEN 'XX' ELSE CAL_TARIFF END CAL_TARIFF
 FROM (SELECT *, account_id*31+YEAR*7+MONTH*17 AS k FROM readings))"""
MEANS = """mm AS (SELECT YEAR, MONTH, avg(NET_CONSUMPTION_kWh) m FROM qi GROUP BY 1,2), rk AS (SELECT a.YEAR, a.MONTH, (SELECT count(*) FROM mm b WHERE b.YEAR=a.YEAR AND b.m>a.m)+((SELECT count(*) FROM mm b WHERE b.YEAR=a.YEAR AND b.m=a.m)+1)/2 hi,
 (SELECT count(*) FROM mm b WHERE b.YEAR=a.YEAR AND b.m<a.m)+((SELECT count(*) FROM mm b WHERE b.YEAR=a.YEAR AND b.m=a.m)+1)/2 lo FROM mm a),
ss AS (SELECT YEAR, ((13-coalesce(max(hi) FILTER (MONTH=4),6)+13-coalesce(max(hi) FILTER (MONTH=10),6))/24 + (13-coalesce(max(lo) FILTER (MONTH=7),6)+13-coalesce(max(lo) FILTER (MONTH=8),6))/24)/2 sc FROM rk GROUP BY 1),
cp AS (SELECT YEAR, avg(CASE WHEN k=12 THEN 1e0 ELSE 0e0 END) co FROM (SELECT YEAR, account_id, count(DISTINCT MONTH) k FROM qi GROUP BY 1,2) GROUP BY 1)"""
OUTL = """lg AS (SELECT YEAR, nm, x FROM (SELECT YEAR, unnest(['MONTH','HAS_SOLAR','CUSTOMER_LAT','CUSTOMER_LON','IMPORT_kWh','NET_CONSUMPTION_kWh']) nm, unnest([MONTH::DOUBLE,HAS_SOLAR::DOUBLE,CUSTOMER_LAT,CUSTOMER_LON,IMPORT_kWh,NET_CONSUMPTION_kWh]) x FROM qi)),
bq AS (SELECT YEAR, nm, quantile_cont(x,0.25) q1, quantile_cont(x,0.75) q3 FROM lg GROUP BY 1,2), ou AS (SELECT YEAR, nm, count(*) FILTER (x<q1-3*(q3-q1) OR x>q3+3*(q3-q1)) o FROM lg JOIN bq USING (YEAR, nm) GROUP BY 1,2)"""


@query("d9_outlier_report", ["readings"], f"WITH {QI}, {OUTL} SELECT YEAR, nm AS \"column\", o AS outliers FROM ou")
def outliers(t):
    return QU.outlier_report(quality_input(t).drop("account_id"), ["YEAR"])


@query("d10_missing_report", ["readings"], f"""WITH {QI} SELECT 'IMPORT_kWh' AS "column", count(*)-count(IMPORT_kWh) AS missing, round((count(*)-count(IMPORT_kWh))*100e0/count(*),4) pct FROM qi
 UNION ALL SELECT 'CAL_TARIFF', count(*)-count(CAL_TARIFF), round((count(*)-count(CAL_TARIFF))*100e0/count(*),4) FROM qi""")
def missing(t):
    return rounded(QU.missing_report(quality_input(t), cols=["IMPORT_kWh", "CAL_TARIFF"]), ["pct"])


@query("d11_sign_counts", ["readings"], f"WITH {QI} SELECT YEAR, count(*) FILTER (NET_CONSUMPTION_kWh=0 AND HAS_SOLAR=0) zero_months, count(*) FILTER (NET_CONSUMPTION_kWh<0) negative_months FROM qi GROUP BY 1")
def signs(t):
    return QU.sign_counts(quality_input(t), ["YEAR"])


@query("d12_e6_seasonal_consistency", ["readings"], f"WITH {QI}, {MEANS} SELECT YEAR, round(sc,6) seasonal_score FROM ss")
def seasonal(t):
    return rounded(QU.seasonal_consistency(quality_input(t), ["YEAR"]), ["seasonal_score"], 6)


@query("d13_completeness", ["order_months"], """SELECT YEAR, round(avg(CASE WHEN k=12 THEN 1e0 ELSE 0e0 END),6) completeness FROM (SELECT YEAR, account_id, count(DISTINCT MONTH) k FROM order_months GROUP BY 1,2) GROUP BY 1""")
def complete(t):
    return rounded(QU.completeness(t("order_months"), ["YEAR"]), ["completeness"], 6)


REPORT = f"""{QI}, {MEANS}, {OUTL}, cn AS (SELECT YEAR, count(*) n, count(DISTINCT account_id) ac, count(*)-count(IMPORT_kWh) mi, count(*) FILTER (NET_CONSUMPTION_kWh=0 AND HAS_SOLAR=0) z, count(*) FILTER (NET_CONSUMPTION_kWh<0) ng,
 count(*) FILTER (CAL_TARIFF NOT IN ('D1','GP1','GP2')) bt FROM qi GROUP BY 1), hv AS (SELECT YEAR, count(*) FILTER (o>n*0.01e0) h FROM ou JOIN cn USING (YEAR) GROUP BY 1),
rp AS (SELECT *, greatest(0.1e0, least(1e0, 1-0.05e0*mi/n-0.1e0*h-0.05e0*z/n-0.1e0*ng/n-CASE WHEN sc<0.7 THEN 0.1e0 ELSE 0 END-CASE WHEN co<0.8 THEN 0.1e0 ELSE 0 END-CASE WHEN bt>0 THEN 0.05e0 ELSE 0 END)) os,
 (mi>0)::INT+h+(z>0)::INT+(ng>0)::INT+(sc<0.7)::INT+(co<0.8)::INT+(bt>0)::INT AS ni FROM cn JOIN hv USING (YEAR) JOIN ss USING (YEAR) JOIN cp USING (YEAR))"""


def report(t):
    return QU.quality_report(quality_input(t), ["YEAR"])


@query("d14_quality_report", ["readings"], f"WITH {REPORT} SELECT YEAR, n total_records, ac unique_accounts, z zero_months, ng negative_months, bt invalid_tariffs, round(sc,6) seasonal_score, round(co,6) completeness, CAST(ni AS INT) n_issues, round(os,6) overall_score FROM rp")
def quality(t):
    q = rounded(report(t), ["seasonal_score", "completeness", "overall_score"], 6)
    return q.select("YEAR", "total_records", "unique_accounts", "zero_months", "negative_months", "invalid_tariffs", "seasonal_score", "completeness",
                    F.size("quality_issues").alias("n_issues"), "overall_score")


@query("d15_quality_trend", ["readings"], f"""WITH {REPORT} SELECT round(regr_slope(os,YEAR),6) slope, round(arg_max(os,YEAR),6) current_score, round(min(os),6) min_score, round(max(os),6) max_score, round(stddev_pop(os),6) volatility, count(*) runs,
 CASE WHEN regr_slope(os,YEAR)>0.01 THEN 'improving' WHEN regr_slope(os,YEAR)<-0.01 THEN 'degrading' ELSE 'stable' END trend FROM rp""")
def quality_trend(t):
    return rounded(QU.quality_trend(report(t), "YEAR"), ["slope", "current_score", "min_score", "max_score", "volatility"], 6)


@query("d16_quality_advice", ["readings"], f"WITH {REPORT} SELECT YEAR, CAST((os<0.5)::INT+(mi>0)::INT+(h>0)::INT+(z>0)::INT+(sc<0.7)::INT AS INT) n_advice FROM rp")
def advice(t):
    # an untouched report would say "acceptable"; here each counted issue gives one piece of advice
    return QU.quality_advice(report(t)).select("YEAR", F.size(F.filter("recommendations", lambda a: ~a.startswith("Data quality acceptable"))).alias("n_advice"))


# ---- exploratory tables ----------------------------------------------------------

@query("d24_month_profile", ["readings"], "SELECT MONTH, round(avg(NET_CONSUMPTION_kWh),6) mean, round(stddev_samp(NET_CONSUMPTION_kWh),6) std, count(*) n, round(quantile_cont(NET_CONSUMPTION_kWh,0.5),6) median FROM readings GROUP BY 1")
def month_profile(t):
    return rounded(PS.month_profile(t("readings")), ["mean", "std", "median"], 6)


HS = """hs AS (SELECT account_id, avg(NET_CONSUMPTION_kWh) a, stddev_samp(NET_CONSUMPTION_kWh) s, min(NET_CONSUMPTION_kWh) mi, max(NET_CONSUMPTION_kWh) ma, count(*) n, any_value(HAS_SOLAR) so, any_value(CAL_TARIFF) ta FROM readings GROUP BY 1)"""


@query("d25_household_statistics", ["readings"], f"WITH {HS} SELECT account_id, round(a,6) avg_consumption, round(s,6) std_consumption, mi min_consumption, ma max_consumption, n n_months, so has_solar, ta tariff FROM hs")
def household_stats(t):
    return rounded(PS.household_statistics(t("readings")), ["avg_consumption", "std_consumption"], 6)


@query("d25_household_summary", ["readings"], f"WITH {HS} SELECT round(min(a),6) min_avg, round(max(a),6) max_avg, count(*) FILTER (s>100) high_variability, count(*) FILTER (n>=12) complete FROM hs")
def household_summary(t):
    return rounded(PS.household_summary(PS.household_statistics(t("readings"))), ["min_avg", "max_avg"], 6)


@query("d26_account_month_matrix", ["readings"], "SELECT account_id, " + ", ".join(f"round(avg(NET_CONSUMPTION_kWh) FILTER (MONTH={m}),6) AS \"{m}\"" for m in range(1, 13)) + " FROM readings GROUP BY 1")
def matrix(t):
    return rounded(PS.account_month_matrix(t("readings")), [str(m) for m in range(1, 13)], 6)


@query("d26_quality_matrix", ["readings"], "SELECT MONTH, count(*) FILTER (DATA_QUALITY='REAL') AS \"REAL\", count(*) FILTER (DATA_QUALITY='SYNTHETIC') AS \"SYNTHETIC\" FROM readings GROUP BY 1")
def quality_matrix(t):
    return PS.quality_matrix(t("readings"), ["REAL", "SYNTHETIC"])


@query("d28_group_means", ["readings"], "SELECT CAL_TARIFF, HAS_SOLAR, round(avg(NET_CONSUMPTION_kWh),6) AS \"avg_NET_CONSUMPTION_kWh\", round(avg(EXPORT_kWh),6) AS \"avg_EXPORT_kWh\", count(*) n FROM readings GROUP BY 1,2")
def group_means(t):
    return rounded(PS.group_means(t("readings"), ["CAL_TARIFF", "HAS_SOLAR"], [NET, "EXPORT_kWh"]), [f"avg_{NET}", "avg_EXPORT_kWh"], 6)


@query("d29_capacity_variation", ["readings"], "WITH g AS (SELECT INV_CAPACITY, avg(EXPORT_kWh) e, avg(IMPORT_kWh) i FROM readings WHERE HAS_SOLAR=1 GROUP BY 1) SELECT round(stddev_samp(e)/avg(e),6) AS \"cv_EXPORT_kWh\", round(stddev_samp(i)/avg(i),6) AS \"cv_IMPORT_kWh\" FROM g")
def capacity_variation(t):
    return rounded(PS.capacity_variation(t("readings").where("HAS_SOLAR = 1"), ["EXPORT_kWh", "IMPORT_kWh"]), ["cv_EXPORT_kWh", "cv_IMPORT_kWh"], 6)


@query("d30_correlation_matrix", ["readings"], " UNION ALL ".join(f"SELECT '{a}' AS feature, '{b}' AS other, round(CASE WHEN stddev_pop({a})>0 AND stddev_pop({b})>0 THEN corr({a},{b}) END,6) AS correlation FROM readings" for a in FEATURES for b in FEATURES))
def correlations(t):
    return rounded(ME.correlation_table(t("readings"), FEATURES), ["correlation"], 6)


@query("d30_target_correlations", ["readings"], " UNION ALL ".join(f"SELECT '{a}' AS feature, round(corr({a},EXPORT_kWh),6) AS correlation FROM readings" for a in ("IMPORT_kWh", "INV_CAPACITY", "MONTH")))
def target_correlations(t):
    return rounded(ME.target_correlations(t("readings"), ["IMPORT_kWh", "INV_CAPACITY", "MONTH"], "EXPORT_kWh"), ["correlation"], 6)


@query("d31_lag_correlations", ["readings"], "WITH x AS (SELECT NET_CONSUMPTION_kWh v, " + ", ".join(f"lag(NET_CONSUMPTION_kWh,{n}) OVER (PARTITION BY account_id ORDER BY YEAR, MONTH) l{n}" for n in SE.LAGS) + " FROM readings) " + " UNION ALL ".join(
    f"SELECT {n} AS lag, round(corr(l{n}, v),6) AS correlation FROM x" for n in SE.LAGS))
def lag_correlations(t):
    return rounded(SE.lag_correlations(t("readings")), ["correlation"], 6)


@query("d32_t_test", ["readings"], """WITH g AS (SELECT count(*) FILTER (HAS_SOLAR=1) n1, count(*) FILTER (HAS_SOLAR=0) n2, avg(NET_CONSUMPTION_kWh) FILTER (HAS_SOLAR=1) m1, avg(NET_CONSUMPTION_kWh) FILTER (HAS_SOLAR=0) m2,
 var_samp(NET_CONSUMPTION_kWh) FILTER (HAS_SOLAR=1) v1, var_samp(NET_CONSUMPTION_kWh) FILTER (HAS_SOLAR=0) v2 FROM readings)
 SELECT n1, n2, round(m1,6) mean1, round(m2,6) mean2, round((m1-m2)/sqrt(((n1-1)*v1+(n2-1)*v2)/(n1+n2-2)*(1/n1+1/n2)),6) t_statistic FROM g""")
def t_test(t):
    return rounded(ME.t_test(t("readings"), NET, F.col("HAS_SOLAR") == 1), ["mean1", "mean2", "t_statistic"], 6).drop("p_value")


# the years up to 1995 against the later ones, per transformer and month; the p-value by Simpson's rule over the density
@query("d32_t_test_small", ["readings"], """WITH g AS (SELECT TRANSFORMER_CODE, MONTH, count(*) FILTER (YEAR<=1995) n1, count(*) FILTER (YEAR>1995) n2, avg(NET_CONSUMPTION_kWh) FILTER (YEAR<=1995) m1, avg(NET_CONSUMPTION_kWh) FILTER (YEAR>1995) m2,
 var_samp(NET_CONSUMPTION_kWh) FILTER (YEAR<=1995) v1, var_samp(NET_CONSUMPTION_kWh) FILTER (YEAR>1995) v2 FROM readings GROUP BY 1,2),
s AS (SELECT *, n1+n2-2 f, (m1-m2)/sqrt(((n1-1)*v1+(n2-1)*v2)/(n1+n2-2)*(1/n1+1/n2)) t FROM g WHERE n1>1 AND n2>1),
p AS (SELECT TRANSFORMER_CODE, MONTH, n1, n2, t, 1-2*exp(lgamma((f+1)/2)-lgamma(f/2))/sqrt(f*pi())*abs(t)/6000*sum(CASE WHEN i IN (0,2000) THEN 1 WHEN i%2=1 THEN 4 ELSE 2 END*pow(1+pow(t*i/2000,2)/f,-(f+1)/2)) p FROM s, unnest(range(0,2001)) u(i) GROUP BY 1,2,3,4,5,f)
SELECT TRANSFORMER_CODE, MONTH, n1, n2, round(t,6) t_statistic, round(p,6) p_value FROM p""")
def t_test_small(t):
    rows = t("readings").withColumn("early", F.col("YEAR") <= 1995)
    out = ME.t_test(rows, NET, F.col("early"), ["TRANSFORMER_CODE", "MONTH"]).where("n1 > 1 AND n2 > 1")
    return rounded(out, ["t_statistic", "p_value"], 6).select("TRANSFORMER_CODE", "MONTH", "n1", "n2", "t_statistic", "p_value")


@query("d33_outlier_counts", ["readings"], """WITH s AS (SELECT avg(NET_CONSUMPTION_kWh) m, stddev_pop(NET_CONSUMPTION_kWh) s, quantile_cont(NET_CONSUMPTION_kWh,0.25) q1, quantile_cont(NET_CONSUMPTION_kWh,0.75) q3 FROM readings)
 SELECT count(*) n, count(*) FILTER (NET_CONSUMPTION_kWh<q1-1.5e0*(q3-q1) OR NET_CONSUMPTION_kWh>q3+1.5e0*(q3-q1)) iqr_outliers, count(*) FILTER (abs(NET_CONSUMPTION_kWh-m)>3*s) z_outliers FROM readings, s""")
def outlier_counts(t):
    return ME.outlier_counts(t("readings"), NET)


@query("d34_seasonal_contrasts", ["readings"], """WITH m AS (SELECT MONTH, avg(NET_CONSUMPTION_kWh) m FROM readings GROUP BY 1), c AS (SELECT avg(NET_CONSUMPTION_kWh) FILTER (HAS_SOLAR=1) s, avg(NET_CONSUMPTION_kWh) FILTER (HAS_SOLAR=0) o,
 avg(NET_CONSUMPTION_kWh) FILTER (CUSTOMER_LAT>6.8 AND CUSTOMER_LAT<7 AND CUSTOMER_LON>79.8 AND CUSTOMER_LON<80) u, avg(NET_CONSUMPTION_kWh) FILTER (NOT (CUSTOMER_LAT>6.8 AND CUSTOMER_LAT<7 AND CUSTOMER_LON>79.8 AND CUSTOMER_LON<80)) ru FROM readings)
 SELECT list(MONTH ORDER BY m DESC)[1:3] peak_months, list(MONTH ORDER BY m)[1:3] low_months, round((max(m) FILTER (MONTH=4)/avg(m)-1)*100,6) april_boost_pct, round((1-avg(m) FILTER (MONTH IN (7,8))/avg(m))*100,6) monsoon_drop_pct,
 round(abs(any_value(s)/any_value(o)-1)*100,6) solar_contrast_pct, round((any_value(u)/any_value(ru)-1)*100,6) urban_contrast_pct FROM m, c""")
def contrasts(t):
    return rounded(PS.seasonal_contrasts(t("readings")), ["april_boost_pct", "monsoon_drop_pct", "solar_contrast_pct", "urban_contrast_pct"], 6)


EFF = """ac AS (SELECT account_id, avg(EXPORT_kWh) e, max(INV_CAPACITY) c FROM readings WHERE HAS_SOLAR=1 GROUP BY 1), qq AS (SELECT quantile_cont(e,0.25) q1, quantile_cont(e,0.75) q3 FROM ac)"""


@query("d50_account_efficiency", ["readings"], f"WITH {EFF} SELECT account_id, round(e,6) avg_export, round(e/c,6) efficiency, c AS capacity, NOT (e BETWEEN q1-1.5e0*(q3-q1) AND q3+1.5e0*(q3-q1)) AS is_outlier FROM ac, qq")
def efficiency(t):
    return rounded(PS.account_efficiency(t("readings").where("HAS_SOLAR = 1")), ["avg_export", "efficiency"], 6)


@query("d50_normalisation_effect", ["readings"], f"WITH {EFF} SELECT round(corr(e,c),6) AS before, round(corr(e/c,c),6) AS after FROM ac")
def normalisation(t):
    return rounded(PS.normalisation_effect(PS.account_efficiency(t("readings").where("HAS_SOLAR = 1"))), ["before", "after"], 6)


@query("d52_case_account", ["readings"], "WITH a AS (SELECT account_id, avg(NET_CONSUMPTION_kWh) m FROM readings GROUP BY 1), q AS (SELECT quantile_cont(m,0.5) q FROM a) SELECT account_id, round(q,6) AS median FROM a, q ORDER BY round(abs(m-q),9), account_id LIMIT 1")
def case_account(t):
    return rounded(PS.case_account(t("readings")), ["median"], 6)


# ---- forecast validation ---------------------------------------------------------

MET = """count(*) n, round(avg(abs(y_pred-y_true)),6) mae, round(sqrt(avg(pow(y_pred-y_true,2))),6) rmse"""


@query("d35_forecast_metrics", ["forecasts"], f"""SELECT {MET}, round(avg(abs(y_pred-y_true)/y_true) FILTER (y_true>0)*100,6) mape, round(1-sum(pow(y_pred-y_true,2))/(var_pop(y_true)*count(*)),6) r2, round(avg(y_pred-y_true),6) bias,
 round(avg(y_pred-y_true)/avg(y_true)*100,6) bias_pct, round(arg_max(abs(y_pred-y_true), y_true),4) peak_error, round(arg_max(abs(y_pred-y_true)/y_true*100, y_true),4) peak_error_pct FROM forecasts""")
def metrics(t):
    m = rounded(ME.forecast_metrics(t("forecasts")), ["mae", "rmse", "mape", "r2", "bias", "bias_pct"], 6)
    return rounded(m, ["peak_error", "peak_error_pct"])


@query("d35_mase", ["forecasts"], """WITH x AS (SELECT *, abs(y_true-lag(y_true,12) OVER (PARTITION BY account_id ORDER BY YEAR, MONTH)) nv FROM forecasts) SELECT round(avg(abs(y_true-y_pred)),6) mae, round(avg(nv),6) naive_mae, round(avg(abs(y_true-y_pred))/avg(nv),6) mase FROM x""")
def mase(t):
    return rounded(ME.scaled_error(t("forecasts")), ["mae", "naive_mae", "mase"], 6)


LVL = "CASE WHEN y<=0 THEN NULL WHEN y<=90 THEN 'Low' WHEN y<=150 THEN 'Medium-Low' WHEN y<=300 THEN 'Medium-High' WHEN y<=2000 THEN 'High' END"


@query("d36_metrics_by_level", ["forecasts"], f"SELECT level, {MET} FROM (SELECT *, {LVL.replace('y<', 'y_true<')} AS level FROM forecasts) GROUP BY 1")
def by_level(t):
    return rounded(ME.metrics_by_level(t("forecasts")), ["mae", "rmse"], 6)


@query("d36_metrics_by_season", ["forecasts"], f"SELECT CASE WHEN MONTH IN (12,1,2) THEN 'NE_Monsoon' WHEN MONTH IN (3,4) THEN 'Dry_Season' WHEN MONTH IN (5,6,7,8,9) THEN 'SW_Monsoon' ELSE 'Inter_Monsoon' END season, {MET} FROM forecasts GROUP BY 1")
def by_season(t):
    return rounded(ME.metrics_by_season(t("forecasts")), ["mae", "rmse"], 6)


@query("d36_metrics_by_month", ["forecasts"], f"SELECT MONTH, {MET} FROM forecasts GROUP BY 1")
def by_month(t):
    return rounded(ME.forecast_metrics(t("forecasts"), ["MONTH"]).select("MONTH", "n", "mae", "rmse"), ["mae", "rmse"], 6)


@query("c15_level_errors", ["forecasts", "readings"], f"""WITH l AS (SELECT DISTINCT account_id, {LVL.replace('y<', 'NET_CONSUMPTION_kWh<')} AS level FROM readings WHERE NET_CONSUMPTION_kWh>0)
 SELECT level, count(DISTINCT account_id) n_accounts, round(avg(abs(y_true-y_pred)),6) mae, round(sqrt(avg(pow(y_true-y_pred,2))),6) rmse FROM l JOIN forecasts USING (account_id) WHERE level IS NOT NULL GROUP BY 1""")
def level_errors(t):
    return rounded(ME.level_errors(t("forecasts"), t("readings")), ["mae", "rmse"], 6)


@query("d37_e18_naive_baselines", ["readings"], """WITH x AS (SELECT NET_CONSUMPTION_kWh v, lag(NET_CONSUMPTION_kWh) OVER w p1, lag(NET_CONSUMPTION_kWh,12) OVER w p12, avg(NET_CONSUMPTION_kWh) OVER (PARTITION BY MONTH) mm FROM readings WINDOW w AS (PARTITION BY account_id ORDER BY YEAR, MONTH))
 SELECT 'persistence' baseline, round(avg(abs(v-p1)),6) mae FROM x UNION ALL SELECT 'seasonal_naive', round(avg(abs(v-p12)),6) FROM x UNION ALL SELECT 'historical_average', round(avg(abs(v-mm)),6) FROM x""")
def baselines(t):
    return rounded(ME.naive_baselines(t("readings")), ["mae"], 6)


def dm_sql(g):
    return f"""WITH x AS (SELECT account_id, YEAR, MONTH, abs(y_true-y_pred)-abs(y_true-y_pred2) d FROM forecasts), l AS (SELECT *, {', '.join(f'lag(d,{k}) OVER (PARTITION BY account_id ORDER BY YEAR, MONTH) d{k}' for k in (1, 2, 3, 4))} FROM x),
 a AS (SELECT account_id, count(*) n, avg(d) db, var_pop(d) g0, {', '.join(f'covar_samp(d,d{k}) g{k}' for k in (1, 2, 3, 4))} FROM l GROUP BY 1), v AS (SELECT *, {g} vr FROM a)
 SELECT account_id, n, round(CASE WHEN vr>0 THEN db/sqrt(vr/n) ELSE 0 END,6) dm_statistic, CASE WHEN db<0 THEN 'model1' ELSE 'model2' END better_model FROM v"""


@query("d38_diebold_mariano", ["forecasts"], dm_sql("g0+2*(g1+g2+g3+g4)"))
def dm(t):
    return ME.diebold_mariano(t("forecasts"), ["account_id"], ["YEAR", "MONTH"]).select("account_id", "n", r("dm_statistic", 6).alias("dm_statistic"), "better_model")


@query("d38_diebold_mariano_compat", ["forecasts"], dm_sql("g1+2*(g2+g3+g4)"))
def dm_compat(t):
    return ME.diebold_mariano(t("forecasts"), ["account_id"], ["YEAR", "MONTH"], compat=True).select("account_id", "n", r("dm_statistic", 6).alias("dm_statistic"), "better_model")


@query("d39_residual_analysis", ["forecasts"], """WITH x AS (SELECT account_id, y_pred, y_true-y_pred e, lag(y_true-y_pred) OVER (PARTITION BY account_id ORDER BY YEAR, MONTH) p FROM forecasts), m AS (SELECT account_id, avg(e) m, stddev_pop(e) s FROM x GROUP BY 1)
 SELECT x.account_id, round(any_value(m),6) mean, round(any_value(s),6) std, round(avg(pow((e-m)/s,3)),6) skewness, round(avg(pow((e-m)/s,4))-3,6) kurtosis, round(sum(pow(e-p,2))/sum(e*e),6) durbin_watson, round(corr(abs(e),y_pred),6) heteroscedasticity_corr,
 abs(corr(abs(e),y_pred))<0.3 AS constant_variance FROM x JOIN m USING (account_id) GROUP BY 1""")
def residuals(t):
    return rounded(ME.residual_analysis(t("forecasts"), ["account_id"], ["YEAR", "MONTH"]), ["mean", "std", "skewness", "kurtosis", "durbin_watson", "heteroscedasticity_corr"], 6)


@query("d40_quantile_bias", ["forecasts"], " UNION ALL ".join(f"SELECT {p}e0 AS quantile, round(quantile_cont(y_true,{p}),6) actual, round(quantile_cont(y_pred,{p}),6) predicted, round(quantile_cont(y_pred,{p})-quantile_cont(y_true,{p}),6) bias FROM forecasts" for p in ("0.10", "0.25", "0.50", "0.75", "0.90")))
def quantile_bias(t):
    return rounded(ME.quantile_bias(t("forecasts")), ["actual", "predicted", "bias"], 6)


@query("d41_prediction_diversity", ["forecasts"], """WITH a AS (SELECT avg(y_true) m FROM forecasts) SELECT round(avg(abs(y_true-y_pred)),6) mae, round(avg(abs(y_true-m)),6) mean_mae, round((1-avg(abs(y_true-y_pred))/avg(abs(y_true-m)))*100,6) improvement_pct,
 count(DISTINCT round(y_pred+1e-7,1)) distinct_predictions, round(stddev_pop(y_pred)/stddev_pop(y_true),6) std_ratio FROM forecasts, a""")
def diversity(t):
    f = t("forecasts").withColumn("y_pred", F.col("y_pred") + 1e-7)
    return rounded(ME.diversity(f), ["mae", "mean_mae", "improvement_pct", "std_ratio"], 6)


@query("d42_coverage", ["forecasts"], "SELECT round(avg(CASE WHEN y_true BETWEEN y_pred*0.95e0 AND y_pred*1.05e0 THEN 1e0 ELSE 0 END)*100,6) coverage_pct, round(avg(CASE WHEN abs(y_true-y_pred)<=150 THEN 1e0 ELSE 0 END)*100,6) within_pct, round(avg(abs(y_true-y_pred)) FILTER (y_true<400),6) low_mae FROM forecasts")
def coverage(t):
    return rounded(ME.coverage(t("forecasts"), F.col("y_pred") * 0.95, F.col("y_pred") * 1.05), ["coverage_pct", "within_pct", "low_mae"], 6)


@query("i16_weighted_mae", ["forecasts"], "SELECT round(avg(abs(y_true-y_pred)*CASE WHEN y_true<200 THEN 3e0 WHEN y_true<400 THEN 2e0 ELSE 1e0 END),6) wmae FROM forecasts")
def weighted_mae(t):
    return t("forecasts").agg(r(ME.weighted_mae(F.col("y_true"), F.col("y_pred")), 6).alias("wmae"))


# ---- drift -----------------------------------------------------------------------

PDR = """h AS (SELECT account_id, YEAR, MONTH, avg(abs(y_true-y_pred)) mae FROM forecasts GROUP BY 1,2,3), rr AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY YEAR DESC, MONTH DESC) r FROM h),
pd AS (SELECT account_id, avg(mae) FILTER (r<=6) rm, avg(mae) FILTER (r>6) bm, stddev_pop(mae) FILTER (r>6) s FROM rr WHERE r<=12 GROUP BY 1 HAVING count(*)=12), pz AS (SELECT *, (rm-bm)/nullif(s,0) z FROM pd)"""


def pdrift(t):
    return DR.prediction_drift(DR.error_history(t("forecasts"), ["account_id", "YEAR", "MONTH"]), ["account_id"], ["YEAR", "MONTH"])


@query("e16_prediction_drift", ["forecasts"], f"""WITH {PDR} SELECT account_id, round(rm,6) recent_mae, round(bm,6) baseline_mae, round(z,6) z_score, coalesce(abs(z)>2,false) drift_detected, CASE WHEN abs(z)>3 THEN 'high' WHEN abs(z)>2 THEN 'medium' END severity FROM pz""")
def prediction_drift(t):
    return rounded(pdrift(t), ["recent_mae", "baseline_mae", "z_score"], 6)


KS_SQL = """lg AS (SELECT TRANSFORMER_CODE g, YEAR>=1999 AS rc, unnest(['NET_CONSUMPTION_kWh','IMPORT_kWh']) feature, unnest([NET_CONSUMPTION_kWh, IMPORT_kWh]) x FROM readings WHERE YEAR>=1999 OR YEAR<=1997),
hh AS (SELECT g, feature, x, count(*) FILTER (rc) a, count(*) FILTER (NOT rc) b FROM lg GROUP BY 1,2,3), cu AS (SELECT g, feature, sum(a) OVER w ca, sum(b) OVER w cb, sum(a) OVER (PARTITION BY g, feature) ta, sum(b) OVER (PARTITION BY g, feature) tb FROM hh WINDOW w AS (PARTITION BY g, feature ORDER BY x)),
ks AS (SELECT g, feature, max(abs(ca/ta-cb/tb)) ks, CAST(max(ta) AS BIGINT) n1, CAST(max(tb) AS BIGINT) n2 FROM cu GROUP BY 1,2)"""


def ks(t):
    return DR.feature_drift(t("readings"), ["TRANSFORMER_CODE"], [NET, "IMPORT_kWh"], F.col("YEAR") >= 1999, F.col("YEAR") <= 1997)


@query("e17_feature_drift", ["readings"], f"WITH {KS_SQL} SELECT g AS TRANSFORMER_CODE, feature, round(ks,8) ks_statistic, n1 AS n_recent, n2 AS n_baseline FROM ks")
def feature_drift(t):
    return ks(t).select("TRANSFORMER_CODE", "feature", r("ks_statistic", 8).alias("ks_statistic"), "n_recent", "n_baseline")


@query("c16_cluster_stability", ["readings"], """WITH c AS (SELECT account_id, TRANSFORMER_CODE, YEAR, CAST(least(floor(avg(NET_CONSUMPTION_kWh)/60),4) AS INT) k FROM readings GROUP BY 1,2,3)
 SELECT a.YEAR, count(*) total, count(*) FILTER (a.k<>b.k) changed, round(1-count(*) FILTER (a.k<>b.k)/count(*),6) stability FROM c a JOIN c b ON a.account_id=b.account_id AND a.YEAR=b.YEAR+1 GROUP BY 1""")
def cluster_stability(t):
    level = t("readings").groupBy("account_id", "TRANSFORMER_CODE", "YEAR").agg(F.least(F.floor(F.avg(NET) / 60), F.lit(4)).cast("int").alias("cluster"))
    out = DR.cluster_stability(level.withColumn("YEAR", F.col("YEAR") + 1), level, ["YEAR"])
    return out.select("YEAR", "total", "changed", r("stability", 6).alias("stability"))


@query("d60_drift_summary", ["forecasts"], f"""WITH {PDR}, al AS (SELECT account_id, CASE WHEN abs(z)>3 THEN 'high' ELSE 'medium' END sv FROM pz WHERE abs(z)>2)
 SELECT CASE WHEN count(*)>0 THEN 'drift_detected' ELSE 'healthy' END status, count(*) total_alerts, count(*) FILTER (sv='high') high, count(*) FILTER (sv='medium') medium,
 CASE WHEN count(*) FILTER (sv='high')>0 THEN 'URGENT: Model retraining recommended immediately' WHEN count(*) FILTER (sv='medium')>3 THEN 'WARNING: Consider retraining model within 1 month' ELSE 'OK: No action needed' END recommendation,
 CAST(least(count(*),5) AS INT) n_recent FROM al""")
def drift_summary(t):
    d = pdrift(t).where("drift_detected")
    alerts = d.select(F.lit(0).alias("at"), F.lit("prediction_error_drift").alias("type"), "severity", F.col("account_id").cast("string").alias("key"))
    s = DR.drift_summary(alerts)
    return s.select("status", "total_alerts", "high", "medium", "recommendation", F.size("recent_alerts").alias("n_recent"))


# ---- splits ----------------------------------------------------------------------

TR = "tr AS (SELECT YEAR*12+MONTH ti, row_number() OVER (ORDER BY YEAR*12+MONTH)-1 t, count(*) OVER () n FROM (SELECT DISTINCT YEAR, MONTH FROM readings)), rt AS (SELECT r.*, t, n FROM readings r JOIN tr ON ti=YEAR*12+MONTH)"


@query("e9_temporal_split", ["readings"], f"WITH {TR} SELECT account_id, YEAR, MONTH, CASE WHEN t<n-floor(n*0.2e0)-floor(n*0.1e0) THEN 'train' WHEN t<n-floor(n*0.2e0) THEN 'val' ELSE 'test' END split FROM rt")
def temporal_split(t):
    return SP.temporal_split(t("readings")).select("account_id", "YEAR", "MONTH", "split")


@query("e10_account_split", ["readings"], """WITH x AS (SELECT account_id, YEAR, MONTH, row_number() OVER (PARTITION BY account_id ORDER BY YEAR, MONTH)-1 i, count(*) OVER (PARTITION BY account_id) n FROM readings)
 SELECT account_id, YEAR, MONTH, CASE WHEN i<n-floor(n*0.2e0)-floor(n*0.1e0) THEN 'train' WHEN i<n-floor(n*0.2e0) THEN 'val' ELSE 'test' END split FROM x WHERE n>=24""")
def account_split(t):
    return SP.account_split(t("readings")).select("account_id", "YEAR", "MONTH", "split")


def folds_sql(cond):
    return f"WITH {TR} SELECT fold, CASE WHEN t<tend THEN 'train' ELSE 'test' END AS role, count(*) n, sum(account_id)::BIGINT ids FROM (SELECT rt.*, CAST(fold AS INT) AS fold, {cond} FROM rt CROSS JOIN (SELECT unnest(range(1,6)) fold)) WHERE t<tend OR (t>=tst AND t<tstop) GROUP BY 1,2"


def fold_counts(df):
    return df.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("account_id").alias("ids"))


@query("e11_walk_forward", ["readings"], folds_sql("fold*12 tend, fold*12 tst, (fold+1)*12 tstop"))
def walk_forward(t):
    return fold_counts(SP.walk_forward(t("readings")))


@query("e11_expanding_window", ["readings"], folds_sql("CASE WHEN 24+fold*12<=n THEN 24+(fold-1)*12 END tend, CASE WHEN 24+fold*12<=n THEN 24+(fold-1)*12 END tst, 24+fold*12 tstop").replace("range(1,6)", "range(1,100)"))
def expanding(t):
    return fold_counts(SP.expanding_window(t("readings")))


@query("e11_walk_forward_short", ["readings"], folds_sql("CASE WHEN fold*6<n THEN fold*6 END tend, CASE WHEN fold*6<n THEN fold*6 END tst, (fold+1)*6 tstop").replace("range(1,6)", "range(1,41)"))
def walk_forward_short(t):
    """Forty windows are asked for; the whole history is too short for them and ends the folds early."""
    return fold_counts(SP.walk_forward(t("readings"), 40, 6))


@query("e11_fold_split", ["readings"], folds_sql("fold*floor(n/6) tend, fold*floor(n/6)+2 tst, (fold+1)*floor(n/6) tstop"))
def fold_split(t):
    return fold_counts(SP.fold_split(t("readings"), 5, gap=2))


@query("e11_date_split", ["readings"], "SELECT account_id, YEAR, MONTH, CASE WHEN YEAR*12+MONTH < 2000*12+6 THEN 'train' ELSE 'test' END split FROM readings")
def date_split(t):
    return SP.date_split(t("readings"), 2000, 6).select("account_id", "YEAR", "MONTH", "split")


@query("i2_group_split", ["readings"], "SELECT CASE WHEN substr(md5(concat_ws('|', account_id, 42)), 1, 8) < '33333333' THEN 'test' ELSE 'train' END split, count(*) n, count(DISTINCT account_id) accounts FROM readings GROUP BY 1")
def group_split(t):
    return SP.group_split(t("readings")).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("account_id").alias("accounts"))


@query("c13_leakage_check", ["readings"], "SELECT CAST(0 AS BIGINT) AS shared, count(DISTINCT account_id) AS groups FROM readings")
def leakage(t):
    return SP.leakage(SP.group_split(t("readings")))


@query("c11_semi_join_months", ["readings"], "SELECT account_id, YEAR, MONTH FROM readings WHERE (YEAR, MONTH) IN (SELECT DISTINCT YEAR, MONTH FROM readings WHERE NET_CONSUMPTION_kWh > 400)")
def semi_join(t):
    keep = t("readings").where(F.col(NET) > 400).select("YEAR", "MONTH")
    return t("readings").join(keep, ["YEAR", "MONTH"], "left_semi").select("account_id", "YEAR", "MONTH")


@query("c14_invalid_tariffs", ["readings"], f"WITH {QI} SELECT CAL_TARIFF, count(*) n FROM qi WHERE CAL_TARIFF NOT IN ('D1','GP1','GP2') GROUP BY 1")
def invalid_tariffs(t):
    valid = F.col("CAL_TARIFF").isin(C.VALID_TARIFFS)
    return quality_input(t).where(~valid).groupBy("CAL_TARIFF").agg(F.count(F.lit(1)).alias("n"))


@query("d58_d59_fold_summary", ["forecasts"], """WITH f AS (SELECT YEAR, account_id%5 AS fam, avg(abs(y_true-y_pred)) mae FROM forecasts GROUP BY 1,2), g AS (SELECT fam, avg(mae) m, stddev_pop(mae) s, min(mae) mi, max(mae) ma FROM f GROUP BY 1)
 SELECT fam, round(m,6) mean, round(s,6) std, round(mi,6) min, round(ma,6) max, round(s/m,6) cv, CASE WHEN s/m<0.1 THEN 'very stable' WHEN s/m<0.2 THEN 'stable' WHEN s/m<0.3 THEN 'moderate' ELSE 'unstable' END stability FROM g""")
def fold_summary(t):
    f = t("forecasts").groupBy("YEAR", (F.col("account_id") % 5).alias("fam")).agg(F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("mae"))
    return rounded(ME.fold_summary(f, ["fam"], "mae"), ["mean", "std", "min", "max", "cv"], 6)


@query("d53_batch_outcomes", ["users"], "SELECT count(*) total, count(*) FILTER (user_id%50<>0) successful, count(*) FILTER (user_id%50=0) failed FROM users")
def batch_outcomes(t):
    from gridlight.operators.clean import validate_requests
    raw = t("users").select("user_id", F.when(F.col("user_id") % 50 == 0, 12.0).otherwise(F.col("latitude")).alias("latitude"), "longitude",
                            F.create_map(F.lit(9), "kwh_m09", F.lit(10), "kwh_m10").alias("consumption_months"), "tariff", "phase", "has_solar")
    ok = F.size("errors") == 0
    return validate_requests(raw).agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"))
