"""Distance joins, suitability, similar households, patterns and ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlight import constants as C
from gridlight.catalog.base import query
from gridlight.catalog.tables_and_bills import PROFILE_SQL, ROLLUP_SQL, hav, r, rounded
from gridlight.functions import geo as G, numeric as N, suitability as S, text as TX
from gridlight.operators import ensemble as EN, pattern as PA, rollup as RU, similarity as SI, suitability as SU
from gridlight.operators.spatial import radius_join, top_k
from gridlight.session import cut_lineage


def requests(t):
    return t("users").withColumn("consumption_months", F.create_map(
        F.lit(9), "kwh_m09", F.lit(10), "kwh_m10", F.lit(11), "kwh_m11"))


def near_transformers(t):
    return radius_join(t("users"), t("transformers"), "search_radius_m", point_id="user_id", target_id="TRANSFORMER_CODE", max_radius_m=2000.0)


D_UT = hav("latitude", "longitude", "TRANSFORMER_LAT", "TRANSFORMER_LON")
D_UA = hav("latitude", "longitude", "CUSTOMER_LAT", "CUSTOMER_LON")


@query("c5_radius_join", ["users", "transformers"], f"""SELECT * FROM (SELECT user_id, TRANSFORMER_CODE, round({D_UT},4) distance_m FROM users JOIN transformers ON true) WHERE distance_m <= 2000""")
def radius(t):
    return near_transformers(t).select("user_id", "TRANSFORMER_CODE", r("distance_m").alias("distance_m"))


@query("c6_bounding_box", ["users"], """SELECT user_id, round(latitude-2000/111194.92664455873e0,8) lat_min, round(latitude+2000/111194.92664455873e0,8) lat_max,
 round(longitude-2000/111194.92664455873e0/cos(radians(latitude+2000/111194.92664455873e0)),8) lon_min, round(longitude+2000/111194.92664455873e0/cos(radians(latitude+2000/111194.92664455873e0)),8) lon_max FROM users""")
def box(t):
    b = G.bounding_box(F.col("latitude"), F.col("longitude"), F.col("search_radius_m"))
    return t("users").select("user_id", *[r(c, 8).alias(n) for n, c in b.items()])


@query("c7_household_radius", ["users", "accounts"], f"""SELECT * FROM (SELECT user_id, account_id, round({D_UA},4) distance_m FROM users JOIN accounts ON true) WHERE distance_m <= 2000""")
def households(t):
    p = radius_join(t("users"), t("accounts"), 2000.0, point_id="user_id", target_id="account_id", target=("CUSTOMER_LAT", "CUSTOMER_LON"))
    return p.select("user_id", "account_id", r("distance_m").alias("distance_m"))


@query("h1_haversine", ["readings"], f"""SELECT account_id, YEAR, MONTH, round({hav('CUSTOMER_LAT', 'CUSTOMER_LON', 'TRANSFORMER_LAT', 'TRANSFORMER_LON')},4) d FROM readings""")
def haversine(t):
    return RU.with_distance(t("readings")).select("account_id", "YEAR", "MONTH", r("DISTANCE_FROM_TF_M").alias("d"))


def geodesic_sql(steps: int = 8) -> str:
    """The inverse solution as a chain of selects, one step each, over pairs within a little more than the radius."""
    f = "(1/298.257223563e0)"
    out = f"""WITH x0 AS (SELECT user_id, TRANSFORMER_CODE, atan((1-{f})*tan(radians(latitude))) u1, atan((1-{f})*tan(radians(TRANSFORMER_LAT))) u2, radians(TRANSFORMER_LON-longitude) l, radians(TRANSFORMER_LON-longitude) x
 FROM users JOIN transformers ON true WHERE {D_UT} <= 2100)"""
    parts = ("sqrt(pow(cos(u2)*sin(x),2)+pow(cos(u1)*sin(u2)-sin(u1)*cos(u2)*cos(x),2)) ss, sin(u1)*sin(u2)+cos(u1)*cos(u2)*cos(x) cs", "CASE WHEN ss=0 THEN 0 ELSE cos(u1)*cos(u2)*sin(x)/ss END sa",
             "1-sa*sa c2", "CASE WHEN c2<1e-15 THEN 0 ELSE cs-2*sin(u1)*sin(u2)/c2 END m")
    for i in range(steps + 1):
        source = f"x{i}"
        for j, part in enumerate(parts):
            out += f", y{i}_{j} AS (SELECT *, {part} FROM {source})"
            source = f"y{i}_{j}"
        if i < steps:
            out += f", z{i} AS (SELECT *, {f}/16*c2*(4+{f}*(4-3*c2)) c FROM {source}), x{i + 1} AS (SELECT user_id, TRANSFORMER_CODE, u1, u2, l, l+(1-c)*{f}*sa*(atan2(ss,cs)+c*ss*(m+c*cs*(2*m*m-1))) x FROM z{i})"
    return out + f""", g AS (SELECT *, c2*(1/pow(1-{f},2)-1) u FROM {source}), h AS (SELECT *, 1+u/16384*(4096+u*(-768+u*(320-175*u))) ba, u/1024*(256+u*(-128+u*(74-47*u))) bb FROM g),
 d AS (SELECT user_id, TRANSFORMER_CODE, 6378137e0*(1-{f})*ba*(atan2(ss,cs)-bb*ss*(m+bb/4*(cs*(2*m*m-1)-bb/6*m*(4*ss*ss-3)*(4*m*m-3)))) d FROM h)
SELECT user_id, TRANSFORMER_CODE, round(d,3) distance_m FROM d WHERE d<=2000"""


@query("h2_geodesic_radius", ["users", "transformers"], geodesic_sql())
def geodesic(t):
    p = radius_join(t("users"), t("transformers"), "search_radius_m", point_id="user_id", target_id="TRANSFORMER_CODE",
                    max_radius_m=2000.0, distance=G.geodesic_m)
    return p.select("user_id", "TRANSFORMER_CODE", r("distance_m", 3).alias("distance_m"))


@query("c4_transformer_location", ["accounts", "transformers"], """SELECT account_id, a.TRANSFORMER_CODE, TRANSFORMER_LAT, TRANSFORMER_LON, DESCRIPTION FROM accounts a LEFT JOIN transformers t USING (TRANSFORMER_CODE)""")
def location(t):
    return t("accounts").join(t("transformers"), "TRANSFORMER_CODE", "left").select(
        "account_id", "TRANSFORMER_CODE", "TRANSFORMER_LAT", "TRANSFORMER_LON", "DESCRIPTION")


ASSESS_SQL = ROLLUP_SQL + f""", us AS (SELECT *, 1.5e0 + user_id % 9 AS kw FROM users),
pr AS (SELECT user_id, kw, tf.*, {D_UT} AS d FROM us JOIN tf ON true), nr AS (SELECT *, current_load_kW+total_solar_capacity tb FROM pr WHERE d<=2000),
ha AS (SELECT *, 100e0-tb av, 80e0-tb sh, (tb+kw)/100 ua FROM nr),
hsc AS (SELECT *, CASE WHEN sh/kw>=1.5 THEN 100e0 WHEN sh/kw>=1 THEN 80e0 WHEN av/kw>=1 THEN 50e0 ELSE 0e0 END hs, 100*exp(-d/1000) ds, CASE WHEN ua<=0.70 THEN 100e0 WHEN ua<=0.85 THEN 75e0 WHEN ua<=0.95 THEN 40e0 ELSE 0e0 END ss FROM ha),
sc AS (SELECT *, hs*0.4e0+ds*0.3e0+ss*0.3e0 AS rs FROM hsc), b AS (SELECT *, rs*0.55e0+50e0*0.45e0 AS score FROM sc)"""


def sites(t):
    return t("users").withColumn("solar_kw", 1.5 + F.col("user_id") % 9)


@query("h26_h29_suitability", ["users", "readings"], "WITH " + ASSESS_SQL + """ SELECT user_id, TRANSFORMER_CODE, round(hs,2) headroom_score, round(ds,4) distance_score, round(ss,2) stability_score, round(rs,4) rule_score,
 round(score,4) score, CASE WHEN score>=80 THEN 'IDEAL' WHEN score>=60 THEN 'GOOD' WHEN score>=40 THEN 'FAIR' ELSE 'POOR' END AS label, av>=kw AS can_support, ua>0.75 AS curtailment_risk,
 round(greatest(0e0,(av-kw)/100*100),4) headroom_margin_pct, CASE WHEN score>=60 THEN list_max(list_filter([1.5e0,3,5,7.5,10,15,20], lambda x: x <= av*0.8e0)) END recommended_kw FROM b""")
def suitability(t):
    tf = RU.transformer_features(RU.transformer_rollup(t("readings")))
    pairs = radius_join(sites(t), tf, "search_radius_m", point_id="user_id", target_id="TRANSFORMER_CODE", max_radius_m=2000.0)
    out = rounded(SU.score_transformers(pairs), ["distance_score", "rule_score", "score", "headroom_margin_pct"])
    return out.select("user_id", "TRANSFORMER_CODE", "headroom_score", "distance_score", "stability_score", "rule_score", "score", "label",
                      "can_support", "curtailment_risk", "headroom_margin_pct", "recommended_kw")


@query("e12_top_transformers", ["users", "readings"], "WITH " + ASSESS_SQL + """ SELECT * FROM (SELECT user_id, TRANSFORMER_CODE, round(score,4) score, round(d,3) distance_m,
 row_number() OVER (PARTITION BY user_id ORDER BY round(score,6) DESC, round(d,3), TRANSFORMER_CODE) AS rank FROM b) WHERE rank<=5""")
def top_transformers(t):
    tf = RU.transformer_features(RU.transformer_rollup(t("readings")))
    out = SU.assess(sites(t), tf, max_radius_m=2000.0)
    return out.select("user_id", "TRANSFORMER_CODE", r("score").alias("score"), r("distance_m", 3).alias("distance_m"), "rank")


@query("f3_best_transformer", ["users", "readings"], "WITH " + ASSESS_SQL + """ SELECT user_id, arg_max(TRANSFORMER_CODE, round(score,6)*1e6 - round(d,3)/1e6) AS best, round(max(score),4) score FROM b GROUP BY 1""")
def best_transformer(t):
    tf = RU.transformer_features(RU.transformer_rollup(t("readings")))
    pairs = radius_join(sites(t), tf, "search_radius_m", point_id="user_id", target_id="TRANSFORMER_CODE", max_radius_m=2000.0)
    key = F.struct(F.round("score", 6), -F.round("distance_m", 3))
    return SU.score_transformers(pairs).groupBy("user_id").agg(F.max_by("TRANSFORMER_CODE", key).alias("best"), r(F.max("score")).alias("score"))


@query("h28_recommendation_text", ["users", "readings"], "WITH " + ASSESS_SQL + """ SELECT user_id, TRANSFORMER_CODE, CASE
 WHEN score>=80 THEN printf('Highly suitable. Transformer has %.1f kW of available headroom. Proceed with grid connection.', av)
 WHEN score>=60 THEN printf('Conditionally suitable. Post-connection utilisation will be %.1f%%. Review with your utility provider.', ua*100)
 WHEN score>=40 AND ua>0.75 THEN 'Fair option but curtailment risk is elevated. Consider scheduling generation during off-peak hours or choosing an alternative transformer.'
 WHEN score>=40 THEN 'Marginal suitability due to limited headroom. An upgrade assessment is recommended before connecting.'
 ELSE printf('Not suitable. Only %.1f kW headroom available against %.1f kW requested. Select a different transformer.', av, kw) END AS recommendation FROM b""")
def recommendation(t):
    tf = RU.transformer_features(RU.transformer_rollup(t("readings")))
    pairs = radius_join(sites(t), tf, "search_radius_m", point_id="user_id", target_id="TRANSFORMER_CODE", max_radius_m=2000.0)
    return SU.score_transformers(pairs).select("user_id", "TRANSFORMER_CODE", "recommendation")


@query("h62_dashboard_scores", ["users", "readings"], "WITH " + ASSESS_SQL + """ SELECT user_id, TRANSFORMER_CODE, round(least(100e0, av),4) headroom_score,
 round(CASE WHEN d<=1000 THEN greatest(0e0,100-d/10) ELSE 0e0 END,4) distance_score, CASE WHEN ua>0.75 THEN 20e0 ELSE 80e0 END stability_score FROM b""")
def dashboard(t):
    tf = RU.transformer_features(RU.transformer_rollup(t("readings")))
    pairs = radius_join(sites(t), tf, "search_radius_m", point_id="user_id", target_id="TRANSFORMER_CODE", max_radius_m=2000.0)
    sc = SU.score_transformers(pairs).select("user_id", "TRANSFORMER_CODE", "ESTIMATED_CAPACITY_kW", "available_headroom_kw", "distance_m", "curtailment_risk")
    d = S.dashboard_scores(F.col("ESTIMATED_CAPACITY_kW"), F.col("available_headroom_kw"), F.col("distance_m"), F.col("curtailment_risk"))
    return sc.select("user_id", "TRANSFORMER_CODE", *[r(c).alias(n) for n, c in d.items()])


@query("d43_confusion_matrix", ["users", "readings"], "WITH " + ASSESS_SQL + """, cm AS (SELECT count(*) FILTER (av>=kw AND score>=60) tp, count(*) FILTER (av<kw AND score>=60) fp, count(*) FILTER (av>=kw AND score<60) fn,
 count(*) FILTER (av<kw AND score<60) tn FROM b) SELECT tp, fp, fn, tn, round(tp/nullif(tp+fp,0),6) AS "precision", round(tp/nullif(tp+fn,0),6) AS recall, round(2e0*tp/nullif(2*tp+fp+fn,0),6) AS f1 FROM cm""")
def confusion(t):
    from gridlight.operators.metrics import confusion_matrix
    tf = RU.transformer_features(RU.transformer_rollup(t("readings")))
    pairs = radius_join(sites(t), tf, "search_radius_m", point_id="user_id", target_id="TRANSFORMER_CODE", max_radius_m=2000.0)
    return rounded(confusion_matrix(SU.score_transformers(pairs), F.col("can_support"), F.col("score") >= 60), ["precision", "recall", "f1"], 6)


# ---- similarity ------------------------------------------------------------------

SIM_SQL = PROFILE_SQL + f""", um AS (SELECT user_id, 9 AS m, kwh_m09 AS k FROM users UNION ALL SELECT user_id, 10, kwh_m10 FROM users UNION ALL SELECT user_id, 11, kwh_m11 FROM users),
md AS (SELECT account_id, quantile_cont(net,0.5) hm FROM pm GROUP BY 1),
pr AS (SELECT user_id, account_id, u.phase, pa.PHASE AS aphase, months_with_data mw, low_months lm, {D_UA} AS d FROM users u JOIN pa ON u.has_solar=pa.HAS_SOLAR AND u.tariff=pa.CAL_TARIFF AND pa.months_with_data>=6),
nb AS (SELECT * FROM pr WHERE d<=2000),
x AS (SELECT nb.user_id, nb.account_id, count(*) n, avg(k) um, avg(net) pmn, regr_slope(k,m) s1, regr_slope(net,m) s2, CASE WHEN max(k)>min(k) AND max(net)>min(net) THEN corr(k,net) END c
 FROM nb JOIN um ON um.user_id=nb.user_id JOIN pm ON pm.account_id=nb.account_id AND pm.MONTH=um.m GROUP BY 1,2),
y AS (SELECT nb.*, coalesce(n,0) n, s1, s2, c, CASE WHEN pmn>0 THEN um/pmn ELSE 1 END ratio FROM nb LEFT JOIN x USING (user_id, account_id)),
z AS (SELECT *, greatest(0e0,1-d/2000) geo, CASE WHEN n<2 THEN 0.5e0 ELSE greatest(0e0,least(1e0,0.8e0*CASE WHEN ratio BETWEEN 0.95 AND 1.05 THEN 1e0 WHEN ratio BETWEEN 0.9 AND 1.1 THEN 0.8e0 WHEN ratio BETWEEN 0.85 AND 1.15 THEN 0.5e0
  WHEN ratio BETWEEN 0.8 AND 1.2 THEN 0.2e0 ELSE 0e0 END + 0.2e0*coalesce((c+1)/2,0.5e0))) END pat, 0.7e0+CASE WHEN phase=aphase THEN 0.2e0 ELSE 0e0 END+0.1e0*(mw/12)*(12-lm)/12 tech,
  CASE WHEN n<3 THEN 0.5e0 ELSE greatest(0e0,least(1e0,1-abs(s1-s2)/greatest(abs(s1),abs(s2),50e0))) END sea FROM y),
sc AS (SELECT *, least(1e0, geo*0.15e0+pat*0.6e0+tech*0.15e0+sea*0.1e0) score FROM z),
sim AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score,9) DESC, account_id) rank FROM sc WHERE score>=0.4) WHERE rank<=10)"""
SIM_NEEDS = ["readings", "users"]


def similar(t):
    return SI.similar_households(requests(t), RU.customer_profiles(t("readings")))


def similar_once(t):
    """Checkpointed, as the steps that follow read it several times."""
    return cut_lineage(similar(t))


@query("h30_h36_similarity_scores", SIM_NEEDS, "WITH " + SIM_SQL + """ SELECT user_id, account_id, round(d,3) distance_m, round(geo,6) geographic_score, round(pat,6) pattern_score, round(tech,6) technical_score,
 round(sea,6) seasonal_score, round(score,6) score FROM sc""")
def scores(t):
    s = SI.similarity_scores(SI.household_pairs(requests(t), RU.customer_profiles(t("readings"))))
    six = ["geographic_score", "pattern_score", "technical_score", "seasonal_score", "score"]
    return rounded(s.withColumn("distance_m", r("distance_m", 3)), six, 6).select("user_id", "account_id", "distance_m", *six)


@query("c8_similarity_topk", SIM_NEEDS, "WITH " + SIM_SQL + " SELECT user_id, account_id, rank, round(score,6) score FROM sim")
def topk(t):
    return similar(t).select("user_id", "account_id", "rank", r("score", 6).alias("score"))


@query("h57_request_key", ["users"], """SELECT user_id, md5(concat('{"lat":',CAST(round(latitude,4) AS VARCHAR),',"lon":',CAST(round(longitude,4) AS VARCHAR),',"tariff":"',tariff,'"}')) AS request_key FROM users""")
def request_key(t):
    return t("users").select("user_id", TX.request_key(F.round("latitude", 4).alias("lat"), F.round("longitude", 4).alias("lon"), F.col("tariff")).alias("request_key"))


# ---- pattern ---------------------------------------------------------------------

PTS_SQL = SIM_SQL + """, ws AS (SELECT *, score/sum(score) OVER (PARTITION BY user_id) w FROM sim),
pt AS (SELECT ws.user_id, ws.account_id, pm.MONTH AS month, net AS v, w FROM ws JOIN pm USING (account_id) JOIN md USING (account_id) WHERE pm.MONTH<=11 AND net BETWEEN 10 AND 2000 AND net BETWEEN 0.3e0*hm AND 3e0*hm),
cw AS (SELECT *, sum(w) OVER (PARTITION BY user_id, month ORDER BY v, account_id) cum, sum(w) OVER (PARTITION BY user_id, month) tot FROM pt),
wm AS (SELECT user_id, month, min(v) FILTER (cum >= tot/2 - 1e-12) med FROM cw GROUP BY 1,2),
qs AS (SELECT user_id, month, CAST(count(*) AS INT) n, quantile_cont(v,0.75)-quantile_cont(v,0.25) iqr, quantile_cont(v,0.10) p10, quantile_cont(v,0.90) p90 FROM pt GROUP BY 1,2),
sf AS (SELECT CAST(unnest(range(1,13)) AS INT) AS month, unnest([0.85e0,0.90,1.15,1.25,1.20,1.00,0.85,0.90,1.00,1.10,1.05,0.95]) f),
hd AS (SELECT user_id, avg(score) avs, CAST(count(*) AS INT) ns FROM sim GROUP BY 1),
mp AS (SELECT hd.user_id, sf.month, f, avs, ns, coalesce(n,0) n, CASE WHEN n>=3 THEN med ELSE 350*f END med, CASE WHEN n>=3 THEN iqr ELSE 350*f*0.4e0 END iqr,
 CASE WHEN n>=3 THEN p10 ELSE 350*f*0.6e0 END p10, CASE WHEN n>=3 THEN p90 ELSE 350*f*1.4e0 END p90
 FROM hd CROSS JOIN sf LEFT JOIN qs ON qs.user_id=hd.user_id AND qs.month=sf.month LEFT JOIN wm ON wm.user_id=hd.user_id AND wm.month=sf.month)"""
PAT_SQL = PTS_SQL + """, sm AS (SELECT a.* EXCLUDE (med), b.med*0.25+a.med*0.5+c.med*0.25 AS med FROM mp a JOIN mp b ON b.user_id=a.user_id AND b.month=(a.month+10)%12+1 JOIN mp c ON c.user_id=a.user_id AND c.month=a.month%12+1),
ql AS (SELECT user_id, avg(med) ann, count(*) FILTER (n>=3)/12 s1, greatest(0e0,1-avg(iqr)/avg(med)/0.5e0) s2, greatest(0e0,1-coalesce(stddev_pop(iqr)/nullif(avg(iqr),0),0)/0.3e0) s3, CAST(sum(n) AS BIGINT) tp, any_value(avs) avs FROM sm GROUP BY 1),
cf AS (SELECT *, greatest(0e0,least(1e0,s1*0.6e0+s2*0.2e0+s3*0.2e0)) q FROM ql),
rp AS (SELECT sm.*, ann, q, tp, greatest(0.3e0,least(0.95e0,cf.avs*0.4e0+q*0.3e0+least(1e0,tp/12/5)*0.3e0)) conf FROM sm JOIN cf USING (user_id))"""
LADDER = """CASE WHEN u<50 THEN greatest(0.10e0,least(1.20e0,x)) WHEN u<75 THEN greatest(0.12e0,least(1.18e0,x)) WHEN u<100 THEN greatest(0.15e0,least(1.15e0,x)) WHEN u<125 THEN greatest(0.18e0,least(1.15e0,x))
 WHEN u<150 THEN greatest(0.22e0,least(1.12e0,x)) WHEN u<175 THEN greatest(0.26e0,least(1.12e0,x)) WHEN u<200 THEN greatest(0.30e0,least(1.10e0,x)) WHEN u<250 THEN greatest(0.35e0,least(1.10e0,x))
 WHEN u<300 THEN greatest(0.40e0,least(1.08e0,x)) WHEN u<400 THEN greatest(0.50e0,least(1.08e0,x)) ELSE greatest(0.60e0,least(1.05e0,x)) END"""
ADJ_SQL = PAT_SQL + f""", um2 AS (SELECT user_id, quantile_cont(k,0.5) u FROM um GROUP BY 1), pmed AS (SELECT user_id, quantile_cont(med,0.5) p FROM rp WHERE month IN (9,10,11) GROUP BY 1),
fa AS (SELECT user_id, {LADDER} AS fac FROM (SELECT user_id, u, CASE WHEN p>0 THEN u/p ELSE 1 END x FROM um2 JOIN pmed USING (user_id))),
ad AS (SELECT rp.* REPLACE (med*fac AS med, iqr*fac AS iqr, p10*fac AS p10, p90*fac AS p90), fac FROM rp JOIN fa USING (user_id)), an AS (SELECT user_id, avg(med) aa FROM ad GROUP BY 1),
bl AS (SELECT ad.* REPLACE (med*0.7e0+aa*f*0.3e0 AS med), aa FROM ad JOIN an USING (user_id)), pk AS (SELECT user_id, max(med) pv, arg_max(month, med) pmo FROM bl GROUP BY 1),
bo AS (SELECT bl.* REPLACE (CASE WHEN month=4 AND pmo<>4 AND med<pv*0.95e0 THEN pv*1.05e0 WHEN month IN (7,8) AND med>aa*1.1e0 THEN med*0.9e0 ELSE med END AS med) FROM bl JOIN pk USING (user_id)),
se AS (SELECT a.* REPLACE (b.med*0.25+a.med*0.5+c.med*0.25 AS med) FROM bo a JOIN bo b ON b.user_id=a.user_id AND b.month=(a.month+10)%12+1 JOIN bo c ON c.user_id=a.user_id AND c.month=a.month%12+1),
up AS (SELECT us.user_id, sf.month, coalesce(med,350*sf.f) med, coalesce(iqr,80e0) iqr, coalesce(conf,0.3e0) conf, coalesce(ns,0) ns FROM users us CROSS JOIN sf LEFT JOIN se ON se.user_id=us.user_id AND se.month=sf.month)"""
FC_SQL = ADJ_SQL + """, fc AS (SELECT up.user_id, (month+12-12)%12+1 AS horizon, CASE WHEN month=12 THEN 2025 ELSE 2026 END AS year, month, med AS kwh, greatest(0e0,med-iqr) lower_kwh, med+iqr upper_kwh,
 CASE WHEN month IN (9,10,11) THEN 0.9e0 ELSE conf*exp(-least(least(abs(month-9),12-abs(month-9)),least(abs(month-10),12-abs(month-10)),least(abs(month-11),12-abs(month-11)))/6e0) END confidence FROM up)"""


@query("d17_weighted_median", SIM_NEEDS, "WITH " + PTS_SQL + " SELECT user_id, month, round(med,4) AS weighted_median FROM wm")
def wmedian(t):
    stats = PA.month_statistics(PA.pattern_points(similar_once(t)))
    return stats.select("user_id", "month", r("median").alias("weighted_median"))


@query("d18_monthly_pattern", SIM_NEEDS, "WITH " + PTS_SQL + " SELECT user_id, month, n AS n_points, round(med,4) median, round(iqr,4) iqr, round(p10,4) p10, round(p90,4) p90 FROM mp")
def monthly_pattern(t):
    return rounded(PA.monthly_patterns(similar_once(t)), ["median", "iqr", "p10", "p90"]).select("user_id", "month", "n_points", "median", "iqr", "p10", "p90")


@query("d19_d20_pattern_quality", SIM_NEEDS, "WITH " + PAT_SQL + " SELECT user_id, month, round(med,4) median, round(q,6) quality_score, round(conf,6) confidence, tp AS total_points FROM rp")
def pattern_quality(t):
    p = rounded(rounded(PA.robust_pattern(similar_once(t)), ["median"]), ["quality_score", "confidence"], 6)
    return p.select("user_id", "month", "median", "quality_score", "confidence", "total_points")


@query("h37_h38_user_pattern", SIM_NEEDS, "WITH " + ADJ_SQL + " SELECT user_id, month, round(med,4) median, round(iqr,4) iqr, round(conf,6) confidence, ns AS n_similar FROM up")
def user_pattern(t):
    p = PA.user_patterns(requests(t), similar_once(t))
    return rounded(rounded(p, ["median", "iqr"]), ["confidence"], 6).select("user_id", "month", "median", "iqr", "confidence", "n_similar")


@query("h40_pattern_forecast", SIM_NEEDS, "WITH " + FC_SQL + """ SELECT user_id, horizon, year, month, round(kwh,6) kwh, round(lower_kwh,6) lower_kwh, round(upper_kwh,6) upper_kwh, round(confidence,6) confidence,
 CASE WHEN month IN (12,1,2) THEN 'NE Monsoon' WHEN month IN (5,6,7,8,9) THEN 'SW Monsoon' ELSE 'Dry Season' END AS season, month IN (1,4,5,12) AS is_holiday_month, round(kwh/avg(kwh) OVER (PARTITION BY user_id),6) seasonal_factor FROM fc""")
def forecast(t):
    f = PA.pattern_forecast(PA.user_patterns(requests(t), similar_once(t)))
    return rounded(f, ["kwh", "lower_kwh", "upper_kwh", "confidence", "seasonal_factor"], 6)


@query("d56_forecast_statistics", SIM_NEEDS, "WITH " + FC_SQL + """ SELECT user_id, round(sum(kwh),3) annual_total, round(avg(kwh),4) annual_average, arg_max(month, round(kwh+1e-7,5)*1e7-month) peak_month, round(max(kwh),4) peak_kwh, arg_min(month, round(kwh+1e-7,5)*1e7+month) low_month,
 round(min(kwh),4) low_kwh, CASE WHEN regr_slope(kwh,horizon)>2 THEN 'increasing' WHEN regr_slope(kwh,horizon)<-2 THEN 'decreasing' ELSE 'stable' END trend, round(stddev_pop(kwh),4) monthly_variability,
 round(stddev_pop(kwh)/avg(kwh),6) seasonality_index, round(avg(confidence),6) overall_confidence FROM fc GROUP BY 1""")
def forecast_stats(t):
    s = PA.forecast_statistics(PA.pattern_forecast(PA.user_patterns(requests(t), similar_once(t))), ["user_id"])
    s = rounded(s, ["annual_average", "peak_kwh", "low_kwh", "monthly_variability"])
    return rounded(s, ["seasonality_index", "overall_confidence"], 6).withColumn("annual_total", r("annual_total", 3))


@query("h39_default_pattern", ["users"], """SELECT user_id, month, round(300*f,4) kwh, 0.3e0 AS confidence FROM users CROSS JOIN (SELECT CAST(unnest(range(1,13)) AS INT) AS month, unnest([0.85e0,0.90,1.15,1.25,1.20,1.00,0.85,0.90,1.00,1.10,1.05,0.95]) f)""")
def national(t):
    return rounded(PA.national_fallback(requests(t)), ["kwh"])


ENS_SQL = FC_SQL + """, me AS (SELECT user_id, month, kwh, confidence, 'pattern' me FROM fc UNION ALL SELECT user_id, sf.month, 300*f, 0.3e0, 'national' FROM users CROSS JOIN sf),
mc AS (SELECT user_id, me, avg(confidence)*0.5e0 w FROM me GROUP BY 1,2), cb AS (SELECT me.user_id, month, sum(kwh*w)/sum(w) AS v, avg(confidence) c, min(kwh) lo, max(kwh) hi, stddev_pop(kwh) sd, quantile_cont(kwh,0.25) q25, quantile_cont(kwh,0.75) q75,
 CAST(count(*) AS INT) n FROM me JOIN mc USING (user_id, me) GROUP BY 1,2), ua AS (SELECT user_id, avg(k) ua FROM um GROUP BY 1), ma AS (SELECT user_id, avg(v) ma FROM cb GROUP BY 1),
en AS (SELECT cb.*, v*ua/ma AS k FROM cb JOIN ua USING (user_id) JOIN ma USING (user_id))"""


def ensemble(t):
    u = requests(t)
    pat = PA.pattern_forecast(PA.user_patterns(u, similar_once(t)))
    return EN.combine(EN.stack_forecasts({"pattern": pat, "national": PA.national_fallback(u)}), u)


@query("h41_h42_ensemble", SIM_NEEDS, "WITH " + ENS_SQL + """ SELECT user_id, month, round(k,6) kwh, round(c,6) confidence, round(lo,6) lower_bound, round(hi,6) upper_bound, round(sd,6) std_dev, round(q25+1e-9,6) q25, round(q75+1e-9,6) q75, n AS n_methods FROM en""")
def ensemble_forecast(t):
    e = ensemble(t)
    return rounded(rounded(e, ["kwh", "lower_bound", "upper_bound", "std_dev", "confidence"], 6), [], 6).withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("q25", "q75")})


@query("h44_ensemble_confidence", SIM_NEEDS, "WITH " + ENS_SQL + """, pk2 AS (SELECT user_id, arg_max(month, round(k,6)*1e7-month) pmo, avg(c) oc FROM en GROUP BY 1)
 SELECT user_id, month, round(oc*(1-0.1e0*abs(month-pmo)/6),6) AS month_confidence FROM en JOIN pk2 USING (user_id)""")
def ensemble_conf(t):
    return EN.month_confidence(ensemble(t)).select("user_id", "month", r("month_confidence", 6).alias("month_confidence"))


@query("d56_ensemble_statistics", SIM_NEEDS, "WITH " + ENS_SQL + """ SELECT user_id, round(sum(k),3) annual_total, round(avg(k),4) annual_average, arg_max(month, round(k,6)*1e7-month) peak_month, arg_min(month, round(k,6)*1e7+month) low_month, round(stddev_pop(k),4) monthly_variability,
 round(stddev_pop(k)/avg(k),6) seasonality_index, CASE WHEN (max(k) FILTER (month=12) - max(k) FILTER (month=1))/11>5 THEN 'increasing' WHEN (max(k) FILTER (month=12) - max(k) FILTER (month=1))/11<-5 THEN 'decreasing' ELSE 'stable' END trend FROM en GROUP BY 1""")
def ensemble_stats(t):
    s = rounded(EN.ensemble_statistics(ensemble(t)), ["annual_average", "monthly_variability"])
    return s.withColumns({"annual_total": r("annual_total", 3), "seasonality_index": r("seasonality_index", 6)})


@query("h43_adaptive_weights", ["forecasts"], """WITH RECURSIVE h AS (SELECT account_id, (YEAR*12+MONTH)*2+m run, m, CASE WHEN m=1 THEN abs(y_true-y_pred) ELSE abs(y_true-y_pred2) END/y_true*100 mape FROM forecasts CROSS JOIN (SELECT unnest([0,1]) m) WHERE y_true>0),
r3 AS (SELECT account_id, run, m, avg(mape) OVER w e, count(*) OVER w n FROM h WINDOW w AS (PARTITION BY account_id, m ORDER BY run ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
ev AS (SELECT account_id, m, CASE WHEN e>0 THEN 1/e ELSE 1e0 END b, row_number() OVER (PARTITION BY account_id ORDER BY run) k FROM r3 WHERE n>=3),
wt AS (SELECT DISTINCT account_id, CAST(0 AS BIGINT) k, 0.5e0 p, 0.5e0 l FROM ev UNION ALL
 SELECT w.account_id, ev.k, CASE WHEN m=1 THEN b/(b+l) ELSE p*(1-b/(b+p))/p END p, CASE WHEN m=1 THEN l*(1-b/(b+l))/l ELSE b/(b+p) END l FROM wt w JOIN ev ON ev.account_id=w.account_id AND ev.k=w.k+1),
z AS (SELECT account_id, arg_max(p,k) p, arg_max(l,k) l FROM wt GROUP BY 1)
SELECT account_id, m AS method, round(CASE WHEN m='pattern' THEN p ELSE l END,6) weight FROM z CROSS JOIN (SELECT unnest(['lstm','pattern']) m)""")
def adaptive(t):
    """Errors of two methods, month by month, the first method's before the second's."""
    f, run = t("forecasts").where("y_true > 0"), (F.col("YEAR") * 12 + F.col("MONTH")) * 2
    mape = lambda y: F.abs(F.col("y_true") - F.col(y)) / F.col("y_true") * 100
    h = f.select("account_id", F.inline(F.array(F.struct(run.alias("run"), F.lit("lstm").alias("method"), mape("y_pred2").alias("mape")),
                                                F.struct((run + 1).alias("run"), F.lit("pattern").alias("method"), mape("y_pred").alias("mape")))))
    return rounded(EN.adapt_weights(h, C.ENSEMBLE_WEIGHTS, "account_id"), ["weight"], 6)


@query("d21_historical_features", SIM_NEEDS, "WITH " + SIM_SQL + """ SELECT user_id, um.m AS month, round(avg(net),4) hist_mean, round(quantile_cont(net,0.5),4) hist_median, round(stddev_pop(net),4) hist_std, round(min(net),4) hist_min, round(max(net),4) hist_max
 FROM sim JOIN um USING (user_id) JOIN pm ON pm.account_id=sim.account_id AND pm.MONTH=um.m WHERE rank<=5 GROUP BY 1,2""")
def historical(t):
    h = PA.historical_features(similar_once(t), requests(t))
    return rounded(h, ["hist_mean", "hist_median", "hist_std", "hist_min", "hist_max"])


@query("d22_user_statistics", ["users"], """WITH um AS (SELECT user_id, 9e0 AS m, kwh_m09 AS k FROM users UNION ALL SELECT user_id, 10, kwh_m10 FROM users UNION ALL SELECT user_id, 11, kwh_m11 FROM users)
SELECT user_id, round(avg(k),4) user_mean, quantile_cont(k,0.5) user_median, round(stddev_pop(k),4) user_std, min(k) user_min, max(k) user_max, round(stddev_pop(k)/avg(k),6) user_cv, round(regr_slope(k,m),4) user_trend_slope,
 round(CASE WHEN max(k)>min(k) THEN regr_r2(k,m) END,6) user_trend_r2 FROM um GROUP BY 1""")
def user_stats(t):
    s = rounded(PA.user_statistics(requests(t)), ["user_mean", "user_std", "user_trend_slope"])
    return rounded(s, ["user_cv", "user_trend_r2"], 6)


@query("f5_month_ranking", SIM_NEEDS, "WITH " + FC_SQL + """ SELECT user_id, month, row_number() OVER (PARTITION BY user_id ORDER BY round(kwh,9) DESC, month) AS rank, CASE WHEN month IN (2,3,4,12) THEN 'peak' WHEN month IN (6,7,8) THEN 'low' ELSE 'normal' END AS band,
 round(round(kwh,4)*77,1) AS value_lkr FROM fc""")
def month_ranking(t):
    from gridlight.functions.calendar import season_band
    f = PA.pattern_forecast(PA.user_patterns(requests(t), similar_once(t)))
    ranked = top_k(f, ["user_id"], [F.round("kwh", 9).desc(), F.col("month")], 12)
    return ranked.select("user_id", "month", "rank", season_band(F.col("month")).alias("band"), r(r("kwh") * 77, 1).alias("value_lkr"))


SERVE_SQL = SIM_SQL + """, t5 AS (SELECT user_id, account_id, rank FROM sim WHERE rank<=5), hm2 AS (SELECT user_id, pm.MONTH AS month, quantile_cont(net,0.5) med, avg(net) mean, arg_min(net, rank) fst FROM t5 JOIN pm USING (account_id) GROUP BY 1,2),
ua AS (SELECT user_id, avg(k) ua FROM um GROUP BY 1), g AS (SELECT DISTINCT t5.user_id, mm.month, mm.f FROM t5 CROSS JOIN (SELECT CAST(unnest(range(1,13)) AS INT) AS month, unnest([0.85e0,0.90,1.15,1.25,1.20,1.00,0.85,0.90,1.00,1.10,1.05,0.95]) f) mm),
b AS (SELECT g.user_id, g.month, coalesce(um.k, CASE WHEN mean>0 THEN med*(ua/mean) ELSE med END, 400*f) c, coalesce(um.k, med) base, coalesce(um.k, fst) roll FROM g LEFT JOIN um ON um.user_id=g.user_id AND um.m=g.month LEFT JOIN hm2 ON hm2.user_id=g.user_id AND hm2.month=g.month JOIN ua ON ua.user_id=g.user_id),
l AS (SELECT user_id, month, c, """ + ", ".join(f"coalesce(lag(base,{n}) OVER (PARTITION BY user_id ORDER BY month), c*0.9e0) AS lag_{n}" for n in (1, 2, 3, 6, 12)) + ", " + ", ".join(
    f"coalesce(avg(roll) OVER w{n}, c) AS rolling_mean_{n}, CASE WHEN count(roll) OVER w{n}>1 THEN stddev_pop(roll) OVER w{n} WHEN count(roll) OVER w{n}=1 THEN c*0.1e0 ELSE c END AS rolling_std_{n}, coalesce(min(roll) OVER w{n}, c) AS rolling_min_{n}, coalesce(max(roll) OVER w{n}, c) AS rolling_max_{n}" for n in (3, 6, 12)) + \
    " FROM b WINDOW " + ", ".join(f"w{n} AS (PARTITION BY user_id ORDER BY month ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in (3, 6, 12)) + ")"


@query("e13_serving_frame", SIM_NEEDS, "WITH " + SERVE_SQL + " SELECT user_id, month, round(c,6) consumption, " + ", ".join(f"round(lag_{n},6) lag_{n}" for n in (1, 2, 3, 6, 12)) + ", " + ", ".join(
    f"round(rolling_{s}_{n},6) rolling_{s}_{n}" for n in (3, 6, 12) for s in ("mean", "std", "min", "max")) + """, CAST(month IN (5,6,7,8,9) AS INT) is_wet_season, round(c-lag_1,6) diff_1, round((c-lag_12)/lag_12*100,6) pct_change_12,
 round(c/((lag_1+lag_2+lag_3)/3),6) consumption_vs_avg, round(c/rolling_mean_6,6) consumption_vs_rolling_6 FROM l""")
def serving(t):
    s = PA.serving_frame(requests(t), similar_once(t))
    four = ["consumption", *[f"lag_{n}" for n in (1, 2, 3, 6, 12)], *[f"rolling_{k}_{n}" for n in (3, 6, 12) for k in ("mean", "std", "min", "max")], "diff_1", "pct_change_12"]
    six = ["consumption_vs_avg", "consumption_vs_rolling_6"]
    return rounded(s, four + six, 6).select("user_id", "month", "is_wet_season", *four, *six)
