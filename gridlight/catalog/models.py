"""Models on the readings and transformers."""

from __future__ import annotations

from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from gridlight import constants as C
from gridlight.catalog.base import query
from gridlight.catalog.solar_and_finance import NEEDS, SF, solar_frame
from gridlight.catalog.tables_and_bills import ROLLUP_SQL, r, rounded
from gridlight.operators import metrics as ME, ml, rollup as RU, series as SE, splits as SP
from gridlight.session import cut_lineage

SCALED = ["Solar_Irradiance_GHI", "Temperature", "Cloud_Factor"]


def model_rows(t):
    f = solar_frame(t).dropna(subset=["Solar_Irradiance_GHI", "Efficiency"]).withColumnRenamed("MONTH", "Month")
    return SP.group_split(f)


@query("i1_standard_scaling", NEEDS, f"WITH {SF}, k AS (SELECT *, substr(md5(concat_ws('|', account_id, 42)), 1, 8) < '33333333' te FROM sf WHERE Solar_Irradiance_GHI IS NOT NULL AND Efficiency IS NOT NULL), s AS (SELECT " + ", ".join(
    f"avg({c}) m{i}, stddev_pop({c}) s{i}" for i, c in enumerate(SCALED)) + " FROM k WHERE NOT te) SELECT account_id, YEAR, MONTH AS \"Month\", " + ", ".join(f"round(({c}-m{i})/s{i},6) AS \"{c}\"" for i, c in enumerate(SCALED)) + " FROM k, s")
def scaling(t):
    f = model_rows(t)
    return rounded(ml.standardise(f.where("split = 'train'"), f, SCALED), SCALED, 6).select("account_id", "YEAR", "Month", *SCALED)


def scaled_sql(stats: str, value: str) -> str:
    """The scaling of the training rows' statistics (``{c}`` a column, ``{i}`` its number) over all rows."""
    of = lambda text: ", ".join(text.format(c=c, i=i) for i, c in enumerate(SCALED))
    return f"WITH {SF}, k AS (SELECT *, substr(md5(concat_ws('|', account_id, 42)), 1, 8) < '33333333' te FROM sf WHERE Solar_Irradiance_GHI IS NOT NULL AND Efficiency IS NOT NULL), s AS (SELECT {of(stats)} FROM k WHERE NOT te) SELECT account_id, YEAR, MONTH AS \"Month\", {of(value)} FROM k, s"


@query("i1_min_max_scaling", NEEDS, scaled_sql("min({c}) l{i}, max({c}) h{i}", 'round(({c}-l{i})/CASE WHEN h{i}>l{i} THEN h{i}-l{i} ELSE 1 END,6) AS "{c}"'))
def min_max_scaling(t):
    f = model_rows(t)
    return rounded(ml.min_max_scale(f.where("split = 'train'"), f, SCALED), SCALED, 6).select("account_id", "YEAR", "Month", *SCALED)


@query("i1_robust_scaling", NEEDS, scaled_sql("quantile_cont({c},0.25) a{i}, quantile_cont({c},0.5) m{i}, quantile_cont({c},0.75) b{i}", 'round(({c}-m{i})/CASE WHEN b{i}>a{i} THEN b{i}-a{i} ELSE 1 END,6) AS "{c}"'))
def robust_scaling(t):
    f = model_rows(t)
    return rounded(ml.robust_scale(f.where("split = 'train'"), f, SCALED), SCALED, 6).select("account_id", "YEAR", "Month", *SCALED)


@query("i1_mllib_scalers", NEEDS)
def mllib_scalers(t):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    f = model_rows(t)
    out = f.select("account_id", "YEAR", "Month", *SCALED)
    for kind in ("robust", "minmax"):
        model = Pipeline(stages=ml.scaling_stages(SCALED, kind)).fit(f.where("split = 'train'"))
        out = model.transform(out).withColumn(kind, vector_to_array("features")).drop("raw", "features")
    return out


def fitted(t):
    f = cut_lineage(model_rows(t).select("account_id", "YEAR", "split", "Efficiency", *C.SOLAR_MODEL_FEATURES))
    return f.where("split = 'train'"), f.where("split = 'test'")


@query("i4_i6_i7_model_table", NEEDS)
def model_table(t):
    train, test = fitted(t)
    models = ml.fit_models(train, C.SOLAR_MODEL_FEATURES, ml.regressors("Efficiency"))
    rows = ml.evaluate_models(models, test, "Efficiency")
    physics = ME.forecast_metrics(test, y="Efficiency", p="Physics_Pred").select(F.lit("Physics").alias("model"), "mae", "rmse", "r2", "mape")
    return ml.comparison_table(rows.unionByName(ml.overfit_verdict(physics.withColumn("cv_mae", F.lit(None).cast("double")))))


@query("i3_grid_search", NEEDS)
def grid_search(t):
    train, test = fitted(t)
    found = ml.grid_search(train, C.SOLAR_MODEL_FEATURES, "Efficiency", ml.regressors("Efficiency"))
    return ml.evaluate_models({k: m for k, (m, _) in found.items()}, test, "Efficiency", {k: e for k, (_, e) in found.items()})


@query("i8_feature_selection", NEEDS, f"WITH {SF} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(CASE WHEN stddev_pop({e})>0 THEN corr({e}, Efficiency) END,6) AS correlation, coalesce(abs(corr({e}, Efficiency))>=0.05,false) AS selected FROM sf WHERE {e} IS NOT NULL AND Efficiency IS NOT NULL"
    for c, e in (("Solar_Irradiance_GHI", "Solar_Irradiance_GHI"), ("Temperature", "Temperature"), ("Humidity", "Humidity"), ("INV_CAPACITY", "INV_CAPACITY"), ("MONTH", "MONTH"))))
def feature_selection(t):
    s = ml.select_features(solar_frame(t), ["Solar_Irradiance_GHI", "Temperature", "Humidity", "INV_CAPACITY", "MONTH"], "Efficiency", threshold=0.05)
    return s.withColumn("correlation", r("correlation", 6))


@query("i9_mutual_information", ["readings"], "WITH b AS (SELECT min(NET_CONSUMPTION_kWh) l, max(NET_CONSUMPTION_kWh) h, min(INV_CAPACITY) cl, max(INV_CAPACITY) ch FROM readings), x AS (SELECT unnest(['MONTH','INV_CAPACITY']) feature, unnest([least(floor((MONTH-1)*10/11e0),9), least(floor((INV_CAPACITY-cl)*10/(ch-cl)),9)]) x, least(floor((NET_CONSUMPTION_kWh-l)*10/(h-l)),9) y FROM readings, b), c AS (SELECT feature, x, y, count(*) n FROM x GROUP BY 1,2,3), w AS (SELECT *, sum(n) OVER (PARTITION BY feature, x) nx, sum(n) OVER (PARTITION BY feature, y) ny, sum(n) OVER (PARTITION BY feature) t FROM c) SELECT feature, round(sum(n/t*ln(n*t/(nx*ny))),6) mutual_information FROM w GROUP BY 1")
def mutual_information(t):
    return rounded(ml.mutual_information(t("readings"), ["MONTH", "INV_CAPACITY"], "NET_CONSUMPTION_kWh"), ["mutual_information"], 6)


@query("i9_forest_importances", NEEDS)
def importances(t):
    train, _ = fitted(t)
    models = ml.fit_models(train, C.SOLAR_MODEL_FEATURES, {"RandomForest": ml.regressors("Efficiency")["RandomForest"]})
    return ml.importances(t.spark, models["RandomForest"], C.SOLAR_MODEL_FEATURES)


def transformer_frame(t):
    return cut_lineage(RU.transformer_features(RU.transformer_rollup(t("readings"))))


@query("i10_suitability_classifier", ["readings"])
def classifier(t):
    labelled = ml.suitability_labels(transformer_frame(t))
    return ml.suitability_scores(ml.fit_suitability(labelled), labelled).select("TRANSFORMER_CODE", "label", "ml_score")


@query("i11_suitability_label", ["readings"], "WITH " + ROLLUP_SQL + ", q AS (SELECT quantile_cont(utilization_rate,0.5) q FROM tf) SELECT TRANSFORMER_CODE, CAST(utilization_rate<q AS DOUBLE) AS label FROM tf, q")
def label(t):
    return ml.suitability_labels(RU.transformer_features(RU.transformer_rollup(t("readings")))).select("TRANSFORMER_CODE", "label")


@query("i12_risk_tiers", ["readings"])
def tiers(t):
    return ml.risk_tiers(transformer_frame(t)).select("TRANSFORMER_CODE", "cluster", "risk_tier", "utilization_rate")


@query("i13_load_trend", ["readings"], "WITH m AS (SELECT TRANSFORMER_CODE, YEAR*12+MONTH t, avg(NET_CONSUMPTION_kWh)/720 l FROM readings GROUP BY 1,2), f AS (SELECT TRANSFORMER_CODE, regr_slope(l,t) s, regr_intercept(l,t) b, arg_max(l,t) c, max(t) mt FROM m GROUP BY 1) SELECT TRANSFORMER_CODE, round(c,6) \"current_load_kW\", round(s,8) slope, round(greatest(b+s*(mt+12), c*0.9e0),6) \"future_load_kW\" FROM f")
def load_trend(t):
    f = ml.load_trend(t("readings"))
    return f.select("TRANSFORMER_CODE", r("current_load_kW", 6).alias("current_load_kW"), r("slope", 8).alias("slope"), r("future_load_kW", 6).alias("future_load_kW"))


@query("i14_compare_classifiers", ["readings"])
def compare(t):
    return ml.compare_classifiers(ml.suitability_labels(transformer_frame(t)))


@query("i15_sequence_forecast", ["readings"])
def sequence_forecast(t):
    frame = cut_lineage(SP.group_split(ml.horizon_frame(t("readings"), 6, 6)))
    models = ml.fit_horizons(frame.where("split = 'train'"), 6, [1, 2, 3, 4, 5, 6])
    return ME.forecast_metrics(ml.predict_horizons(models, frame.where("split = 'test'")), ["step"])


@query("i17_walk_forward_validation", ["readings"])
def walk_forward(t):
    f = SE.lag_features(t("readings"), lags=[1, 2, 3]).dropna(subset=["lag_1", "lag_2", "lag_3"]).select("account_id", "YEAR", "MONTH", "NET_CONSUMPTION_kWh", "lag_1", "lag_2", "lag_3")
    n_folds = (SP.n_months(f) - 1) // 12    # every month of the history is in a fold
    folds = cut_lineage(SP.walk_forward(f, n_folds, 12))
    return ml.walk_forward_validation(folds, ["lag_1", "lag_2", "lag_3", "MONTH"], "NET_CONSUMPTION_kWh", n_folds, LinearRegression(featuresCol="features", labelCol="NET_CONSUMPTION_kWh"))


UNIFORM = "CAST('0x' || md5(concat_ws('|', account_id, YEAR, MONTH, d))[1:13] AS BIGINT) / 4503599627370496e0"
STEPS = ml.poisson_steps()
WEIGHT = "CASE " + " ".join(f"WHEN u < {b!r} THEN {k}e0" for k, b in enumerate(STEPS)) + f" ELSE {len(STEPS)}e0 END"


@query("i18_bootstrap_interval", ["forecasts"], f"WITH q AS (SELECT MONTH, d, abs(y_true-y_pred) e, {UNIFORM} u FROM forecasts CROSS JOIN (SELECT unnest(range(0,100)) d)), x AS (SELECT MONTH, d, sum({WEIGHT}*e)/sum({WEIGHT}) m FROM q GROUP BY 1,2), a AS (SELECT MONTH, avg(abs(y_true-y_pred)) mae FROM forecasts GROUP BY 1) SELECT MONTH, round(any_value(mae),6) mae, round(quantile_cont(m,0.025),6) low, round(quantile_cont(m,0.5),6) median, round(quantile_cont(m,0.975),6) high FROM x JOIN a USING (MONTH) GROUP BY 1")
def bootstrap(t):
    return rounded(ml.bootstrap_interval(t("forecasts"), ["MONTH"]), ["mae", "low", "median", "high"], 6)


INTERVALS = f"""WITH p AS (SELECT MONTH, y_true-y_pred v, row_number() OVER (PARTITION BY MONTH ORDER BY y_true-y_pred) - 1 k FROM forecasts), n AS (SELECT MONTH, count(*) n FROM forecasts GROUP BY 1),
dr AS (SELECT account_id, YEAR, MONTH, CAST(floor({UNIFORM}*n) AS BIGINT) k FROM forecasts JOIN n USING (MONTH) CROSS JOIN (SELECT unnest(range(0,100)) d)),
ci AS (SELECT account_id, YEAR, dr.MONTH, quantile_cont(v,0.025) lo, quantile_cont(v,0.975) hi FROM dr JOIN p ON p.MONTH=dr.MONTH AND p.k=dr.k GROUP BY 1,2,3),
pi AS (SELECT f.*, y_pred+lo low, y_pred+hi high FROM forecasts f JOIN ci USING (account_id, YEAR, MONTH))"""


def intervals(t):
    return ml.prediction_intervals(t("forecasts"), ["MONTH"], ["account_id", "YEAR", "MONTH"])


@query("i18_prediction_intervals", ["forecasts"], INTERVALS + " SELECT account_id, YEAR, MONTH, round(y_pred,4) y_pred, round(low,4) low, round(high,4) high FROM pi")
def prediction_intervals(t):
    return rounded(intervals(t), ["y_pred", "low", "high"]).select("account_id", "YEAR", "MONTH", "y_pred", "low", "high")


@query("i18_interval_coverage", ["forecasts"], INTERVALS + " SELECT MONTH, count(*) n, round(avg(CASE WHEN y_true BETWEEN low AND high THEN 1e0 ELSE 0e0 END),6) coverage, round(avg(high-low),4) mean_width FROM pi GROUP BY 1")
def interval_coverage(t):
    held = intervals(t).groupBy("MONTH").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("y_true").between(F.col("low"), F.col("high")).cast("double")).alias("coverage"), F.avg(F.col("high") - F.col("low")).alias("mean_width"))
    return held.select("MONTH", "n", r("coverage", 6).alias("coverage"), r("mean_width").alias("mean_width"))


@query("i20_loss_confidence", ["forecasts"], "SELECT account_id, round(greatest(0.3e0,least(0.95e0,1-avg(abs(y_true-y_pred))*20/1000)),6) confidence FROM forecasts GROUP BY 1")
def confidence(t):
    loss = t("forecasts").groupBy("account_id").agg((F.avg(F.abs(F.col("y_true") - F.col("y_pred"))) * 20).alias("loss"))
    return loss.select("account_id", r(ml.loss_confidence(F.col("loss")), 6).alias("confidence"))
