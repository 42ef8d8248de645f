"""Models as MLlib pipelines over tables: scaling, selection, training, evaluation."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import groupby

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import MinMaxScaler, RobustScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridlight import constants as C
from gridlight.functions import numeric as N
from gridlight.operators.metrics import forecast_metrics, target_correlations
from gridlight.operators.ordered import exact_quantiles, histogram, running_totals, same
from gridlight.operators.series import sequences
from gridlight.operators.splits import group_bucket
from gridlight.session import cut_lineage

SUITABILITY_FEATURES = ["current_load_kW", "total_solar_capacity", "utilization_rate", "solar_penetration", "demand_volatility", "available_headroom", "export_ratio"]
SCALERS = {"standard": lambda: StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
           "robust": lambda: RobustScaler(inputCol="raw", outputCol="features", withCentering=True),
           "minmax": lambda: MinMaxScaler(inputCol="raw", outputCol="features")}


def scaling_stages(cols: list[str], kind: str = "standard") -> list:
    return [VectorAssembler(inputCols=cols, outputCol="raw", handleInvalid="skip"), SCALERS[kind]()]


def standardise(train: DataFrame, df: DataFrame, cols: list[str]) -> DataFrame:
    """Zero mean and unit population deviation, fitted on ``train`` alone; constant columns become 0."""
    stats = train.agg(F.struct(*[x for c in cols for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])).scalar()
    out = df.withColumn("_s", stats)
    return out.withColumns({c: (F.col(c) - F.col(f"_s.m_{c}")) / F.when(F.col(f"_s.s_{c}") > 0, F.col(f"_s.s_{c}")).otherwise(1.0) for c in cols}).drop("_s")


def min_max_scale(train: DataFrame, df: DataFrame, cols: list[str]) -> DataFrame:
    """0 at the least and 1 at the largest value of ``train``; constant columns become 0."""
    stats = train.agg(F.struct(*[x for c in cols for x in (F.min(c).alias(f"l_{c}"), F.max(c).alias(f"h_{c}"))])).scalar()
    span = lambda c: F.col(f"_s.h_{c}") - F.col(f"_s.l_{c}")
    return df.withColumn("_s", stats).withColumns({c: (F.col(c) - F.col(f"_s.l_{c}")) / F.when(span(c) > 0, span(c)).otherwise(1.0) for c in cols}).drop("_s")


def robust_scale(train: DataFrame, df: DataFrame, cols: list[str]) -> DataFrame:
    """Median 0 and distance of the quartiles 1, exact and fitted on ``train`` alone, all columns in the same two passes; where the
    quartiles are equal the distance counts as 1."""
    long = train.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in cols])))
    q = exact_quantiles(long, ["name"], "x", {"q1": 0.25, "m": 0.5, "q3": 0.75})
    stats = q.agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("m", (F.col("q3") - F.col("q1")).alias("iqr"))))).alias("s")).scalar()    # one entry a column
    of = lambda c, part: F.try_element_at(F.col("_s"), F.lit(c))[part]
    return df.withColumn("_s", stats).withColumns({c: (F.col(c) - of(c, "m")) / F.when(of(c, "iqr") > 0, of(c, "iqr")).otherwise(1.0) for c in cols}).drop("_s")


# ---- regression ---------------------------------------------------------------------

def regressors(label: str, trees: int = 100, seed: int = 42) -> dict:
    """Model families, untuned."""
    common = {"featuresCol": "features", "labelCol": label}
    return {"Ridge": LinearRegression(regParam=1.0, elasticNetParam=0.0, **common), "Lasso": LinearRegression(regParam=0.1, elasticNetParam=1.0, **common),
            "RandomForest": RandomForestRegressor(numTrees=trees, maxDepth=8, seed=seed, **common),
            "GradientBoosting": GBTRegressor(maxIter=max(10, trees // 2), maxDepth=4, stepSize=0.1, seed=seed, **common)}


def grids(models: dict) -> dict:
    """Search space per family.

    Depth 30 is MLlib's largest and stands for trees without a limit.  MLlib has no least size of a node that is split; at
    least 3 rows in either child keep nodes of fewer than 5 rows whole, as the wider of the two sizes (2 and 5) does.
    """
    build = lambda m, space: reduce(lambda g, kv: g.addGrid(m.getParam(kv[0]), kv[1]), space.items(), ParamGridBuilder()).build()
    space = {"Ridge": {"regParam": [0.1, 1.0, 10.0]}, "Lasso": {"regParam": [0.001, 0.01, 0.1]},
             "RandomForest": {"numTrees": [100, 200], "maxDepth": [10, 20, 30], "minInstancesPerNode": [1, 3]},
             "GradientBoosting": {"maxIter": [100, 200], "stepSize": [0.05, 0.1], "maxDepth": [4, 6, 8]}}
    return {name: build(m, space[name]) for name, m in models.items() if name in space}


def fit_models(train: DataFrame, features: list[str], models: dict) -> dict[str, PipelineModel]:
    return {name: Pipeline(stages=[*scaling_stages(features), m]).fit(train) for name, m in models.items()}


def staged(grid: list[dict]) -> list[tuple[dict, list[int]]]:
    """The settings to fit and, for boosting, the numbers of rounds at which each is scored: the rounds of a shorter run are
    the first ones of a longer run, so settings that differ in nothing else are one fit."""
    runs: dict[frozenset, dict] = {}
    for setting in grid:
        rounds = next((v for p, v in setting.items() if p.name == "maxIter"), None)
        rest = frozenset((p, v) for p, v in setting.items() if p.name != "maxIter")
        runs.setdefault(rest, {})[rounds] = setting
    return [(by_rounds[max(by_rounds, key=lambda r: r or 0)], sorted(r for r in by_rounds if r)) for by_rounds in runs.values()]


def with_node_ids(model):
    """A forest that keeps the node of every row from pass to pass.  Otherwise each pass sends all trees grown so far to the
    tasks, which for deep ones takes most of the time.  The trees are the same; boosting, with one small tree a round, stays."""
    return model.copy({model.cacheNodeIds: True}) if isinstance(model, RandomForestRegressor) else model


def grid_search(train: DataFrame, features: list[str], label: str, models: dict, folds: int = 5, group: str = "account_id", parallelism: int = 8,
                spaces: dict | None = None) -> dict[str, tuple[PipelineModel, float]]:
    """Best model and its mean CV error per family; folds hold whole groups.

    Each fold is scaled once for all settings, and boosting is scored round by round from one fit (``staged``).  The driver
    only starts fits, ``parallelism`` at a time; the best setting of a family is fitted beside the last folds of the others."""
    data = train.withColumn("_fold", group_bucket(group, folds, seed=7).cast("int"))
    spaces = spaces or grids(models)
    models = {name: with_node_ids(models[name]) for name in spaces}
    evaluator = RegressionEvaluator(labelCol=label, metricName="mae")
    scaled = []
    for k in range(folds):
        scaling = Pipeline(stages=scaling_stages(features)).fit(data.where(F.col("_fold") != k))
        part = lambda rows: cut_lineage(scaling.transform(rows).select("features", label))  # noqa: E731, B023
        scaled.append((part(data.where(F.col("_fold") != k)), part(data.where(F.col("_fold") == k))))

    def errors(name: str, k: int, setting: dict, rounds: list[int]) -> list[tuple]:
        fit_rows, test_rows = scaled[k]
        model = models[name].copy(setting).fit(fit_rows)
        plain = [(p.name, v) for p, v in setting.items()]
        if not rounds:
            return [(tuple(sorted(plain)), evaluator.evaluate(model.transform(test_rows)))]
        by_round = model.evaluateEachIteration(test_rows, "absolute")
        return [(tuple(sorted((n, r if n == "maxIter" else v) for n, v in plain)), by_round[r - 1]) for r in rounds]

    def best(name: str, scores: dict[tuple, list[float]]) -> tuple[PipelineModel, float]:
        mean = lambda setting: sum(e := scores[tuple(sorted((p.name, v) for p, v in setting.items()))]) / len(e)
        setting = min(spaces[name], key=mean)
        return Pipeline(stages=[*scaling_stages(features), models[name].copy(setting)]).fit(train), mean(setting)

    jobs = [(name, k, setting, rounds) for name, grid in spaces.items() for setting, rounds in staged(grid) for k in range(folds)]
    with ThreadPoolExecutor(parallelism) as pool:
        out = {}
        for name, found in groupby(zip(jobs, pool.map(lambda job: errors(*job), jobs)), lambda r: r[0][0]):
            scores: dict[tuple, list[float]] = {}
            for setting, error in (pair for _, pairs in found for pair in pairs):
                scores.setdefault(setting, []).append(error)
            out[name] = pool.submit(best, name, scores)
        return {name: out[name].result() for name in spaces}


def evaluate_models(models: dict[str, PipelineModel], test: DataFrame, label: str, cv_mae: dict[str, float] | None = None) -> DataFrame:
    """Metric row per model with its gap to the CV error and the verdict."""
    rows = []
    for name, model in models.items():
        m = forecast_metrics(model.transform(test), y=label, p="prediction").select(F.lit(name).alias("model"), "mae", "rmse", "r2", "mape")
        cv = (cv_mae or {}).get(name)
        rows.append(m.withColumn("cv_mae", F.lit(cv).cast("double")))
    return overfit_verdict(reduce(lambda a, b: a.unionByName(b), rows))


def overfit_verdict(metrics: DataFrame, overfit: float = 15.0, leak: float = -5.0) -> DataFrame:
    gap = F.col("mae") - F.col("cv_mae")
    return metrics.withColumns({"gap": gap, "verdict": F.when(gap.isNull(), "—").when(gap > overfit, "OVERFIT").when(gap < leak, "CV leak?").otherwise("stable")})


def comparison_table(metrics: DataFrame) -> DataFrame:
    """Models by error with the improvement over the worst and the distance to the best (a handful of rows)."""
    w = Window.partitionBy(F.lit(0))
    best, worst = F.min("mae").over(w), F.max("mae").over(w)
    return metrics.withColumns({"is_best": F.col("mae") == best, "improvement_pct": F.try_divide(worst - F.col("mae"), worst) * 100})


def best_model(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.min_by("model", F.struct("mae", "model")).alias("model"), F.min("mae").alias("mae"))


# ---- selection ------------------------------------------------------------------------

def select_features(df: DataFrame, candidates: list[str], target: str, threshold: float = 0.0, keep: list[str] | None = None) -> DataFrame:
    """Correlation of every candidate with the target and whether it stays (kept ones always do)."""
    corr = target_correlations(df, candidates, target)
    stays = F.coalesce(F.abs(F.col("correlation")) >= threshold, F.lit(False)) | F.col("feature").isin(keep or [])
    return corr.withColumn("selected", stays)


def mutual_information(df: DataFrame, features: list[str], target: str, bins: int = 10) -> DataFrame:
    """Mutual information of binned feature and target; counts per cell are all that is shuffled."""
    bounds = df.agg(F.struct(*[x for c in [*features, target] for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))])).scalar()
    d = df.select(*features, target).dropna().withColumn("b", bounds)
    cell = lambda c: F.least(F.floor(F.coalesce(F.try_divide((F.col(c) - F.col(f"b.lo_{c}")) * bins, F.nullif(F.col(f"b.hi_{c}") - F.col(f"b.lo_{c}"), F.lit(0.0))), F.lit(0.0))), F.lit(bins - 1)).cast("int")
    rows = d.select(cell(target).alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), cell(c).alias("x")) for c in features])).alias("e")).select("y", "e.feature", "e.x")
    cells = rows.groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    over = lambda *k: F.sum("n").over(Window.partitionBy("feature", *k))
    p = cells.withColumns({"nx": over("x"), "ny": over("y"), "t": over()})
    return p.groupBy("feature").agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))).alias("mutual_information"))


def importances(spark, model: PipelineModel, features: list[str]) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, importance double")


# ---- transformers -----------------------------------------------------------------------

def suitability_labels(features: DataFrame) -> DataFrame:
    """1 where the utilisation is below the median of all transformers."""
    med = exact_quantiles(features, [], "utilization_rate", {"m": 0.5}).select("m").scalar()
    return features.withColumn("label", (F.col("utilization_rate") < med).cast("double"))


def fit_suitability(labelled: DataFrame, trees: int = 150, depth: int = 8, seed: int = 42) -> PipelineModel:
    rf = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[*scaling_stages(SUITABILITY_FEATURES), rf]).fit(labelled)


def suitability_scores(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Score 0..100; 50 for everyone if the classifier knows a single class."""
    p = vector_to_array("probability")
    return model.transform(features).withColumn("ml_score", F.when(F.size(p) > 1, F.get(p, 1) * 100).otherwise(50.0)).drop("raw", "features", "rawPrediction", "probability", "prediction")


def risk_tiers(features: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """K-means tiers numbered by rising utilisation."""
    model = Pipeline(stages=[*scaling_stages(SUITABILITY_FEATURES), KMeans(k=k, seed=seed, featuresCol="features", predictionCol="_cluster")]).fit(features)
    raw = model.transform(features).drop("raw", "features")
    means = raw.groupBy("_cluster").agg(F.avg("utilization_rate").alias("_u"))                     # k rows
    order = means.withColumn("cluster", F.row_number().over(Window.orderBy("_u", "_cluster")) - 1).select("_cluster", "cluster")
    return raw.join(F.broadcast(order), "_cluster").drop("_cluster").withColumn("risk_tier", N.lookup(F.col("cluster"), dict(enumerate(C.RISK_TIERS[:k]))))


def load_trend(readings: DataFrame, months_ahead: int = 12, growth: float = 0.03) -> DataFrame:
    """Linear trend of each transformer's mean load, floored at 90 % of its current load; growth where no trend can be fitted."""
    t = F.col("YEAR") * 12 + F.col("MONTH")
    monthly = readings.groupBy("TRANSFORMER_CODE", t.alias("t")).agg((F.avg("NET_CONSUMPTION_kWh") / C.HOURS_PER_MONTH).alias("load"))
    fit = monthly.groupBy("TRANSFORMER_CODE").agg(F.regr_slope("load", "t").alias("slope"), F.regr_intercept("load", "t").alias("b"),
                                                  F.max_by("load", "t").alias("current_load_kW"), F.max("t").alias("last"))
    ahead = F.col("b") + F.col("slope") * (F.col("last") + months_ahead)
    future = F.when(F.col("slope").isNotNull(), F.greatest(ahead, F.col("current_load_kW") * 0.9)).otherwise(F.col("current_load_kW") * (1 + growth) ** (months_ahead / 12))
    return fit.select("TRANSFORMER_CODE", "current_load_kW", "slope", future.alias("future_load_kW"))


def compare_classifiers(labelled: DataFrame, folds: int = 5, trees: int = 150, rounds: int = 100, seed: int = 42) -> DataFrame:
    """Accuracy of three classifier families on the rows they were fitted on and cross-validated, in percent, with a verdict."""
    common = {"featuresCol": "features", "labelCol": "label"}
    families = {"RandomForest": RandomForestClassifier(numTrees=trees, maxDepth=8, seed=seed, **common), "LogisticRegression": LogisticRegression(**common),
                "GradientBoosting": GBTClassifier(maxIter=rounds, seed=seed, **common)}
    data = labelled.withColumn("_fold", group_bucket("TRANSFORMER_CODE", folds, seed=3).cast("int"))
    evaluator, rows = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy"), []
    for name, est in families.items():
        cv = CrossValidator(estimator=Pipeline(stages=[*scaling_stages(SUITABILITY_FEATURES), est]), estimatorParamMaps=ParamGridBuilder().build(), evaluator=evaluator, numFolds=folds, foldCol="_fold")
        fitted = cv.fit(data)
        rows.append((name, 100 * float(fitted.avgMetrics[0]), 100 * float(evaluator.evaluate(fitted.bestModel.transform(data)))))
    out = labelled.sparkSession.createDataFrame(rows, "model string, cv_accuracy double, fit_accuracy double")
    fit, cv = F.col("fit_accuracy"), F.col("cv_accuracy")
    return out.withColumn("verdict", F.when((fit >= 90) & (cv >= 70), "Excellent").when((fit >= 80) & (cv >= 60), "Good").when(fit >= 70, "Fair").otherwise("Poor"))


# ---- sequence forecast --------------------------------------------------------------------

def horizon_frame(readings: DataFrame, lookback: int, horizon: int, value: str = "NET_CONSUMPTION_kWh") -> DataFrame:
    """One row per window with the last ``lookback`` values as columns and the ``horizon`` targets as an array."""
    s = sequences(readings.withColumn("_v", F.col(value)), ["_v"], lookback, horizon, value)
    return s.select("account_id", "YEAR", "MONTH", "y", *[F.get("x", i)["_v"].alias(f"x{i}") for i in range(lookback)],
                    F.sin(F.col("MONTH") * 0.5235987755982988).alias("month_sin"), F.cos(F.col("MONTH") * 0.5235987755982988).alias("month_cos"))


def sample_weight(y: Column) -> Column:
    return F.when(y < 200, 3.0).when(y < 400, 2.0).otherwise(1.0)


def fit_horizons(frame: DataFrame, lookback: int, steps: list[int], trees: int = 20, seed: int = 42, parallelism: int = 3) -> dict[int, PipelineModel]:
    """A boosted model per forecast step, small consumers weighted up.  The driver only starts fits, ``parallelism`` at a time."""
    cols = [*[f"x{i}" for i in range(lookback)], "month_sin", "month_cos"]

    def fit(h: int) -> PipelineModel:
        data = frame.withColumn("label", F.get("y", h - 1)).withColumn("w", sample_weight(F.get("y", h - 1)))
        gbt = GBTRegressor(featuresCol="features", labelCol="label", weightCol="w", maxIter=trees, maxDepth=4, seed=seed)
        return Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="features"), gbt]).fit(data)

    with ThreadPoolExecutor(parallelism) as pool:
        return dict(zip(steps, pool.map(fit, steps)))


def predict_horizons(models: dict[int, PipelineModel], frame: DataFrame) -> DataFrame:
    """Predictions of all steps in long form: (account_id, YEAR, MONTH, step, y_true, y_pred)."""
    parts = [m.transform(frame).select("account_id", "YEAR", "MONTH", F.lit(h).alias("step"), F.get("y", h - 1).alias("y_true"), F.col("prediction").alias("y_pred")) for h, m in models.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def walk_forward_validation(folds: DataFrame, features: list[str], label: str, n_folds: int, estimator) -> DataFrame:
    """Fit per fold on its train rows, metrics on its test rows."""
    rows = []
    for k in range(1, n_folds + 1):
        part = folds.where(F.col("fold") == k)
        model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), estimator]).fit(part.where("role = 'train'"))
        rows.append(forecast_metrics(model.transform(part.where("role = 'test'")), y=label, p="prediction").select(F.lit(k).alias("fold"), "n", "mae", "rmse", "r2"))
    return reduce(lambda a, b: a.unionByName(b), rows)


def poisson_steps() -> list[float]:
    """P(X < 1), P(X < 2), ... of the Poisson distribution of mean 1, as far as a double can tell them from 1."""
    term = below = math.exp(-1.0)
    steps, k = [below], 0
    while below < 1.0 and term > 2.0 ** -54:
        k += 1
        term /= k
        below += term
        steps.append(below)
    return steps


def poisson_weight(u: Column) -> Column:
    """The inverse of the Poisson distribution of mean 1."""
    steps = poisson_steps()
    out = F.when(u < steps[0], 0.0)
    for k, below in enumerate(steps[1:], 1):
        out = out.when(u < below, float(k))
    return out.otherwise(float(len(steps)))


def bootstrap_interval(predictions: DataFrame, by: list[str], draws: int = 100, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Interval of each group's MAE by Poisson bootstrap.

    A row's weight in a draw comes from the MD5 of its key and the draw number (its first 52 bits over 2^52), so every row
    is used where it lies: weighted sums per draw are combined map-side and no resample is ever built.
    """
    drawn = predictions.withColumn("_err", F.abs(F.col(y) - F.col(p))).withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", "account_id", "YEAR", "MONTH", "_d").cast("binary")), 1, 13), 16, 10).cast("long")
    weighted = drawn.withColumn("_u", bits / F.lit(2.0 ** 52)).withColumn("_w", poisson_weight(F.col("_u")))
    sums = weighted.groupBy(*by, "_d").agg(F.avg("_err").alias("mae"), F.try_divide(F.sum(F.col("_w") * F.col("_err")), F.sum("_w")).alias("m"))
    q = F.percentile("m", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return sums.groupBy(*by).agg(F.max("mae").alias("mae"), q.alias("q")).select(*by, "mae", F.get("q", 0).alias("low"), F.get("q", 1).alias("median"), F.get("q", 2).alias("high"))


def prediction_intervals(predictions: DataFrame, by: list[str], keys: list[str], level: float = 0.95, draws: int = 100, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Adds ``low`` and ``high`` to every prediction, which ``keys`` identify, by residual bootstrap: ``draws`` residuals of its group, drawn with
    replacement by the MD5 of the row's ``keys`` and the draw, are added to it, and the interval lies between their quantiles.

    A quantile of the drawn residuals stands at an order statistic of the drawn ranks, so the ranks are drawn and sorted
    where the row lies, and only the four that decide are looked up among the ranked residuals of the group."""
    rows = predictions.withColumn("_res", F.col(y) - F.col(p))
    pool = running_totals(histogram(rows, by, "_res"), by, ["n"])
    ranked = pool.select(*by, F.explode(F.sequence(F.col("cum_n") - F.col("n"), F.col("cum_n") - 1)).alias("_rank"), F.col("v").alias("_value"))
    totals = rows.where(F.col("_res").isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    # drawn numbers are sorted as the hexadecimal digits they are; only those that decide become ranks
    digits = lambda key, d: F.substring(F.md5(F.concat_ws("|", key, d.cast("string")).cast("binary")), 1, 13)
    key = F.when(F.coalesce(*[F.col(k).cast("string") for k in keys]).isNotNull(), F.concat_ws("|", *keys))    # concat_ws leaves out nulls
    drawn = F.get(F.transform(F.array(key), lambda k: F.sort_array(F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda d: digits(k, d)))), 0)
    rank = lambda i: F.floor(F.conv(F.get("_drawn", i), 16, 10).cast("double") / 2.0 ** 52 * F.col("_n"))
    ends = {"low": (1 - level) / 2 * (draws - 1), "high": (1 + level) / 2 * (draws - 1)}
    places = [(name, side(at), share) for name, at in ends.items() for side, share in ((math.floor, 1 - at % 1), (math.ceil, at % 1))]
    wanted = F.array(*[F.struct(F.lit(name).alias("end"), rank(i).alias("_rank"), F.lit(share).alias("share")) for name, i, share in places])
    # a few megabytes of rows hold millions of draws, so they are dealt over all tasks
    dealt = same(rows, totals, by).repartition(int(predictions.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    asked = dealt.withColumn("_drawn", drawn).select(*predictions.columns, F.inline(wanted))
    met = same(asked, ranked, [*by, "_rank"])
    part = lambda name: F.sum(F.when(F.col("end") == name, F.col("share") * F.col("_value")))
    out = met.groupBy(*predictions.columns).agg(part("low").alias("_low"), part("high").alias("_high"))
    return out.select(*predictions.columns, (F.col(p) + F.col("_low")).alias("low"), (F.col(p) + F.col("_high")).alias("high"))


def loss_confidence(loss: Column) -> Column:
    return N.clip(1 - loss / 1000, 0.3, 0.95)
