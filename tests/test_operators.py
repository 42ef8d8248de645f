import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridlight import constants as C
from gridlight.operators import billing as BL, clean as CL, drift as DR, ensemble as EN, finance as FI, metrics as ME, ml, pattern as PA, quality as QU, series as SE, similarity as SI, solar as SO, splits as SP

READING = "account_id long, ACCOUNT_NO string, TRANSFORMER_CODE string, YEAR int, MONTH int, IMPORT_kWh double, EXPORT_kWh double, NET_CONSUMPTION_kWh double, HAS_SOLAR int, INV_CAPACITY double, CAL_TARIFF string, PHASE string, CUSTOMER_LAT double, CUSTOMER_LON double, DATA_QUALITY string"


def reading(acc, year, month, imp, exp=0.0, solar=0, tariff="D1", phase="SP", lat=6.9, lon=79.9, quality="REAL"):
    return (acc, f"ACC{acc:06d}", "TF001", year, month, float(imp), float(exp), float(imp) - float(exp), solar, 5.0 * solar, tariff, phase, lat, lon, quality)


def frame(spark, rows):
    return spark.createDataFrame(rows, READING)


def test_ledger_earns_uses_and_lapses(spark):
    df = frame(spark, [reading(1, 2025, 1, 100, 150, 1), reading(1, 2025, 2, 120, 0, 1), reading(1, 2025, 3, 10, 0, 1), reading(1, 2026, 1, 100, 0, 1)])
    got = {(r.YEAR, r.month): r for r in BL.net_metering_ledger(df, ["account_id", "YEAR"]).collect()}
    jan, feb, mar, fresh = got[2025, 1], got[2025, 2], got[2025, 3], got[2026, 1]
    assert jan.credit_earned == 50 * 100.0 and jan.bill_lkr == 180.0 and jan.credit_balance == 5000.0
    gross_feb = round(((31 * 8 + 30 * 10 + 30 * 16 + 29 * 50) * 1.18 + 180) * 1.18, 2)
    assert feb.bill_lkr == 180.0 and feb.credits_used == pytest.approx(gross_feb - 180.0)
    gross_mar = round((80 * 1.18 + 180) * 1.18, 2)
    assert mar.bill_lkr == pytest.approx(max(180.0, gross_mar - feb.credit_balance))
    assert fresh.credits_used == 0.0 and fresh.credit_balance == 0.0
    s = {r.YEAR: r for r in BL.credit_summary(BL.net_metering_ledger(df, ["account_id", "YEAR"]), ["account_id", "YEAR"]).collect()}
    assert s[2025].months_with_excess == 1 and s[2025].average_monthly_credit == 5000.0 and s[2026].months_with_excess == 0


def test_annual_bill_sums_rounded_months(spark):
    bills = BL.monthly_bills(frame(spark, [reading(1, 2025, m, 75) for m in range(1, 13)]))
    r = BL.annual_bills(bills, ["account_id", "YEAR"]).first()
    month = round((772 * 1.18 + 180) * 1.18, 2)
    assert r.total_bill_lkr == pytest.approx(12 * month) and r.monthly_average_bill_lkr == pytest.approx(month)
    assert r.effective_rate_lkr_per_kwh == pytest.approx(12 * month / 900)


def test_cleaning(spark):
    raw = spark.createDataFrame([(" 12.5 ", "x", -999.0), ("bad", "y ", 5.0)], " `Total Import ` string, ` Phase` string, g double")
    df = CL.resolve_columns(CL.strip_headers(raw), {"IMPORT_kWh": (["import", "total"], None), "PHASE": (["phase"], "SP"), "CAL_TARIFF": (["tariff"], "D1"), "g": (["g"], None)})
    out = CL.sentinels_to_null(CL.coerce_numeric(CL.trim_strings(df), ["IMPORT_kWh"])).collect()
    assert [r.IMPORT_kWh for r in out] == [12.5, None] and [r.PHASE for r in out] == ["x", "y"] and out[0].CAL_TARIFF == "D1" and [r.g for r in out] == [None, 5.0]
    with pytest.raises(ValueError, match="missing columns: YEAR"):
        CL.require_columns(df, ["PHASE", "YEAR"])


def test_request_validation(spark):
    df = spark.createDataFrame([(1, 6.9, 79.9, {9: 300.0, 10: 310.0}, None), (2, 20.0, 79.9, {13: 5000.0}, "Q1")], "user_id long, latitude double, longitude double, consumption_months map<int,double>, tariff string")
    ok, bad = CL.split_requests(CL.validate_requests(df))
    a, b = ok.first(), bad.first()
    assert a.tariff == "D1" and a.household_size == 4
    assert b.errors == ["latitude out of range", "month out of range", "consumption out of range", "at least 2 months required", "invalid tariff"]


def test_fill_with_median_and_mode(spark):
    df = spark.createDataFrame([(1.0, "a"), (3.0, "a"), (None, "b"), (100.0, None)], "x double, s string")
    got = CL.fill_with_statistics(df, ["x"], ["s"]).collect()
    assert sorted(r.x for r in got) == [1.0, 3.0, 3.0, 100.0] and sorted(r.s for r in got) == ["a", "a", "a", "b"]


def test_rolling_excludes_the_current_row(spark):
    df = frame(spark, [reading(1, 2025, m, 10 * m) for m in range(1, 7)])
    rows = {r.MONTH: r for r in SE.ratio_features(SE.rolling_features(SE.lag_features(df))).collect()}
    assert rows[1].rolling_mean_3 is None and rows[2].rolling_std_3 is None
    assert rows[6].rolling_mean_3 == 40.0 and rows[6].rolling_max_3 == 50.0 and rows[6].lag_2 == 40.0
    assert rows[3].consumption_vs_avg == 30 / 20


def test_window_features_need_one_exchange(spark):
    df = frame(spark, [reading(1, 2025, m, 10 * m) for m in range(1, 7)])
    plan = SE.training_features(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_sequences_stay_inside_an_account(spark):
    df = frame(spark, [reading(a, 2025, m, 100 * a + m) for a in (1, 2) for m in range(1, 7)])
    s = SE.sequences(df, ["NET_CONSUMPTION_kWh"], 3, 2).collect()
    assert len(s) == 4        # 6 - 3 - 2 + 1 windows each, the last one included
    assert all({int(e[0] // 100) for e in r.x} == {int(v // 100) for v in r.y} == {r.account_id} for r in s)


def test_circular_smoothing(spark):
    df = spark.createDataFrame([(1, m, 100.0 if m == 12 else 0.0) for m in range(1, 13)], "k int, month int, v double")
    got = {r.month: r.v for r in SE.smooth_circular(df, ["k"], "v").collect()}
    assert (got[11], got[12], got[1], got[2]) == (25.0, 50.0, 25.0, 0.0)


def test_densify_keeps_measured_months(spark):
    df = frame(spark, [reading(1, 2025, 9, 100), reading(1, 2025, 10, 200), reading(2, 2025, 9, 3000, 10, 1)])
    got = {(r.account_id, r.MONTH): r for r in SE.densify_year(df, ["account_id", "YEAR"]).collect()}
    assert len(got) == 24 and got[1, 9].NET_CONSUMPTION_kWh == 100 and got[1, 9].DATA_QUALITY == "REAL"
    assert got[1, 4].NET_CONSUMPTION_kWh == 187.5 and got[1, 4].DATA_QUALITY == "SYNTHETIC"
    assert got[2, 4].NET_CONSUMPTION_kWh == 2000.0 and got[2, 4].EXPORT_kWh == 11.5 and got[2, 4].IMPORT_kWh == 2011.5


def users(spark, rows):
    return spark.createDataFrame(rows, "user_id long, latitude double, longitude double, consumption_months map<int,double>, tariff string, phase string, has_solar int")


def test_similarity_by_hand(spark):
    from gridlight.operators.rollup import customer_profiles
    same = [reading(1, 2025, m, 300 + 10 * m) for m in range(1, 13)]
    other = [reading(2, 2025, m, 300 + 10 * m, tariff="GP1") for m in range(1, 13)]
    short = [reading(3, 2025, m, 300 + 10 * m) for m in range(1, 6)]
    far = [reading(4, 2025, m, 300 + 10 * m, lat=7.9) for m in range(1, 13)]
    u = users(spark, [(7, 6.9, 79.9, {9: 390.0, 10: 400.0, 11: 410.0}, "D1", "SP", 0)])
    got = SI.similar_households(u, customer_profiles(frame(spark, same + other + short + far))).collect()
    assert [(r.user_id, r.account_id, r["rank"]) for r in got] == [(7, 1, 1)]
    assert got[0].score == pytest.approx(1.0)
    with pytest.raises(ValueError):
        SI.similarity_scores(u, weights={"geographic": 0.5})


def test_threshold_search_in_a_dense_city(spark, monkeypatch):
    """The same ten as by scoring every pair, from a small part of the pairs; lonely users and other tariffs go along."""
    import random
    from gridlight.operators.rollup import customer_profiles
    from gridlight.operators.spatial import top_k
    rng = random.Random(5)
    rows = []
    for a in range(2500):
        # most of them within 2 km of (6.9, 79.9), a few in the country; rows repeat places and levels, so scores tie
        spread = 0.016 if a % 50 else 0.2
        lat, level, tariff = 6.9 + rng.uniform(-spread, spread), rng.choice([300, 310, 320, 400]), "GP1" if a % 5 == 0 else "D1"
        lon = 79.9 + rng.uniform(-spread, spread)
        rows += [reading(a, 2025, m, level + 5 * m, lat=lat, lon=lon, tariff=tariff) for m in (7, 8, 9, 10, 11, 12)]
    asked = [(u, 6.9 + rng.uniform(-0.006, 0.006), 79.9 + rng.uniform(-0.006, 0.006), {9: 345.0, 10: 350.0, 11: 355.0}, "GP1" if u % 4 == 0 else "D1", "SP", 0) for u in range(20)]
    asked += [(20, 6.9, 79.9, {9: 2000.0, 10: 10.0}, "D1", "TP", 0), (21, 7.08, 80.05, {9: 345.0, 10: 350.0}, "D1", "SP", 0), (22, 9.0, 81.0, {9: 345.0}, "D1", "SP", 0)]
    u, profiles = users(spark, asked), customer_profiles(frame(spark, rows))
    every = SI.similarity_scores(SI.household_pairs(u, profiles))
    want = top_k(every, ["user_id"], [F.round("score", 9).desc(), F.col("account_id")], 10).where("score >= 0.4")
    scored, plain = [], SI.similarity_scores
    monkeypatch.setattr(SI, "similarity_scores", lambda pairs, *a: scored.append(pairs.count()) or plain(pairs, *a))
    got = SI.similar_households(u, profiles)
    key = lambda df: sorted((r.user_id, r["rank"], r.account_id, round(r.score, 9)) for r in df.collect())
    assert key(got) == key(want) and {r.user_id for r in got.select("user_id").distinct().collect()} >= set(range(20))
    assert sum(scored) < every.count() * 0.35 and len(scored) > 1
    assert SI.similar_households(u.limit(0), profiles).count() == 0


def test_undefined_shape_scores_a_half(spark):
    from gridlight.operators.rollup import customer_profiles
    flat = frame(spark, [reading(1, 2025, m, 300) for m in range(1, 13)])
    u = users(spark, [(7, 6.9, 79.9, {9: 300.0, 10: 300.0}, "D1", "TP", 0)])
    r = SI.similarity_scores(SI.household_pairs(u, customer_profiles(flat))).first()
    assert r.pattern_score == pytest.approx(0.9) and r.technical_score == pytest.approx(0.8) and r.seasonal_score == 1.0


def test_pattern_defaults_for_lonely_users(spark):
    from gridlight.operators.rollup import customer_profiles
    near = frame(spark, [reading(a, 2025, m, 300 + a) for a in (1, 2, 3) for m in range(1, 13)])
    u = users(spark, [(7, 6.9, 79.9, {9: 300.0, 10: 301.0}, "D1", "SP", 0), (8, 9.0, 81.0, {9: 300.0, 10: 301.0}, "D1", "SP", 0)])
    p = PA.user_patterns(u, SI.similar_households(u, customer_profiles(near)))
    rows = {(r.user_id, r.month): r for r in p.collect()}
    assert len(rows) == 24 and rows[8, 4].median == pytest.approx(350 * 1.25) and rows[8, 4].iqr == 80.0 and rows[8, 4].n_similar == 0
    assert rows[7, 4].n_similar == 3 and rows[7, 11].n_points == 0 and rows[7, 10].n_points == 3      # nothing after the last known month
    f = {(r.user_id, r.horizon): r for r in PA.pattern_forecast(p).collect()}
    assert (f[7, 1].month, f[7, 1].year, f[7, 3].month, f[7, 3].year, f[7, 12].month) == (11, 2025, 1, 2026, 10)
    assert f[7, 12].confidence == 0.9 and all(x.lower_kwh >= 0 for x in f.values())


def test_ensemble_rescales_to_the_user(spark):
    u = users(spark, [(1, 6.9, 79.9, {9: 100.0, 10: 300.0}, "D1", "SP", 0)])
    flat = lambda v, c: u.select("user_id", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month")).withColumns({"kwh": F.lit(v), "confidence": F.lit(c)})
    both = EN.combine(EN.stack_forecasts({"lstm": flat(100.0, 0.9), "pattern": flat(400.0, 0.3)}), u).collect()
    assert all(r.kwh == pytest.approx(200.0) and (r.lower_bound, r.upper_bound, r.n_methods) == (100.0, 400.0, 2) for r in both)
    single = EN.combine(EN.stack_forecasts({"pattern": flat(50.0, 0.3)}), u).first()
    assert single.kwh == pytest.approx(200.0) and single.q25 == 45.0 and single.std_dev == pytest.approx(10.0)


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1, 2025, 1, 100.0, 110.0), (1, 2025, 2, 200.0, 190.0), (1, 2025, 3, 0.0, 5.0)], "account_id long, YEAR int, MONTH int, y_true double, y_pred double")
    m = ME.forecast_metrics(df).first()
    assert m.mae == pytest.approx(25 / 3) and m.mape == pytest.approx((10 + 5) / 2) and m.peak_error == 10.0 and m.bias == pytest.approx(5 / 3)
    assert m.r2 == pytest.approx(1 - 225 / 20000)
    assert df.agg(ME.weighted_mae(F.col("y_true"), F.col("y_pred"))).first()[0] == pytest.approx((30 + 20 + 15) / 3)


def test_diebold_mariano_names_the_better_model(spark):
    rows = [(1, 2025, i, 100.0, 100.0 + (i % 3), 100.0 + 5 + (i % 4)) for i in range(1, 13)] + [(2, 2025, i, 1.0, 1.0, 1.0) for i in range(1, 6)]
    df = spark.createDataFrame(rows, "account_id long, YEAR int, MONTH int, y_true double, y_pred double, y_pred2 double")
    got = {r.account_id: r for r in ME.diebold_mariano(df, ["account_id"], ["YEAR", "MONTH"], lags=1).collect()}
    assert got[1].better_model == "model1" and got[1].dm_statistic < 0 and 0 <= got[1].p_value <= 1
    assert got[2].dm_statistic == 0.0 and got[2].p_value == 1.0 and not got[2].significant


def test_quality_report_lists_issues(spark):
    rows = [reading(1, 2025, m, 100) for m in range(1, 13)] + [reading(2, 2025, 1, 0, tariff="XX", lat=1.0)]
    r = QU.quality_advice(QU.quality_report(frame(spark, rows).withColumn("IMPORT_kWh", F.when(F.col("MONTH") > 2, F.col("IMPORT_kWh"))), ["YEAR"])).first()
    text = " | ".join(r.quality_issues)
    for words in ("Missing values in IMPORT_kWh: 3", "Zero consumption records: 1", "Low data completeness: 0.50", "Invalid locations: 1", "Invalid tariffs: 1"):
        assert words in text
    assert 0.1 <= r.overall_score < 0.8 and "Address missing values through imputation or filtering" in r.recommendations


def test_seasonal_ranks_average_ties(spark):
    r = QU.seasonal_consistency(frame(spark, [reading(1, 2025, m, 100) for m in range(1, 13)])).first()
    assert r.seasonal_score == pytest.approx((13 - 6.5) / 12)


def test_prediction_drift_levels(spark):
    base = [1.0, 2.0, 1.0, 2.0, 1.0, 2.0]
    rows = [(k, i, v) for k, recent in ((1, 9.0), (2, 1.6), (3, 2.7)) for i, v in enumerate(base + [recent] * 6)] + [(4, i, 1.0) for i in range(5)]
    got = {r.k: r for r in DR.prediction_drift(spark.createDataFrame(rows, "k int, t int, mae double"), ["k"], ["t"]).collect()}
    assert got[1].severity == "high" and got[2].drift_detected is False and got[3].severity == "medium" and 4 not in got


def test_drift_summary_ladder(spark):
    mk = lambda rows: DR.drift_summary(spark.createDataFrame(rows, "at int, type string, severity string, key string")).first()
    assert mk([(1, "feature_drift", "medium", "a")]).recommendation.startswith("INFO")
    r = mk([(i, "prediction_error_drift", "medium", "a") for i in range(7)])
    assert r.recommendation.startswith("WARNING") and [x.at for x in r.recent_alerts] == [6, 5, 4, 3, 2]
    assert mk([(1, "cluster_instability", "high", "a")]).recommendation.startswith("URGENT")
    assert mk([]).status == "healthy"


def test_splits_do_not_leak(spark, tables):
    r = tables("readings")
    many = spark.range(4000).select((F.col("id") % 1000).alias("account_id"))
    s = SP.group_split(many)
    assert SP.leakage(s).first().shared == 0 and SP.leakage(SP.group_split(r)).first().shared == 0
    assert 0.15 < s.where("split = 'test'").count() / 4000 < 0.25
    t = SP.temporal_split(r).groupBy("split").agg(F.min("time_idx").alias("a"), F.max("time_idx").alias("b")).collect()
    by = {x.split: x for x in t}
    assert by["train"].b < by["val"].a <= by["val"].b < by["test"].a
    w = SP.walk_forward(r, 2, 12).groupBy("fold", "role").agg(F.min(F.col("YEAR") * 12 + F.col("MONTH")).alias("a"), F.max(F.col("YEAR") * 12 + F.col("MONTH")).alias("b")).collect()
    f = {(x.fold, x.role): x for x in w}
    assert all(f[k, "train"].b < f[k, "test"].a for k in (1, 2))


def test_sample_is_reproducible(spark, tables):
    r = tables("readings").select("account_id", "YEAR", "MONTH")
    a = SP.hash_sample(r, 50, ["account_id", "YEAR", "MONTH"]).collect()
    assert a == SP.hash_sample(r.repartition(9), 50, ["account_id", "YEAR", "MONTH"]).collect() and len(a) == 50


def test_system_cost_and_quotes(spark):
    c = lambda x: FI.system_cost(F.lit(float(x)))
    assert list(spark.range(1).select(c(5), c(6)).first()) == [800_000.0, 1_200_000.0]
    pts = spark.createDataFrame([("A", 3.0, 600_000.0), ("A", 5.0, 800_000.0), ("B", 4.0, 500_000.0)], "vendor string, size_kw double, price_lkr double")
    s = spark.createDataFrame([(1, 4.0), (2, 99.0), (3, 3.333)], "system_id long, size_kw double")
    got = {(r.system_id, r.vendor): (r.price_lkr, r["rank"]) for r in FI.vendor_quotes(s, pts).collect()}
    assert got[1, "A"] == (700_000.0, 2) and got[1, "B"] == (500_000.0, 1) and got[2, "A"][0] == 800_000.0 and got[3, "A"][0] == 633_000.0


def test_ghi_imputation_touches_listed_months_only(spark):
    w = spark.createDataFrame([(1, 2025, 10, 5.0, 6.0), (1, 2025, 11, None, None), (1, 2025, 12, 9.0, 9.0)], "SITE_ID int, Year int, Month int, Solar_Irradiance_GHI double, Clear_Sky_GHI double")
    h = spark.createDataFrame([(1, y, m, 4.0 + y % 2, 6.0) for y in (2020, 2021) for m in (10, 11, 12)], w.schema)
    got = {r.Month: r.Solar_Irradiance_GHI for r in CL.impute_irradiance(w, h, 2020, 2021).collect()}
    assert got == {10: 5.0, 11: 4.5, 12: 4.5}
    full = CL.impute_irradiance(w.where("Month <> 11"), h, 2020, 2021).collect()
    assert {r.Month: r.Solar_Irradiance_GHI for r in full} == {10: 5.0, 12: 9.0}


def test_weather_merge_provenance(spark):
    cols = "SITE_ID int, Year int, Month int, Solar_Irradiance_GHI double, Temperature double, Max_Temperature double, Min_Temperature double, Humidity double, Precipitation double, Wind_Speed double"
    fc = spark.createDataFrame([(1, 2026, 1, 5.0, 27.0, 30.0, 24.0, 80.0, 1.0, 2.0), (1, 2026, 2, 5.0, None, None, None, None, 1.0, 2.0)], cols)
    cl = spark.createDataFrame([(1, m, 4.0, 26.0, None, None, None, 1.0, 1.0, 6.0) for m in (1, 2, 3)], "SITE_ID int, Month int, Solar_Irradiance_GHI double, Temperature double, Max_Temperature double, Min_Temperature double, Humidity double, Precipitation double, Wind_Speed double, Clear_Sky_GHI double")
    months = spark.createDataFrame([(1, 2026, m) for m in (1, 2, 3)], "SITE_ID int, Year int, Month int")
    got = {r.Month: r for r in SO.merge_forecast(months, fc, cl).collect()}
    assert [got[m].data_source for m in (1, 2, 3)] == ["C3S", "HYBRID", "NASA_TMY"]
    assert got[2].Temperature == 26.0 and got[2].Max_Temperature == 29.0 and got[3].Humidity == 75.0


def test_model_helpers(spark):
    m = spark.createDataFrame([("a", 10.0, None), ("b", 40.0, 20.0), ("c", 12.0, 30.0), ("d", 11.0, 10.0)], "model string, mae double, cv_mae double")
    assert [r.verdict for r in ml.overfit_verdict(m).orderBy("model").collect()] == ["—", "OVERFIT", "CV leak?", "stable"]
    assert ml.best_model(m).first().model == "a"
    df = spark.createDataFrame([(float(i), float(i % 2)) for i in range(100)], "x double, y double")
    d = ml.mutual_information(df.withColumn("z", F.col("y")), ["x", "z"], "y", 2).collect()
    mi = {r.feature: r.mutual_information for r in d}
    assert mi["z"] == pytest.approx(0.6931, abs=1e-3) and mi["x"] == pytest.approx(0.0, abs=1e-3)


def test_nearest_grid_point_however_far(spark):
    import random
    from gridlight.operators import solar as SO
    rng = random.Random(4)
    grid = [(6 + rng.random(), 79 + rng.random(), i) for i in range(60)]
    sites = [(i, 6 + rng.random() * 1.2, 79 + rng.random() * 1.2) for i in range(40)] + [(100, 40.0, 10.0), (101, -60.0, 170.0)]
    got = {r.k: r.v for r in SO.nearest_cell(spark.createDataFrame(sites, "k int, lat double, lon double"), spark.createDataFrame(grid, "lat double, lon double, v int"), ["k"], ["v"], 0.05).collect()}
    assert got == {k: min(grid, key=lambda g: (g[0] - y) ** 2 + (g[1] - x) ** 2)[2] for k, y, x in sites}


def test_registered_models_are_the_whole_job(spark, tables, monkeypatch):
    from gridlight.catalog import models as MO
    seen = {}
    monkeypatch.setattr(MO, "fitted", lambda t: (None, None))
    monkeypatch.setattr(ml, "grid_search", lambda train, features, label, models, folds=5, **k: seen.update(models=models, folds=folds) or {})
    monkeypatch.setattr(ml, "evaluate_models", lambda *a: None)
    MO.grid_search(tables)
    assert set(seen["models"]) == {"Ridge", "Lasso", "RandomForest", "GradientBoosting"} and seen["folds"] == 5
    space = {k: [{p.name: v for p, v in g.items()} for g in grid] for k, grid in ml.grids(seen["models"]).items()}
    assert {k: len(v) for k, v in space.items()} == {"Ridge": 3, "Lasso": 3, "RandomForest": 12, "GradientBoosting": 12}
    assert {(g["numTrees"], g["maxDepth"]) for g in space["RandomForest"]} == {(n, d) for n in (100, 200) for d in (10, 20, 30)}
    assert {(g["maxIter"], g["stepSize"], g["maxDepth"]) for g in space["GradientBoosting"]} == {(n, r, d) for n in (100, 200) for r in (0.05, 0.1) for d in (4, 6, 8)}
    fits = []
    monkeypatch.setattr(ml, "fit_models", lambda train, features, models: fits.append(models) or models)
    monkeypatch.setattr(ml, "importances", lambda *a: None)
    monkeypatch.setattr(ME, "forecast_metrics", lambda *a, **k: spark.createDataFrame([], "mae double, rmse double, r2 double, mape double"))
    monkeypatch.setattr(ml, "evaluate_models", lambda *a: spark.createDataFrame([], "model string, mae double, rmse double, r2 double, mape double, cv_mae double, gap double, verdict string"))
    MO.model_table(tables)
    MO.importances(tables)
    assert [m["RandomForest"].getNumTrees() for m in fits] == [100, 100] and fits[0]["GradientBoosting"].getMaxIter() == 50


def test_bootstrap_draws_are_independent_of_the_keys_remainder(spark, tables):
    """Rows whose keys are equal modulo 10007 had equal weights in every draw, so their errors never evened out."""
    import hashlib
    import math
    from gridlight.catalog import models as MO
    keys = [(i * 10007, 2000 + i % 3, 1 + i % 2, float(i % 2 and 10), 0.0) for i in range(400)]

    def weight(u):
        k, term = 0, math.exp(-1)
        below = term
        while u >= below:
            k += 1
            term /= k
            below += term
        return k

    shifted = [(a, y, m, e + i % 7, p) for i, (a, y, m, e, p) in enumerate(keys)]
    got = ml.bootstrap_interval(spark.createDataFrame(shifted, "account_id long, YEAR int, MONTH int, y_true double, y_pred double"), ["MONTH"]).orderBy("MONTH").collect()
    most = 0
    for r in got:
        rows = [(a, y, m, e) for a, y, m, e, _ in shifted if m == r.MONTH]
        means = []
        for d in range(100):
            w = [weight(int(hashlib.md5(f"{a}|{y}|{m}|{d}".encode()).hexdigest()[:13], 16) / 2 ** 52) for a, y, m, _ in rows]
            most = max(most, *w)
            means.append(sum(x * e for x, (*_, e) in zip(w, rows)) / sum(w))
        means.sort()
        at = lambda q: means[int(q * 99)] + (q * 99 - int(q * 99)) * (means[min(99, int(q * 99) + 1)] - means[int(q * 99)])
        assert (r.low, r.median, r.high) == (pytest.approx(at(0.025)), pytest.approx(at(0.5)), pytest.approx(at(0.975)))
    assert len(got) == 2 and most > 4
    called = {}
    original = ml.bootstrap_interval
    try:
        ml.bootstrap_interval = lambda df, by, draws=100: called.update(draws=draws) or original(df, by, draws)
        MO.bootstrap(tables)
    finally:
        ml.bootstrap_interval = original
    assert called["draws"] == 100


def test_pairs_that_cannot_enter_are_not_scored(spark):
    """Households far from the user's level go, whatever else is alike; without a score to beat, or with a gap, all stay."""
    schema = "user_id int, user_phase string, account_phase string, data_quality_score double, distance_m double, net_by_month array<double>, _own array<double>, _kth double, _gaps boolean"
    own = [None] * 8 + [300.0, 310.0, 320.0, None]
    alike, other = [310.0] * 12, [900.0] * 12
    rows = [(1, "SP", "SP", 1.0, 100.0, alike, own, 0.8, False), (2, "SP", "SP", 1.0, 100.0, other, own, 0.8, False), (3, "SP", "SP", 1.0, 100.0, other, own, None, False),
            (4, "SP", "SP", 1.0, 100.0, other, own, 0.8, True), (5, "SP", "SP", 1.0, 100.0, [None] * 12, own, 0.8, False), (6, "SP", "SP", 1.0, 100.0, [None] * 12, own, 0.6, False)]
    held = SI.may_enter(spark.createDataFrame(rows, schema), 2000.0, C.SIMILARITY_WEIGHTS)
    assert sorted(r.user_id for r in held.collect()) == [1, 3, 4, 6]


def test_block_search_keeps_the_best_pairs(spark):
    """Blocks of many levels, gaps, missing months, equal scores and odd values: the same ranks as by scoring every pair, from few pairs."""
    import random
    from gridlight.operators.spatial import top_k
    rng = random.Random(11)
    month = lambda level, some: {m: {"net_consumption": level + rng.choice([-20.0, 0.0, 15.0]) * (m % 3)} for m in some}
    homes = []
    for a in range(3000):
        some = range(1, 13) if a % 9 else rng.sample(range(1, 13), 7)
        level = rng.choice([-40.0, 0.0, 150.0, 200.0, 210.0, 400.0])
        homes.append((a, 6.9 + rng.uniform(-0.03, 0.03), 79.9 + rng.uniform(-0.03, 0.03), rng.choice([0, 1, None]), "D1", rng.choice(["SP", "TP", None]), len(some), rng.choice([0, 3]), 1.0, 1.0, 1.0, month(level, some)))
    homes.append((9001, 6.9, 79.9, 0, "D1", "SP", 12, 0, 1.0, 1.0, 1.0, month(float("nan"), range(1, 13))))
    schema = "account_id long, CUSTOMER_LAT double, CUSTOMER_LON double, HAS_SOLAR int, CAL_TARIFF string, PHASE string, months_with_data int, low_months int, annual_total double, annual_average double, household_median double, monthly_pattern map<int,struct<net_consumption:double>>"
    profiles = spark.createDataFrame(homes, schema)
    asked = [(u, 6.9 + rng.uniform(-0.03, 0.03), 79.9 + rng.uniform(-0.03, 0.03), {m: rng.choice([150.0, 205.0, 390.0]) + 7.0 * (m % 2) for m in rng.choice([(9, 10, 11), (1,), (3, 4), (9, 10, 11), ()])}, "D1", "SP", u % 2) for u in range(150)]
    asked += [(150, 6.9, 79.9, {9: None, 10: 200.0}, "D1", "SP", 0), (151, 6.9, 79.9, {9: float("inf")}, "D1", "SP", 0), (152, 6.9, 79.9, None, "D1", "SP", 0), (153, None, 79.9, {9: 200.0}, "D1", "SP", 0), (None, 6.9, 79.9, {9: 200.0}, "D1", "SP", 0)]
    u = users(spark, asked + asked[:3])
    every = SI.similarity_scores(SI.household_pairs(u, profiles)).cache()
    want = top_k(every, ["user_id"], [F.round("score", 9).desc(), F.col("account_id")], 10).where("score >= 0.4")
    key = lambda df: sorted(str((r.user_id, r["rank"], r.account_id, round(r.score, 9))) for r in df.collect())
    assert key(SI.similar_households(u, profiles)) == key(want) and {r.user_id for r in want.collect()} >= {150, 151, 152, None}
    # a regular user's pairs that go on to the scores are few, however many live within the radius
    calm = users(spark, asked[:150])
    vectors, homes = SI.user_vectors(calm), SI.candidate_profiles(profiles.where("account_id < 9001"))
    kept = SI.candidate_pairs(vectors, homes, 10, 0.4, 2000.0, C.SIMILARITY_WEIGHTS).count()
    assert kept < SI.household_pairs(calm, profiles).count() * 0.35


def test_month_statistics_stay_one_row_a_user(spark):
    """The points of a user are not dealt out as rows; the figures are those of numpy, thin months and the last known month included."""
    import numpy as np
    rng = np.random.default_rng(3)
    kind = "user_id long, account_id long, score double, household_median double, last_user_month int, net_by_month array<double>"
    rows = [(u if u else None, a, float(rng.uniform(0.4, 1)), 300.0, 9 + u % 4, [None if rng.random() < 0.2 else float(rng.choice([5.0, 80.0, 250.0, 300.0, 310.0, 1000.0])) for _ in range(12)]) for u in range(6) for a in range(1 + 2 * u)]
    similar = spark.createDataFrame(rows, kind)
    points = PA.pattern_points(similar)
    assert points.count() == 6
    got = {(r.user_id, r.month): r for r in PA.month_statistics(points).collect()}
    want = set()
    for u in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == u]
        for m in range(1, own[0][4] + 1):
            kept = sorted((r[5][m - 1], r[2] / sum(x[2] for x in own)) for r in own if r[5][m - 1] is not None and 90 <= r[5][m - 1] <= 900)
            if not kept:
                continue
            want.add((u, m))
            v, w = np.array(kept).T
            r = got[u, m]
            assert r.n == len(v) and r.median == v[np.searchsorted(np.cumsum(w), w.sum() / 2 - 1e-12)]
            q = np.quantile(v, [0.1, 0.25, 0.75, 0.9])
            assert (r.p10, r.iqr, r.p90) == (pytest.approx(q[0]), pytest.approx(q[2] - q[1]), pytest.approx(q[3]))
    assert got.keys() == want
    rows = {(r.user_id, r.month): r for r in PA.monthly_patterns(similar).collect()}
    assert len(rows) == 72 and all(r.n_points == (got[k].n if k in got else 0) for k, r in rows.items())
