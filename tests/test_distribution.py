"""Operators that must stay exact while the work is spread: quantiles, running totals, joins, neighbours."""

import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from gridlight.operators.ordered import exact_quantiles, histogram, ks_statistic, running_totals, value_bucket, weighted_median
from gridlight.operators.skew import skew_join
from gridlight.operators.solar import nearest_rows
from gridlight.operators.spatial import radius_join, top_k


def values(n, seed):
    rnd = random.Random(seed)
    return [(i % 3, rnd.choice([rnd.gauss(0, 1e-3), rnd.gauss(300, 80), 7.0, -rnd.expovariate(1e-4)])) for i in range(n)]


def test_buckets_keep_the_order(spark):
    df = spark.createDataFrame([(float(x),) for x in (-1e9, -5.0, -1e-9, 0.0, 1e-9, 0.5, 5.0, 1e9)], "v double")
    got = [r[0] for r in df.orderBy("v").select(value_bucket(F.col("v"))).collect()]
    assert got == sorted(got)


def test_quantiles_equal_numpy(spark):
    rows = values(3000, 1)
    df = spark.createDataFrame(rows, "g int, x double").repartition(7)
    probs = {"p0": 0.0, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    for r in exact_quantiles(df, ["g"], "x", probs).collect():
        x = np.array([v for g, v in rows if g == r.g])
        assert r.n == len(x)
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.percentile(x, p * 100), rel=1e-12, abs=1e-12)


def test_quantiles_of_one_hot_value_and_of_nulls(spark):
    df = spark.createDataFrame([(5.0,)] * 500 + [(None,)] * 3 + [(9.0,)], "x double")
    r = exact_quantiles(df, [], "x", {"m": 0.5, "hi": 1.0}).first()
    assert (r.n, r.m, r.hi) == (501, 5.0, 9.0)


def test_running_totals_equal_a_plain_window(spark):
    df = spark.createDataFrame(values(1000, 2), "g int, x double")
    hist = histogram(df, ["g"], "x")
    plain = hist.withColumn("c", F.sum("n").over(Window.partitionBy("g").orderBy("v")))
    both = running_totals(hist, ["g"], ["n"]).join(plain.select("g", "v", "c"), ["g", "v"])
    assert both.where("cum_n <> c").count() == 0 and both.count() == hist.count()


def test_weighted_median(spark):
    df = spark.createDataFrame([(1, 10.0, 0.2), (1, 20.0, 0.2), (1, 30.0, 0.6), (2, 1.0, 1.0), (2, 2.0, 1.0)], "g int, x double, w double")
    assert {r.g: r.weighted_median for r in weighted_median(df, ["g"], "x", "w").collect()} == {1: 30.0, 2: 1.0}


def test_ks_statistic_by_hand(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, True), (3.0, False), (4.0, False), (2.0, False)], "x double, r boolean")
    assert ks_statistic(df, [], "x", F.col("r")).first().ks_statistic == pytest.approx(2 / 3)


def test_skewed_join_meets_every_pair_once(spark):
    left = spark.range(300).select(F.col("id").alias("a"), F.when(F.col("id") < 200, 0).otherwise(F.col("id") % 5).alias("k"))
    right = spark.range(150).select(F.col("id").alias("b"), F.when(F.col("id") < 90, 0).otherwise(F.col("id") % 5).alias("k"))
    got = skew_join(left, right, ["k"], "a", "b", rows_per_shard=16)
    assert got.count() == left.join(right, "k").count()
    assert got.select("a", "b").distinct().count() == got.count()
    assert got.columns == ["k", "a", "b"]


@pytest.mark.parametrize("lat0,lon0", [(6.85, 79.9), (60.0, 179.99), (-33.0, -179.995)])
def test_radius_join_equals_brute_force(spark, lat0, lon0):
    from gridlight.functions.geo import haversine_m
    rnd = random.Random(3)
    wrap = lambda x: (x + 180) % 360 - 180
    pts = [(i, lat0 + rnd.uniform(-.05, .05), wrap(lon0 + rnd.uniform(-.05, .05))) for i in range(60)]
    tgt = [(i, lat0 + rnd.uniform(-.05, .05), wrap(lon0 + rnd.uniform(-.05, .05))) for i in range(80)]
    p = spark.createDataFrame(pts, "user_id long, latitude double, longitude double")
    t = spark.createDataFrame(tgt, "tid long, TRANSFORMER_LAT double, TRANSFORMER_LON double")
    got = {(r.user_id, r.tid) for r in radius_join(p, t, 2000.0, point_id="user_id", target_id="tid").collect()}
    d = haversine_m(F.col("latitude"), F.col("longitude"), F.col("TRANSFORMER_LAT"), F.col("TRANSFORMER_LON"))
    want = {(r.user_id, r.tid) for r in p.join(t, F.lit(True)).where(d <= 2000).collect()}
    assert got == want and want


def test_radius_join_with_a_radius_per_row(spark):
    p = spark.createDataFrame([(1, 6.9, 79.9, 500.0), (2, 6.9, 79.9, 9000.0)], "user_id long, latitude double, longitude double, r double")
    t = spark.createDataFrame([(1, 6.9, 79.96)], "tid long, TRANSFORMER_LAT double, TRANSFORMER_LON double")
    got = [r.user_id for r in radius_join(p, t, "r", point_id="user_id", target_id="tid", max_radius_m=1000.0).collect()]
    assert got == [2]


def test_nearest_rows_equal_brute_force(spark):
    rnd = random.Random(5)
    train = [(i, 1, 1, float(rnd.randint(0, 6)), rnd.gauss(0, 1), rnd.gauss(0, 3), rnd.random()) for i in range(120)] + [(500, 1, 1, 50.0, 9.0, 9.0, 1.0)]
    query = [(float(rnd.randint(0, 6)), rnd.gauss(0, 1), rnd.gauss(0, 3)) for _ in range(25)] + [(60.0, 10.0, 10.0)]
    tr = spark.createDataFrame(train, "account_id long, YEAR int, MONTH int, a double, b double, c double, Efficiency double")
    q = spark.createDataFrame(query, "a double, b double, c double")
    got = {}
    for r in nearest_rows(q, tr, ["a", "b", "c"], "Efficiency", ["account_id", "YEAR", "MONTH"]).collect():
        got.setdefault((r.a, r.b, r.c), []).append((r["rank"], r.account_id))
    x = np.array([t[3:6] for t in train])
    m, s = x.mean(axis=0), x.std(axis=0)
    assert len(got) == len(set(query))
    for key in set(query):
        d = np.sqrt((((x - m) / s - (np.array(key) - m) / s) ** 2).sum(axis=1))
        want = [train[i][0] for i in sorted(range(len(train)), key=lambda i: (round(d[i], 9), train[i][0]))[:3]]
        assert [a for _, a in sorted(got[key])] == want


@pytest.mark.parametrize("metric,pivots", [("euclidean", 2), ("cosine", 1024), ("cosine", 3)])
def test_nearest_rows_by_both_metrics(spark, metric, pivots):
    """Few pivots, a hot vector, ties, a row far off, a vector without direction, and fewer rows than asked for."""
    rnd = random.Random(8)
    train = [(i, 1, 1, rnd.choice([0.0, 1.0, 2.0]), rnd.gauss(0, 1), rnd.random()) for i in range(150)] + [(200 + i, 1, 1, 1.0, 0.5, 0.1) for i in range(60)] + [(900, 1, 1, 40.0, 40.0, 1.0)]
    query = [(rnd.choice([0.0, 1.0, 2.0]), rnd.gauss(0, 1)) for _ in range(20)] + [(1.0, 0.5), (60.0, -20.0)]
    tr = spark.createDataFrame(train + [(901, 1, 1, None, 1.0, 1.0)], "account_id long, YEAR int, MONTH int, a double, b double, Efficiency double")
    q = spark.createDataFrame(query + [(None, 1.0)], "a double, b double")
    stats_of = [[t[j] for t in train] + ([1.0] if j == 4 else []) for j in (3, 4)]    # the row without a value of a has one of b
    m, s = [np.mean(x) for x in stats_of], [np.std(x) for x in stats_of]
    for rows, k in ((tr, 4), (tr.where("account_id < 3"), 5)):
        got = {}
        if rows is not tr:
            few = [t for t in train if t[0] < 3]
            m, s = [np.mean([t[j] for t in few]) for j in (3, 4)], [np.std([t[j] for t in few]) or 1.0 for j in (3, 4)]
            train = few
        for r in nearest_rows(q, rows, ["a", "b"], "Efficiency", ["account_id", "YEAR", "MONTH"], k=k, metric=metric, pivots=pivots).collect():
            got.setdefault((r.a, r.b), []).append((r["rank"], r.account_id, r.distance))
        x = (np.array([t[3:5] for t in train]) - m) / s
        assert len(got) == len(set(query))
        for key in set(query):
            v = (np.array(key) - m) / s
            d = np.sqrt(((x - v) ** 2).sum(axis=1)) if metric == "euclidean" else 1 - (x @ v) / np.linalg.norm(x, axis=1) / np.linalg.norm(v)
            want = sorted(range(len(train)), key=lambda i: (round(d[i], 9), train[i][0]))[:k]
            mine = sorted(got[key])
            assert [round(e, 8) for _, _, e in mine] == pytest.approx([d[i] for i in want], abs=2e-8)
            if len({round(e, 7) for e in d[want]}) == len(want):    # where no digit decides
                assert [a for _, a, _ in mine] == [train[i][0] for i in want]


def test_top_k_prunes_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("x"))
    best = top_k(df, ["g"], [F.col("x").desc()], 2)
    assert sorted((r.g, r.x) for r in best.collect()) == [(0, 996), (0, 999), (1, 994), (1, 997), (2, 995), (2, 998)]
    plan = best._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_results_do_not_depend_on_partitioning(spark, tables):
    from gridlight.operators.rollup import customer_profiles, transformer_rollup
    r = tables("readings")
    for op in (transformer_rollup, lambda d: customer_profiles(d).drop("monthly_pattern")):
        a = sorted(str([round(x, 6) if isinstance(x, float) else x for x in row]) for row in op(r).collect())
        b = sorted(str([round(x, 6) if isinstance(x, float) else x for x in row]) for row in op(r.repartition(13, "MONTH")).collect())
        assert a == b


def test_pairs_of_a_small_file_are_spread_over_tasks(spark):
    from gridlight.operators.spatial import radius_join
    points = spark.range(0, 400, 1, 1).select(F.col("id").alias("u"), (6.8 + F.col("id") % 20 * 0.01).alias("latitude"), (79.8 + F.col("id") % 19 * 0.01).alias("longitude"))
    targets = points.select(F.col("u").alias("t"), F.col("latitude").alias("TRANSFORMER_LAT"), F.col("longitude").alias("TRANSFORMER_LON"))
    pairs = radius_join(points, targets, 2000.0, point_id="u", target_id="t")
    assert pairs.select(F.spark_partition_id()).distinct().count() > 1


def test_first_cells_of_a_dense_grid_are_narrow(spark):
    from gridlight.operators import solar as SO
    dense = spark.range(2500).select((6.0 + F.col("id") % 50 * 0.001).alias("g_lat"), (79.0 + F.floor(F.col("id") / 50) * 0.001).alias("g_lon"))
    assert SO.first_step(dense, 0.05) <= 0.05 / 8
    assert SO.first_step(dense.where((F.col("g_lat") < 6.0005) & (F.col("g_lon") < 79.0005)), 0.05) == 0.05 == SO.first_step(dense.limit(0), 0.05)
    stacked = dense.limit(1).crossJoin(spark.range(100)).drop("id")    # points upon each other: narrower cells would not part them
    assert SO.first_step(stacked, 0.05) == 0.05


def test_costly_distance_is_worked_out_once_a_pair(spark):
    from gridlight.functions import geo as G
    from gridlight.operators.spatial import radius_join
    points = spark.createDataFrame([(i, 6.8 + i % 7 * 0.006, 179.99 + i % 5 * 0.005 - (360 if i % 5 > 2 else 0)) for i in range(35)], "u int, latitude double, longitude double")
    targets = spark.createDataFrame([(i, 6.81 + i % 4 * 0.01, -179.995 + i % 3 * 0.01) for i in range(12)], "t int, TRANSFORMER_LAT double, TRANSFORMER_LON double")
    got = radius_join(points, targets, 2000.0, point_id="u", target_id="t", distance=G.geodesic_m)
    every = points.crossJoin(targets).withColumn("d", G.geodesic_m(*[F.col(c) for c in ("latitude", "longitude", "TRANSFORMER_LAT", "TRANSFORMER_LON")]))
    found = {(r.u, r.t): round(r.distance_m, 6) for r in got.collect()}
    assert found == {(r.u, r.t): round(r.d, 6) for r in every.where("d <= 2000").collect()} and found
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == every._jdf.queryExecution().optimizedPlan().toString().count("aggregate(")


def test_points_of_one_radius_are_not_copied(spark, monkeypatch):
    """With one radius for all, every point is sent once; the targets go to the cells that their circles touch."""
    from gridlight.operators import spatial as SP
    points = spark.range(200).select(F.col("id").alias("u"), (6.8 + F.col("id") % 20 * 0.004).alias("latitude"), (79.8 + F.col("id") % 19 * 0.004).alias("longitude"))
    targets = points.where("u % 7 = 0").select(F.col("u").alias("t"), F.col("latitude").alias("TRANSFORMER_LAT"), F.col("longitude").alias("TRANSFORMER_LON"))
    sent, plain = [], SP.skew_join
    monkeypatch.setattr(SP, "skew_join", lambda left, right, *a, **k: sent.append((left.count(), right.count())) or plain(left, right, *a, **k))
    one = SP.radius_join(points, targets, 2000.0, point_id="u", target_id="t")
    each = SP.radius_join(points.withColumn("r", F.lit(2000.0)), targets, "r", point_id="u", target_id="t", max_radius_m=2000.0)
    key = lambda df: sorted((r.u, r.t, r.distance_m) for r in df.collect())
    assert key(one) == key(each) and len(key(one)) > 200
    assert sent[0][0] == 200 and sent[1][0] > 200
