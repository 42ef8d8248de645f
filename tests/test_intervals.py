"""Prediction intervals, Student's p-values and the functions behind them, by hand."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlight.functions import numeric as N
from gridlight.operators import metrics as ME, ml


def test_intervals_are_quantiles_of_the_drawn_residuals(spark):
    rng = random.Random(3)
    rows = [(i, "a" if i % 3 else "b", 100.0 + i, 100.0 + i + rng.choice([0.0, 1.5, rng.gauss(0, 5)])) for i in range(150)] + [(999, "alone", 5.0, 7.0)]
    df = spark.createDataFrame(rows, "id long, g string, y_pred double, y_true double")
    got = {r.id: (r.low, r.high) for r in ml.prediction_intervals(df, ["g"], ["id"], draws=40).collect()}
    assert len(got) == len(rows)
    for i, g, p, _ in rows:
        pool = sorted(t - q for _, h, q, t in rows if h == g)
        drawn = [pool[int(int(hashlib.md5(f"{i}|{d}".encode()).hexdigest()[:13], 16) / 2 ** 52 * len(pool))] for d in range(40)]
        assert got[i] == (pytest.approx(p + np.quantile(drawn, 0.025)), pytest.approx(p + np.quantile(drawn, 0.975)))
    assert got[999] == (7.0, 7.0)
    assert ml.prediction_intervals(df.limit(0), ["g"], ["id"]).count() == 0


def test_draws_are_sorted_without_a_comparator_of_lambdas(spark):
    df = spark.createDataFrame([(None, None, 1.0, 2.0), (1, None, 3.0, 5.0), (2, "", 4.0, 4.5)], "id long, s string, y_pred double, y_true double")
    out = ml.prediction_intervals(df.withColumn("g", F.lit(1)), ["g"], ["id", "s"], draws=40)
    pool = [0.5, 1.0, 2.0]
    for r in out.collect():
        head = [str(k) for k in (r.id, r.s) if k is not None]
        drawn = [pool[int(int(hashlib.md5("|".join([*head, str(d)]).encode()).hexdigest()[:13], 16) / 2 ** 52 * 3)] for d in range(40)]
        assert (r.low, r.high) == (pytest.approx(r.y_pred + np.quantile(drawn, 0.025)), pytest.approx(r.y_pred + np.quantile(drawn, 0.975)))
    assert "array_sort(" not in out._jdf.queryExecution().optimizedPlan().toString()


def density(t, v):
    return math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi) * (1 + t * t / v) ** (-(v + 1) / 2)


def test_p_values_of_students_t(spark):
    """Tabulated points, one of them with 9 degrees of freedom, and Simpson's rule elsewhere."""
    points = [(12.706205, 1), (4.302653, 2), (2.262157, 9), (2.228139, 10), (1.959964, 10**9)] + [(t, v) for t in (0.0, 0.01, 0.7, 1.3, 3.1, 6.0) for v in (1, 2, 3, 5, 9, 40, 1000)]
    rows = spark.createDataFrame([(float(t), v) for t, v in points], "t double, v long").select("t", "v", N.t_two_sided_p(F.col("t"), F.col("v")).alias("p"), N.t_two_sided_p(-F.col("t"), F.col("v")).alias("q")).collect()
    for r in rows:
        assert r.p == pytest.approx(r.q, abs=1e-15)
        if r.t in (12.706205, 4.302653, 2.262157, 2.228139, 1.959964):
            assert r.p == pytest.approx(0.05, abs=2e-7)
        else:
            xs = np.linspace(0, r.t, 4001)
            weights = np.where(np.arange(4001) % 2 == 1, 4.0, 2.0)
            weights[[0, -1]] = 1.0
            area = r.t / 12000 * sum(w * density(x, r.v) for w, x in zip(weights, xs))
            assert r.p == pytest.approx(1 - 2 * area, abs=1e-9)


def test_t_test_of_few_rows(spark):
    a, b = [30.02, 29.99, 30.11, 29.97, 30.01], [29.89, 29.93, 29.72, 29.98, 30.02, 29.98]
    df = spark.createDataFrame([(x, True) for x in a] + [(x, False) for x in b], "x double, g boolean")
    r = ME.t_test(df, "x", F.col("g")).first()
    pooled = (4 * np.var(a, ddof=1) + 5 * np.var(b, ddof=1)) / 9
    t = (np.mean(a) - np.mean(b)) / math.sqrt(pooled * (1 / 5 + 1 / 6))
    xs = np.linspace(0, t, 2001)
    assert r.t_statistic == pytest.approx(t) and r.p_value == pytest.approx(1 - 2 * np.trapezoid([density(x, 9) for x in xs], xs), abs=1e-6)
    assert ME.t_test(df.limit(1), "x", F.col("g")).first().p_value is None


def test_log_gamma_ratio(spark):
    values = [0.5, 1.0, 1.5, 4.5, 20.0, 5e3, 5e8]
    rows = spark.createDataFrame([(v,) for v in values], "a double").select("a", N.log_gamma_ratio(F.col("a")).alias("r")).collect()
    for r in rows:
        want = math.lgamma(r.a + 0.5) - math.lgamma(r.a) if r.a < 1e6 else 0.5 * math.log(r.a) - 1 / (8 * r.a)
        assert r.r == pytest.approx(want, abs=1e-9)
