"""Order statistics against numpy, and what their two passes send."""

import math
import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridlight.operators import ordered as O


def bits(x):
    whole = struct.unpack(">q", struct.pack(">d", abs(x)))[0]
    return -whole if x < 0 else whole


def test_key_is_the_number_behind_the_double(spark):
    rng = random.Random(3)
    values = [0.0, -0.0, 5e-324, 1e-310, 2.2250738585072014e-308, 1.7976931348623157e308, math.inf, -math.inf, 7.999999999999999, 8.0] + [2.0 ** k for k in range(-1074, 1024, 3)]
    values += [rng.uniform(-1, 1) * 10 ** rng.randrange(-300, 300) for _ in range(1000)]
    rows = O.with_order_key(spark.createDataFrame([(v,) for v in values], "v double"), "v", "k").collect()
    assert all(r.k == bits(r.v) for r in rows)
    assert O.with_order_key(spark.createDataFrame([(math.nan,)], "v double"), "v", "k").first().k == (1 << 63) - 1


CLOSE = st.sampled_from([6.80, 6.8000001, 6.8 + 2 ** -40, 6.81, 0.0, -0.0, -6.8, 1e300, -1e-300]) | st.floats(-1e6, 1e6)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.none() | CLOSE), min_size=1, max_size=60))
def test_quantiles_as_numpy(spark, rows):
    probs = {"low": 0.0, "q1": 0.25, "median": 0.5, "p90": 0.9, "high": 1.0}
    got = {r.g: r for r in O.exact_quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", probs).collect()}
    groups = {g: [x for k, x in rows if k == g and x is not None] for g, _ in rows}
    assert got.keys() == {g for g, xs in groups.items() if xs}
    for g, r in got.items():
        assert r.n == len(groups[g])
        for name, p in probs.items():
            assert r[name] == pytest.approx(float(np.quantile(groups[g], p)), rel=1e-12, abs=1e-300)


def test_a_whole_column_and_no_rows(spark):
    df = spark.range(1000).selectExpr("CAST(id AS DOUBLE) / 7 AS x")
    assert tuple(O.exact_quantiles(df, [], "x", {"m": 0.5}).first()) == (1000, pytest.approx(499.5 / 7))
    assert tuple(O.exact_quantiles(df.limit(0), [], "x", {"m": 0.5}).first()) == (None, None)
    assert tuple(O.exact_quantiles(df.selectExpr("CAST(NULL AS DOUBLE) AS x"), [], "x", {"m": 0.5}).first()) == (None, None)


def test_close_values_leave_no_large_group(spark):
    """A hundred thousand coordinates in a hundredth of a degree: one prefix of the first pass, thousands of the second."""
    df = spark.range(100_000).selectExpr("6.80 + id * 1e-7 AS x")
    rows = O._prefixed(df, [], "x", {"n": F.lit(1)})
    sizes = rows.groupBy("_p").count().agg(F.max("count"), F.count(F.lit(1))).first(), rows.groupBy("_p", "_q").count().agg(F.max("count"), F.count(F.lit(1))).first()
    assert sizes[0][1] <= 2 and sizes[1][0] <= 100
    assert O.exact_quantiles(df, [], "x", {"q": 0.25}).first().q == pytest.approx(6.80 + 24_999.75 * 1e-7, abs=1e-12)


def test_only_rows_of_the_ranks_go_on(spark):
    """The second pass exchanges the rows of a few prefixes, not the values of the column."""
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(x),) for x in rng.lognormal(5, 1, 20_000)], "x double").repartition(4)
    rows = O._prefixed(df, [], "x", {"n": F.lit(1)})
    first = O._first_pass(rows, [], ["n"])
    wanted = [4999, 5000, 9999, 10000]
    chosen = first.where(" OR ".join(f"(_c_n - n <= {w} AND {w} < _c_n)" for w in wanted)).select("_p", (F.col("_c_n") - F.col("n")).alias("_before_n"))
    values, _ = O._second_pass(rows, chosen, [], ["n"])
    assert values.count() < 400
    plan = O.exact_quantiles(df, [], "x", {"a": 0.25, "b": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), CLOSE, st.integers(0, 5)), min_size=1, max_size=40))
def test_weighted_median_by_hand(spark, rows):
    got = {r.g: r.weighted_median for r in O.weighted_median(spark.createDataFrame([(g, x, float(w)) for g, x, w in rows], "g string, x double, w double"), ["g"], "x", "w").collect()}
    for g in {r[0] for r in rows}:
        mine = sorted((x, w) for k, x, w in rows if k == g)
        half, run = sum(w for _, w in mine) / 2, 0
        for x, w in mine:
            run += w
            # equal values are one row, so the weights of all of them count
            if sum(v for y, v in mine if y <= x) >= half:
                assert got[g] == x
                break


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.booleans(), CLOSE), min_size=1, max_size=60))
def test_ks_by_hand(spark, rows):
    r = O.ks_statistic(spark.createDataFrame([(s, x) for s, x in rows], "s boolean, x double"), [], "x", F.col("s")).first()
    one, two = [x for s, x in rows if s], [x for s, x in rows if not s]
    if not one or not two:
        assert r.ks_statistic is None
        return
    want = max(abs(sum(v <= x for v in one) / len(one) - sum(v <= x for v in two) / len(two)) for _, x in rows)
    assert r.ks_statistic == pytest.approx(want, abs=1e-12) and (r.n_recent, r.n_baseline) == (len(one), len(two))


def test_ks_looks_into_few_prefixes(spark):
    rng = np.random.default_rng(2)
    rows = [(bool(i % 2), float(x + (i % 2) * 0.3)) for i, x in enumerate(rng.normal(50, 1, 20_000))]
    df = spark.createDataFrame(rows, "s boolean, x double")
    first, second, last = O.gap_levels(df, [], "x", F.col("s"))
    assert first.count() < 100 and last.count() < 100 < second.count()    # values that are exchanged, of 20 000
    one, other = sorted(x for s, x in rows if s), sorted(x for s, x in rows if not s)
    at = sorted(one + other)
    want = max(abs(np.searchsorted(one, x, "right") / len(one) - np.searchsorted(other, x, "right") / len(other)) for x in at)
    assert O.ks_statistic(df, [], "x", F.col("s")).first().ks_statistic == pytest.approx(want, abs=1e-12)


def test_quantiles_between_opposite_numbers(spark):
    """Ends that nearly cancel out are taken from the nearer one, as numpy does."""
    df = spark.createDataFrame([(6.8000001,), (-6.8,)], "x double")
    assert O.exact_quantiles(df, [], "x", {"m": 0.5}).first().m == pytest.approx(float(np.quantile([6.8000001, -6.8], 0.5)), rel=1e-12)
