import math

import pytest
from pyspark.sql import functions as F

from gridlight.functions import calendar as CAL, geo as G, numeric as N, solar as S, suitability as SU, tariff as TF, text as TX


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_block_charge_counts_31_in_the_first_block(spark):
    kwh = lambda x: F.lit(float(x))
    d1 = F.lit("D1")
    row = one(spark, TF.energy_charge(kwh(30), d1), TF.energy_charge(kwh(75), d1), TF.energy_charge(kwh(75), d1, inclusive_blocks=False),
              TF.energy_charge(kwh(150), F.lit("GP1")), TF.energy_charge(kwh(20000), d1))
    assert row[0] == 240.0
    assert row[1] == 31 * 8 + 30 * 10 + 14 * 16
    assert row[2] == 780.0
    assert row[3] == 101 * 45 + 49 * 55
    assert row[4] == 31 * 8 + 30 * 10 + 30 * 16 + 30 * 50 + 60 * 75 + 9819 * 100      # nothing beyond the last block


def test_unknown_tariff_falls_back_and_details_add_up(spark):
    k = F.lit(200.0)
    row = one(spark, TF.energy_charge(k, F.lit("ZZ")).alias("a"), TF.energy_charge(k, F.lit("d1")).alias("b"), TF.block_details(k, F.lit("D1")).alias("d"))
    assert row.a == row.b == sum(x.charge for x in row.d)
    assert sum(x.kwh_in_block for x in row.d) == 200.0 and len(row.d) == 6


def test_bill_parts(spark):
    b = TF.bill(F.lit(100.0), F.lit("D1"))
    row = one(spark, *[c.alias(n) for n, c in b.items()]).asDict()
    energy = 31 * 8 + 30 * 10 + 30 * 16 + 9 * 50
    assert row["energy_charge_lkr"] == energy
    assert row["total_bill_lkr"] == pytest.approx((energy * 1.18 + 180) * 1.18)
    assert one(spark, TF.bill(F.lit(0.0), F.lit("D1"))["effective_rate_lkr_per_kwh"])[0] == 0.0


def test_dashboard_bill_and_export_step(spark):
    row = one(spark, TF.dashboard_bill(F.lit(30.0)), TF.export_tariff(F.lit(5.0)), TF.export_tariff(F.lit(5.1)), TF.highest_block_rate(F.lit("GP1")))
    assert row[0] == round((240 + 180) * 1.18) and list(row)[1:] == [20.90, 19.61, 55.0]


def test_haversine_and_geodesic(spark):
    pts = [F.lit(x) for x in (6.9271, 79.8612, 7.2906, 80.6337)]
    h, g, z = one(spark, G.haversine_m(*pts), G.geodesic_m(*pts), G.geodesic_m(pts[0], pts[1], pts[0], pts[1]))
    assert 94_000 < h < 95_000
    assert abs(g - h) / h < 0.006 and z == 0.0
    # one degree of latitude at the equator on the ellipsoid
    assert one(spark, G.geodesic_m(F.lit(-0.5), F.lit(0.0), F.lit(0.5), F.lit(0.0)))[0] == pytest.approx(110_574.4, abs=1.0)


def test_month_encoding_round_trip(spark):
    df = spark.range(1, 13).select(F.col("id").cast("int").alias("m"))
    s, c = CAL.encode_cyclic(F.col("m"), 12, 1)
    assert df.where(CAL.decode_month(s, c) != F.col("m")).count() == 0
    assert [r[0] for r in df.select(CAL.quarter_of(F.col("m"))).collect()] == [1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 4]


def test_calendar_pieces(spark):
    y, m = CAL.add_months(F.lit(2025), F.lit(11), F.lit(3))
    row = one(spark, y, m, CAL.circular_month_distance(F.lit(1), F.lit(11)), CAL.lead_time(F.lit(2025), F.lit(11), F.lit(2026), F.lit(2)),
              CAL.days_in_month(F.lit(2)), CAL.season(F.lit(1)), CAL.month_name(F.lit(13)), CAL.season_band(F.lit(7)))
    assert list(row) == [2026, 2, 2, 3, 28, "NE Monsoon", "Month 13", "low"]


def test_right_closed_bins(spark):
    b = lambda x: N.right_closed_bin(F.lit(x), [0, 90, 150, 300, 2000], ["a", "b", "c", "d"])
    assert list(one(spark, b(0.0), b(90.0), b(90.1), b(2000.0), b(2000.1))) == [None, "a", "b", "d", None]


def test_guarded_numbers(spark):
    x = N.array_min_max_scale(F.array(F.lit(1.0), F.lit(3.0)))
    flat = N.array_min_max_scale(F.array(F.lit(2.0), F.lit(2.0)))
    row = one(spark, N.safe_divide(F.lit(1), F.lit(0)), N.percentage_change(F.lit(50.0), F.lit(75.0)), x, flat,
              N.pad_to(F.array(F.lit(1), F.lit(2)), 4), N.normal_cdf(F.lit(1.96)), N.array_median(F.array(F.lit(4.0), F.lit(1.0), F.lit(3.0), F.lit(2.0))))
    assert row[0] == 0.0 and row[1] == 50.0 and row[2] == [0.0, 1.0] and row[3] == [0.5, 0.5] and row[4] == [1, 2, 2, 2]
    assert row[5] == pytest.approx(0.9750021, abs=1e-6) and row[6] == 2.5


def test_correlation_of_a_constant_is_null(spark):
    df = spark.range(5).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("c"))
    row = df.agg(N.guarded_corr(F.col("x"), F.col("c")), N.guarded_corr(F.col("x"), -F.col("x"))).first()
    assert row[0] is None and row[1] == pytest.approx(-1.0)


def test_kolmogorov_p(spark):
    row = one(spark, N.kolmogorov_p(F.lit(0.5), F.lit(50.0), F.lit(50.0)), N.kolmogorov_p(F.lit(0.0), F.lit(9.0), F.lit(9.0)))
    assert row[0] < 1e-4 and row[1] == 1.0


def test_solar_units(spark):
    row = one(spark, S.kelvin_to_celsius(F.lit(300.0)), S.relative_humidity(F.lit(26.0), F.lit(25.0)), S.irradiance_kwh_per_day(F.lit(200.0)),
              S.wind_speed(F.lit(3.0), F.lit(4.0)), S.cloud_factor(F.lit(5.0), F.lit(0.0)), S.temp_efficiency(F.lit(27.0)))
    assert list(row) == [26.85, 100.0, 4.8, 5.0, 1.0, 0.99]


def test_suitability_ladders(spark):
    h = SU.headroom_analysis(F.lit(100.0), F.lit(40.0), F.lit(30.0), F.lit(8.0))
    row = one(spark, h["safe_headroom_kw"], h["can_support"], h["curtailment_risk"], SU.headroom_score(h["safe_headroom_kw"], h["available_headroom_kw"], F.lit(8.0)),
              SU.stability_score(h["utilization_after"]), SU.suitability_label(F.lit(60.0)), SU.capacity_tier(F.lit(70.0), F.lit(10.0)), SU.capacity_tier(F.lit(50.0), F.lit(10.0)),
              SU.distance_score(F.lit(1000.0)))
    assert list(row)[:8] == [10.0, True, True, 80.0, 75.0, "GOOD", 7.5, None]
    assert row[8] == pytest.approx(100 / math.e)


def test_display_strings(spark):
    row = one(spark, TX.format_currency(F.lit(2_500_000.0)), TX.format_currency(F.lit(1500.0)), TX.format_currency(F.lit(12.0)), TX.format_consumption(F.lit(1500.0)), TX.mask_account(F.lit("ACC0012345")))
    assert list(row) == ["Rs. 2.50M", "Rs. 1.5K", "Rs. 12", "1.5 MWh", "ACC00123..."]


def test_geodesic_lines_known_to_a_millimetre(spark):
    """A line over the Atlantic, a surveyed line, nearly opposite points, quarter and half meridians, the equator, the date line."""
    from gridlight.functions.geo import geodesic_m
    dms = lambda d, m, s: (abs(d) + m / 60 + s / 3600) * (-1 if d < 0 else 1)
    half = 20003931.4586
    lines = [(40.6, -73.8, 51.6, -0.5, 5551759.400), (dms(-37, 57, 3.72030), dms(144, 25, 29.52440), dms(-37, 39, 10.15610), dms(143, 55, 35.38390), 54972.271), (0.0, 0.0, 0.5, 179.5, 19936288.579),
             (0.0, 0.0, 0.5, 179.7, 19944127.421), (0.0, 0.0, 90.0, 0.0, 10001965.729), (0.0, 0.0, 0.0, 1.0, 111319.491), (0.0, 0.0, 0.0, 180.0, half), (30.0, 0.0, -30.0, 180.0, half),
             (90.0, 0.0, -90.0, 50.0, half), (0.0, 179.5, 0.0, -179.5, 111319.491), (6.9, 79.9, 6.9, 79.9, 0.0), (90.0, 10.0, 90.0, -70.0, 0.0)]
    df = spark.createDataFrame(lines, "a double, b double, c double, d double, want double")
    there, back = geodesic_m(F.col("a"), F.col("b"), F.col("c"), F.col("d")), geodesic_m(F.col("c"), F.col("d"), F.col("a"), F.col("b"))
    for r in df.select("*", there.alias("x"), back.alias("y")).collect():
        assert abs(r.x - r.want) < 0.001 and abs(r.y - r.want) < 0.001, r
    assert df.select(geodesic_m(F.lit(None).cast("double"), F.col("b"), F.col("c"), F.col("d"))).first()[0] is None
