import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from gridlight import constants as C
from gridlight.sources import readers as RD, sinks as SK
from gridlight.streaming import jobs as J


def test_csv_reader_keeps_corrupt_rows(spark, tmp_path):
    head = ",".join(f.name for f in RD.READING_SCHEMA)
    good = "TF1,6.9,79.9,A1,6.9,79.9,1,2025,100,0,100,0,0,D1,SP,REAL,REAL,10"
    (tmp_path / "a.csv").write_text(f"{head}\n{good}\n{good.replace('2025', 'year?')}\n")
    rows = RD.read_readings(spark, str(tmp_path / "a.csv"), "csv").cache().collect()
    assert len(rows) == 2 and sum(r._corrupt_record is not None for r in rows) == 1


def test_customer_sheets_take_the_file_name(spark, tmp_path):
    (tmp_path / "TF001.csv").write_text(" Account No ,Inv. Capacity,CAL TARIFF\nA1,5, D1 \nA2,bad,GP1\n")
    (tmp_path / "TF002.csv").write_text(" Account No ,Inv. Capacity,CAL TARIFF\nA3,0,D1\n")
    got = {r.ACCOUNT_NO: r for r in RD.read_customer_sheets(spark, str(tmp_path)).collect()}
    assert got["A1"].TRANSFORMER_CODE == "TF001" and got["A1"].HAS_SOLAR == 1 and got["A1"].CAL_TARIFF == "D1"
    assert got["A2"].INV_CAPACITY == 0.0 and got["A3"].TRANSFORMER_CODE == "TF002" and got["A3"].PHASE == "SP"


def test_month_files_follow_the_manifest(spark, tmp_path):
    (tmp_path / "sep.csv").write_text("ACCOUNT_NO,Import Total,Export Total\nA1,100,5\n")
    (tmp_path / "oct.csv").write_text("ACCOUNT_NO,Import Total,Export Total\nA1,oops,1\n")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "sep.csv").write_text("Export Total,Import Total, Account No\n7,70,A1\n")      # same name, other order
    (tmp_path / "b" / "bad.csv").write_text("x,y\n1,2\n")
    files = [str(tmp_path / f) for f in ("sep.csv", "oct.csv", "b/sep.csv", "b/bad.csv")]
    man = spark.createDataFrame([(files[0], "TF1", 9, 2025), (files[1], "TF1", 10, 2025), (files[2], "TF2", 9, 2025), (files[3], "TF2", 10, 2025)],
                                "path string, TRANSFORMER_CODE string, MONTH int, YEAR int")
    got = {(r.TRANSFORMER_CODE, r.MONTH): (r.ACCOUNT_NO, r.IMPORT_kWh, r.EXPORT_kWh, r.problem) for r in RD.read_month_files(spark, man, files).collect()}
    assert got == {("TF1", 9): ("A1", 100.0, 5.0, None), ("TF1", 10): ("A1", None, 1.0, None), ("TF2", 9): ("A1", 70.0, 7.0, None), ("TF2", 10): (None, None, None, "no account column")}


def test_customer_sheets_with_other_headers(spark, tmp_path):
    (tmp_path / "TF001.csv").write_text("Account No,Inv Capacity,Tariff\nA1,5,D1\n")
    (tmp_path / "TF002.csv").write_text("Tariff,Inv Capacity,Account No\nGP1,3,A2\n")
    (tmp_path / "TF003.csv").write_text("Account No,Phase\nA3,TP\n")
    got = {r.ACCOUNT_NO: (r.TRANSFORMER_CODE, r.INV_CAPACITY, r.CAL_TARIFF, r.PHASE) for r in RD.read_customer_sheets(spark, str(tmp_path)).collect()}
    assert got == {"A1": ("TF001", 5.0, "D1", "SP"), "A2": ("TF002", 3.0, "GP1", "SP"), "A3": ("TF003", 0.0, "D1", "TP")}


def test_sheets_told_by_their_content(spark, tmp_path):
    """Two files of one header differ in which column is numeric; blanks do not count; lost sheets are reported."""
    (tmp_path / "TF001.csv").write_text("Account No,Remark,A,B,Tariff\n100,x,,4,D1\n101,y,oops,0,GP1\n")
    (tmp_path / "TF002.csv").write_text("Account No,Remark,A,B,Tariff\n102,x,2.5,9,D1\n103,y,,8,D1\n")
    (tmp_path / "TF003.csv").write_text("Account No,Remark\nA9,z\n")
    (tmp_path / "TF004.csv").write_text("Customer,Inv Capacity\nA1,5\n")
    rows = RD.read_customer_sheets(spark, str(tmp_path)).collect()
    got = {r.ACCOUNT_NO: (r.TRANSFORMER_CODE, r.INV_CAPACITY, r.HAS_SOLAR, r.problem) for r in rows}
    assert got == {"100": ("TF001", 4.0, 1, None), "101": ("TF001", 0.0, 0, None), "102": ("TF002", 2.5, 1, None), "103": ("TF002", 0.0, 0, None),
                   "A9": ("TF003", 0.0, 0, None), None: ("TF004", None, None, "no account column")} and len(rows) == 6


def test_bad_month_entries_are_left_out(spark):
    one = spark.range(1)
    assert one.select(RD.parse_month_text(F.lit("oct:1, 9:5, 9:7,, 11:x,"))).first()[0] == {9: 7.0}
    months = F.create_map(F.lit("9:2024"), F.lit(1.0), F.lit("9:2025"), F.lit(2.0), F.lit("x"), F.lit(3.0))
    assert one.select(RD.month_keys(months)).first()[0] == {9: 2.0}


def test_price_node_with_inner_tags(spark):
    page = spark.createDataFrame([(1, "https://shop/5kw-system", '<p class="price"><span class="c2" data-id="77">Rs750,000</span></p>')], "page_id int, url string, html string")
    assert [(r.size_kw, r.price_lkr) for r in RD.vendor_page_prices(page).where("rule = 'price_node'").collect()] == [(5, 750000)]


def test_requests_and_month_keys(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"user_id": 1, "latitude": 6.9, "longitude": 79.9, "consumption_months": {"9:2025": 350.5, "10": 420.2, "x": 1.0}}) + "\n")
    r = RD.read_requests(spark, str(tmp_path / "r.json")).first()
    assert r.consumption_months == {9: 350.5, 10: 420.2}
    assert spark.range(1).select(RD.parse_month_text(F.lit("9:350.5, 10:420.2"))).first()[0] == {9: 350.5, 10: 420.2}


def test_market_document_and_defaults(spark, tmp_path):
    doc = {"pricing_database": {"5": 800000}, "vendors": [{"Name": "V", "rating": 4.5, "pricing": {"3": 1.0, "3.5": 2.0}}], "tariffs": {"base_import_tariff": 45.0, "discount_rate": 0.11}}
    (tmp_path / "m.json").write_text(json.dumps(doc, indent=1))
    m = RD.read_market(spark, str(tmp_path / "m.json"))
    assert m["prices"].first().size_kw == 5.0 and {r.size_kw for r in m["vendors"].collect()} == {3.0, 3.5} and m["tariffs"].first().discount_rate == 0.11
    assert RD.read_market(spark, None)["prices"].count() == 6


def test_discount_rate(spark):
    doc = '[{"page":1},[{"date":"2024","value":null},{"date":"2023","value":6.5},{"date":"2022","value":40.0}]]'
    r = RD.discount_rate(spark.createDataFrame([(1, doc)], "k int, d string"), "d", ["k"]).first()
    assert r.inflation_pct == 6.5 and r.discount_rate == pytest.approx(0.11)


def test_price_events_as_the_rules_say(spark):
    """Whole sizes only; a range on the line of its size; what stands first decides; case and dashes do not matter."""
    pages = [(1, "http://a", "15kW kit STARTING FROM Rs 900,000 then 5KW pack starting from\nRs. 810,000 and 5kW starting from Rs 700,000"),
             (2, "http://b", "8kW system\nLKR 1,400,000 - 1,500,000. 8kW System now LKR 1,500,001 – 1,600,000 (10kW system LKR 1,000,000-1,200,000)"),
             (3, "http://c", "3kW starting at Rs. 500,000, 3kW <i>starting</i> from LKR 400,000 - 450,000"), (4, None, None), (5, "http://x/10kw-set", "no price"), (6, "http://x", "")]
    got = {(r.page_id, r.size_kw, r.rule, r.price_lkr) for r in RD.vendor_page_prices(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {(1, 15, "starting_from", 900000), (1, 5, "starting_from", 810000), (2, 8, "price_range", 1550000), (2, 10, "price_range", 1100000)}


def test_page_prices_use_the_whole_text(spark):
    filler = "x " * 50_000
    pages = [(1, "http://a/8kw-kit", '<p class="price">LKR 1,450,000.00</p>'), (2, "http://b", filler + "<b>5kW</b> hybrid starting from Rs. 820,000 only"),
             (3, "http://c", "10kW system from LKR 1,700,000 - 1,900,000. 3kW system LKR 100 - 200")]
    got = {(r.page_id, r.size_kw, r.rule, r.price_lkr) for r in RD.vendor_page_prices(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {(1, 8, "price_node", 1450000), (2, 5, "starting_from", 820000), (3, 10, "price_range", 1800000)}


def test_sinks_round_trip(spark, tables, tmp_path):
    r = tables("readings").withColumn("SOURCE", F.when(F.col("DATA_QUALITY") == "REAL", "REAL").otherwise("SYNTHETIC"))
    SK.write_readings(r, str(tmp_path / "t"))
    back = RD.read_readings(spark, str(tmp_path / "t"))
    assert back.count() == r.count() and "PartitionFilters: [isnotnull(SOURCE" in back.where("SOURCE = 'REAL'")._jdf.queryExecution().executedPlan().toString()
    a, b = SK.split_by_source(back)
    assert a.count() + b.count() == r.count()
    SK.write_json(r.limit(3), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    for _ in range(2):
        SK.append_log(r.select("account_id").limit(2), str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 4
    SK.write_parameters(r.select("MONTH").distinct(), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 12


def test_model_round_trip(spark, tmp_path):
    from gridlight.operators import ml
    df = spark.createDataFrame([(float(i), 2.0 * i) for i in range(40)], "x double, y double")
    model = ml.fit_models(df, ["x"], {"Ridge": ml.regressors("y")["Ridge"]})["Ridge"]
    SK.save_model(model, str(tmp_path / "m"))
    a, b = (m.transform(df).agg(F.sum("prediction")).first()[0] for m in (model, SK.load_model(str(tmp_path / "m"))))
    assert a == pytest.approx(b)


LEDGER_COLS = "account_id long, YEAR int, MONTH int, IMPORT_kWh double, EXPORT_kWh double, CAL_TARIFF string"


def test_streaming_ledger_replays_years(spark, tmp_path):
    """Months in order, out of order, twice, late, and of another year, over five runs of one query."""
    from gridlight.operators.billing import net_metering_ledger
    batches = [[(1, 2025, 1, 100.0, 150.0, "D1"), (2, 2025, 1, 10.0, 90.0, "GP1"), (2, 2025, 2, 300.0, 0.0, "GP1")], [(1, 2025, 4, 50.0, 0.0, "D1"), (1, 2025, 2, 120.0, 0.0, "D1")],
               [(1, 2026, 1, 60.0, 0.0, "D1"), (2, 2025, 2, 40.0, 0.0, "GP1"), (2, 2025, 3, 200.0, 0.0, None)], [(1, 2025, 3, 5.0, 400.0, "D1"), (None, 2025, 1, 1.0, 1.0, "D1"), (1, 2025, None, 1.0, 1.0, "D1")],
               [(1, 2026, 2, 80.0, 0.0, "D1")]]
    folder, base = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        part = spark.createDataFrame(rows, LEDGER_COLS)
        part.write.mode("append").parquet(folder)
        log = J.run_to_table(J.streaming_ledger(J.read_stream(spark, folder, part.schema)), "t", base=base, rocksdb=True)
    all_rows = [x for x in sum(batches, []) if None not in x[:3]]
    want = {(r.account_id, r.YEAR, r.month): r for r in net_metering_ledger(spark.createDataFrame(all_rows, LEDGER_COLS), ["account_id", "YEAR"]).collect()}
    got = {(r.account_id, r.YEAR, r.MONTH): r for r in J.latest_revisions(log).collect()}
    assert got.keys() == want.keys() and len(got) == 9
    for key, w in want.items():
        assert [got[key][c] for c in ("net_kwh", "bill_lkr", "credits_used", "credit_balance")] == [pytest.approx(w[c]) for c in ("net_kwh", "bill_lkr", "credits_used", "credit_balance")]
    revisions = {(r.account_id, r.YEAR): r.n for r in log.groupBy("account_id", "YEAR").agg(F.countDistinct("revision").alias("n")).collect()}
    assert revisions == {(1, 2025): 3, (1, 2026): 2, (2, 2025): 2}    # only years that changed are sent again
    # the late March earned credit that April used
    assert got[1, 2025, 4].credits_used > 0 and got[1, 2026, 1].credit_balance == 0


def test_error_monitor_drops_late_rows_and_alerts(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0 + dt.timedelta(days=d, hours=1), "a", 10.0, 10.0 - (1 + d % 2 + (8 if d >= 6 else 0))) for d in range(12)] + [(t0 + dt.timedelta(days=20), "a", 1.0, 1.0)]
    spark.createDataFrame(rows, "ts timestamp, series string, y double, p double").write.parquet(str(tmp_path / "in"))
    stream = J.read_stream(spark, str(tmp_path / "in"), "ts timestamp, series string, y double, p double")
    monitor = J.error_monitor(stream, F.col("y"), F.col("p"), keys=["series"])
    J.drift_on_batches(monitor, str(tmp_path / "d"), str(tmp_path / "cp"), ["series"]).start().awaitTermination()
    assert [(r.severity, r.start) for r in spark.read.parquet(str(tmp_path / "d/alerts")).collect()] == [("high", t0 + dt.timedelta(days=11))]


def test_drift_history_is_bounded_and_a_replayed_epoch_changes_nothing(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    schema = "start timestamp, series string, mae double, n_samples long"
    maes = [1.0, 1.2, 0.9, 1.1, 5.0, 5.5, 1.0, 1.1, 0.9, 9.0, 9.5, 1.0]
    rows = [(t0 + dt.timedelta(days=d), s, m * (1 + (s == "b")), 3) for d, m in enumerate(maes) for s in "ab"]
    folder, landed = str(tmp_path / "d"), str(tmp_path / "in")
    batch = []

    class Stream:    # hands the epoch's function out, so that an epoch can be run twice
        def __getattr__(self, name):
            return lambda *a, **k: batch.append(a[0]) or self if name == "foreachBatch" else self
    df = spark.createDataFrame(rows, schema)

    class Monitor:
        sparkSession, schema, writeStream = spark, df.schema, Stream()
    J.drift_on_batches(Monitor(), folder, landed, ["series"], window=2)
    parts = [df.where((F.col("start") >= t0 + dt.timedelta(days=a)) & (F.col("start") < t0 + dt.timedelta(days=b))) for a, b in ((0, 3), (3, 4), (4, 9), (9, 12))]
    seen = []
    for epoch, part in enumerate(parts):
        for _ in range(1 + epoch % 2):    # every second epoch is run again, as after a failure
            batch[0](part, epoch)
        seen.append(spark.read.parquet(f"{folder}/history/epoch={epoch}").groupBy("series").count().collect())
    assert all(r["count"] == 3 for rows in seen for r in rows) and J.stored_epochs(spark, f"{folder}/history") == [2, 3]
    from gridlight.operators.drift import each_drift
    want = each_drift(df, ["series"], "start", 2).where("drift_detected")
    cols = ["series", "start", "mae", "z_score", "severity"]
    got = spark.read.parquet(f"{folder}/alerts")
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect())) and got.count() > 2


def test_checkpoint_folder_comes_from_the_session(spark):
    from gridlight.session import cut_lineage, shared_folder
    df = cut_lineage(spark.range(5))
    assert df.count() == 5 and spark.sparkContext.getCheckpointDir()
    assert shared_folder(spark)


def test_month_files_of_all_years(spark, tables):
    from gridlight.catalog import files
    got = {(r.ACCOUNT_NO, r.TRANSFORMER_CODE, r.YEAR, r.MONTH): (r.import_kwh, r.export_kwh, r.problem) for r in files.month_files(tables).collect()}
    part = F.col("MONTH") % 3
    want = tables("readings").groupBy("ACCOUNT_NO", "TRANSFORMER_CODE", "YEAR", part.alias("part")).agg(F.sum("IMPORT_kWh").alias("i"), F.sum("EXPORT_kWh").alias("e")).collect()
    assert len(got) == len(want) and len({k[2] for k in got}) == len({r.YEAR for r in want}) > 1
    for r in want:
        i, e, problem = got[r.ACCOUNT_NO, r.TRANSFORMER_CODE, r.YEAR, 1 + r.part]
        assert (i, e, problem) == (pytest.approx(r.i, abs=0.0051), pytest.approx(0.0 if r.part == 2 else r.e, abs=0.0051), None)


def test_walk_forward_ends_with_a_history_of_24_months(spark):
    from gridlight.operators import splits as SP
    rows = spark.createDataFrame([(1, 2020 + m // 12, 1 + m % 12) for m in range(24)], "account_id long, YEAR int, MONTH int")
    got = {(r.fold, r.role): r["count"] for r in SP.walk_forward(rows, 5, 6).groupBy("fold", "role").count().collect()}
    assert got == {(k, role): n for k in (1, 2, 3) for role, n in (("train", 6 * k), ("test", 6))}
