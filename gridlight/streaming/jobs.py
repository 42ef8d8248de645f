"""Structured Streaming jobs over meter readings and events."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gridlight import constants as C
from gridlight.operators import billing as BL
from gridlight.operators.drift import each_drift
from gridlight.session import cut_lineage, shared_folder


def read_stream(spark: SparkSession, folder: str, schema, pattern: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession, provider: str | None) -> Iterator[None]:
    """Queries started inside keep their state in ``provider``; the session's setting is as before afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    if provider:
        spark.conf.set(name, provider)
    try:
        yield
    finally:
        if provider and before is None:
            spark.conf.unset(name)
        elif provider:
            spark.conf.set(name, before)


def new_base(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, name: str, mode: str = "append", base: str | None = None, rocksdb: bool = False) -> DataFrame:
    """Process everything available and return what was written.

    Output and checkpoint live in the shared folder (``base``, by default a new one), so a query that is run again with the
    same ``base`` goes on exactly where it stopped.
    """
    spark = stream.sparkSession
    base = base or new_base(spark, name)
    with state_store(spark, ROCKSDB if rocksdb else None):
        query = (stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/checkpoint")
                 .option("path", f"{base}/out").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_to_end(job: Callable[[DataFrame], DataFrame], stream: DataFrame, rows: DataFrame, name: str, span: str | None, lateness: str = "2 days", key: str | None = None) -> DataFrame:
    """A bounded run to the last event: what the stream finalised, then the windows the watermark still holds open.

    The second part is the same ``job`` over the ``rows`` that can lie in such a window: those of the last ``span`` before
    the watermark, or, for windows without a fixed length, those of the keys with an event since then.
    """
    done = run_to_table(job(stream), name)
    mark = rows.agg((F.max("ts") - F.expr(f"INTERVAL {lateness}")).alias("m")).first().m
    if mark is None:
        return done
    if span:
        last = rows.where(F.col("ts") >= F.lit(mark) - F.expr(f"INTERVAL {span}"))
    else:
        last = rows.join(rows.groupBy(key).agg(F.max("ts").alias("_last")).where(F.col("_last") >= F.lit(mark) - F.expr("INTERVAL 1 day")).select(key), key, "left_semi")
    # a written table in between: the condition must not reach the rows before sessions are put together
    return done.unionByName(cut_lineage(job(last)).where(F.col("end") > F.lit(mark)))


# ---- J1 --------------------------------------------------------------------------------

def error_monitor(events: DataFrame, actual: Column, predicted: Column, window: str = "1 day", lateness: str = "2 days", keys: list[str] | None = None) -> DataFrame:
    """MAE per tumbling window; state is one row per open window and key, late rows are bounded by the watermark."""
    rows = events.withColumn("_e", F.abs(actual - predicted)).withWatermark("ts", lateness)
    out = rows.groupBy(F.window("ts", window).alias("w"), *(keys or [])).agg(F.avg("_e").alias("mae"), F.count(F.lit(1)).alias("n_samples"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(keys or []), "mae", "n_samples")


def drift_on_batches(monitor: DataFrame, folder: str, checkpoint: str, series: list[str], window: int = C.DRIFT_WINDOW, threshold: float = C.DRIFT_THRESHOLD):
    """Drift of every finished window against the windows before it, epoch by epoch; start the returned writer.

    ``folder/alerts`` gets the alerts of each epoch.  ``folder/history`` holds the last ``2 * window - 1`` windows of every series,
    which is all that later windows are compared with, as one folder an epoch: an epoch reads the one before it and replaces
    its own, so an epoch that is run again after a failure changes nothing, and older ones are deleted.
    """
    spark = monitor.sparkSession
    schema = monitor.schema
    keep = 2 * window - 1
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/history/epoch=-1")

    def batch(df: DataFrame, epoch: int) -> None:
        session = df.sparkSession
        before = max(e for e in stored_epochs(session, f"{folder}/history") if e < epoch)
        new = df.withColumn("_new", F.lit(True))
        old = session.read.schema(schema).parquet(f"{folder}/history/epoch={before}").withColumn("_new", F.lit(False))
        both = cut_lineage(old.unionByName(new))
        judged = each_drift(both, series, "start", window, threshold)
        judged.where("_new AND drift_detected").drop("_new").write.mode("overwrite").parquet(f"{folder}/alerts/epoch={epoch}")
        rank = F.row_number().over(Window.partitionBy(*series).orderBy(F.col("start").desc()))
        both.withColumn("_rank", rank).where(F.col("_rank") <= keep).select(*schema.names).write.mode("overwrite").parquet(f"{folder}/history/epoch={epoch}")
        for e in stored_epochs(session, f"{folder}/history"):
            if e < before:    # the one before stays: this epoch may be run again
                drop_folder(session, f"{folder}/history/epoch={e}")
    return monitor.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True)


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def stored_epochs(spark: SparkSession, folder: str) -> list[int]:
    fs, path = _file_system(spark, folder)
    names = [f.getPath().getName() for f in fs.listStatus(path)]
    done = [n for n in names if n.startswith("epoch=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    return sorted(int(n.removeprefix("epoch=")) for n in done)


def drop_folder(spark: SparkSession, folder: str) -> None:
    fs, path = _file_system(spark, folder)
    fs.delete(path, True)


# ---- J2 --------------------------------------------------------------------------------

MONTHS = "array<struct<MONTH:int,t:string,c:double,g:double>>"


class YearMonths(StatefulProcessor):
    """Keeps the summed months of every year of an account and sends each year that has changed, whole.

    State: a map from year to its months (a few numbers a month) and the number of the last revision.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.years = handle.getMapState("years", "YEAR int", f"months {MONTHS}")
        self.revision = handle.getValueState("revision", "n bigint")

    def handleInputRows(self, key, rows, timerValues):
        changed = {}
        for r in rows:
            if r.YEAR not in changed:
                stored = self.years.getValue((r.YEAR,)) if self.years.containsKey((r.YEAR,)) else ([],)
                changed[r.YEAR] = {(m[0], m[1]): (m[2], m[3]) for m in stored[0]}
            months, at = changed[r.YEAR], (r.MONTH, r.CAL_TARIFF)
            c, g = months.get(at, (0.0, 0.0))
            months[at] = (c + r.IMPORT_kWh, g + r.EXPORT_kWh)
        n = (self.revision.get()[0] if self.revision.exists() else 0) + 1
        self.revision.update((n,))
        for year, months in changed.items():
            whole = sorted(((month, t, c, g) for (month, t), (c, g) in months.items()), key=lambda m: (m[0], m[2], m[3]))    # as in the batch ledger
            self.years.updateValue((year,), (whole,))
            yield Row(account_id=key[0], YEAR=year, revision=n, months=whole)

    def close(self) -> None:
        pass


def streaming_ledger(readings: DataFrame) -> DataFrame:
    """Net-metering ledger as months arrive, in any order: a late month, or a second reading of a month, replays its year.

    The state only collects months; bills and balances of a changed year are worked out in columns, by the same
    fold as the batch ledger.  Each change gives all rows of the year again under a higher ``revision`` of the account;
    ``latest_revisions`` keeps the valid ones.  Readings of a month are added up, so double months count like in the batch
    ledger; readings without account, year, month or amounts belong to no month and are left out.  The job needs the
    RocksDB state store (``run_to_table(..., rocksdb=True)``).
    """
    whole = readings.dropna(subset=["account_id", "YEAR", "MONTH", "IMPORT_kWh", "EXPORT_kWh"]).select("account_id", "YEAR", "MONTH", "IMPORT_kWh", "EXPORT_kWh", "CAL_TARIFF")
    years = whole.groupBy("account_id").transformWithState(YearMonths(), f"account_id long, YEAR int, revision long, months {MONTHS}", "append", "none")
    terms = lambda m: F.struct(m["MONTH"].alias("MONTH"), m["c"].alias("c"), m["g"].alias("g"), *[x.alias(n) for n, x in BL.month_terms(m["c"], m["g"], m["t"]).items()])
    rows = years.select("account_id", "YEAR", "revision", F.inline(BL.ledger_rows(F.transform("months", terms))))
    return rows.select("account_id", "YEAR", F.col("month").alias("MONTH"), "net_kwh", "bill_lkr", "credits_used", "credit_balance", "revision")


def latest_revisions(log: DataFrame) -> DataFrame:
    """The valid rows of the ledger's log: those of the last revision of each account and year."""
    last = F.max("revision").over(Window.partitionBy("account_id", "YEAR"))
    return log.withColumn("_last", last).where(F.col("revision") == F.col("_last")).drop("revision", "_last")


# ---- J3 --------------------------------------------------------------------------------

def quality_counters(events: DataFrame, value: str = "value", lo: float = 0.0, hi: float = 100.0, window: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """Nulls, negatives and out-of-range values per window."""
    v = F.col(value)
    out = events.withWatermark("ts", lateness).groupBy(F.window("ts", window).alias("w")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(v.isNull()).alias("nulls"), F.count_if(v < 0).alias("negatives"), F.count_if(~v.between(lo, hi)).alias("out_of_range"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rows", "nulls", "negatives", "out_of_range")


# ---- J4 --------------------------------------------------------------------------------

def sliding_profile(events: DataFrame, key: str = "user_id", window: str = "7 days", slide: str = "1 day", lateness: str = "2 days") -> DataFrame:
    out = events.withWatermark("ts", lateness).groupBy(F.window("ts", window, slide).alias("w"), key).agg(F.sum("value").alias("total"), F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "total", "mean", "n")


def session_profile(events: DataFrame, key: str = "user_id", gap: str = "6 hours", lateness: str = "2 days") -> DataFrame:
    out = events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "total", "n")
