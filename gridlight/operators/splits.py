"""Train / validation / test splits that never look at the data's order on one node."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gridlight.functions.calendar import time_index


def time_ranks(df: DataFrame) -> DataFrame:
    """Distinct months with their rank from 0; bounded by the length of history, not by the rows."""
    times = df.select(time_index(F.col("YEAR"), F.col("MONTH")).alias("time_idx")).distinct()
    w = Window.orderBy("time_idx")
    return times.select("time_idx", (F.row_number().over(w) - 1).alias("t"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("n_times"))


def with_time_rank(df: DataFrame) -> DataFrame:
    return df.withColumn("time_idx", time_index(F.col("YEAR"), F.col("MONTH"))).join(time_ranks(df), "time_idx")


def temporal_split(df: DataFrame, test_size: float = 0.2, val_size: float = 0.1) -> DataFrame:
    """Adds ``split`` (train, val, test) by distinct month."""
    ranked = with_time_rank(df)
    n = F.col("n_times")
    n_test, n_val = F.floor(n * test_size), F.floor(n * val_size)
    role = F.when(F.col("t") < n - n_test - n_val, "train").when(F.col("t") < n - n_test, "val").otherwise("test")
    return ranked.withColumn("split", role).drop("t", "n_times")


def account_split(df: DataFrame, test_size: float = 0.2, val_size: float = 0.1, min_rows: int = 24) -> DataFrame:
    """The same per account; accounts with fewer than ``min_rows`` rows are left out."""
    acc = Window.partitionBy("account_id")
    ranked = df.withColumns({"_i": F.row_number().over(acc.orderBy("YEAR", "MONTH")) - 1, "_n": F.count(F.lit(1)).over(acc)}).where(F.col("_n") >= min_rows)
    n_test, n_val = F.floor(F.col("_n") * test_size), F.floor(F.col("_n") * val_size)
    role = F.when(F.col("_i") < F.col("_n") - n_test - n_val, "train").when(F.col("_i") < F.col("_n") - n_test, "val").otherwise("test")
    return ranked.withColumn("split", role).drop("_i", "_n")


def _folds(df: DataFrame, folds: list[tuple[int, object, object, object]]) -> DataFrame:
    """Rows repeated per fold with their role; a fold is (number, train end, test start, test end) in month ranks."""
    ranked = with_time_rank(df)
    t = F.col("t")
    none = F.array().cast("array<struct<fold:int,role:string>>")
    cases = [F.when(t < end, F.struct(F.lit(k).alias("fold"), F.lit("train").alias("role")))
             .when((t >= start) & (t < stop), F.struct(F.lit(k).alias("fold"), F.lit("test").alias("role"))) for k, end, start, stop in folds]
    return ranked.select(*df.columns, F.explode(F.array_compact(F.array(*cases)) if cases else none).alias("_f")).select(*df.columns, "_f.fold", "_f.role")


def n_months(df: DataFrame) -> int:
    """Number of distinct months of the history."""
    return df.select(time_index(F.col("YEAR"), F.col("MONTH"))).distinct().count()


def walk_forward(df: DataFrame, n_windows: int = 5, window_size: int = 12) -> DataFrame:
    """Folds as long as there are months to test on; a history too short for ``n_windows`` has fewer."""
    n = n_months(df)
    return _folds(df, [(i + 1, (i + 1) * window_size, (i + 1) * window_size, (i + 2) * window_size) for i in range(n_windows) if (i + 1) * window_size < n])


def expanding_window(df: DataFrame, initial: int = 24, step: int = 12) -> DataFrame:
    """As many folds as whole test windows lie inside the history."""
    n_folds = max(0, (n_months(df) - initial) // step)
    return _folds(df, [(i + 1, initial + i * step, initial + i * step, initial + (i + 1) * step) for i in range(n_folds)])


def fold_split(df: DataFrame, n_splits: int = 5, gap: int = 0) -> DataFrame:
    size = F.floor(F.col("n_times") / (n_splits + 1))
    return _folds(df, [(i + 1, (i + 1) * size, (i + 1) * size + gap, (i + 2) * size) for i in range(n_splits)])


def date_split(df: DataFrame, year: int, month: int) -> DataFrame:
    return df.withColumn("split", F.when(time_index(F.col("YEAR"), F.col("MONTH")) < year * 12 + month, "train").otherwise("test"))


def group_split(df: DataFrame, test_share: float = 0.2, key: str = "account_id", seed: int = 42) -> DataFrame:
    """Whole groups go to train or test by the MD5 of their key, which any engine can repeat: no shuffle, no shared groups."""
    limit = f"{int(test_share * (1 << 32)):08x}"
    return df.withColumn("split", F.when(F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), 1, 8) < limit, "test").otherwise("train"))


def group_bucket(key: str, buckets: int, seed: int = 42):
    """Hash bucket of a group; the same key falls into the same bucket on every run and cluster."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(buckets))


def leakage(df: DataFrame, key: str = "account_id") -> DataFrame:
    """Number of keys present in more than one split (must be 0)."""
    per_key = df.groupBy(key).agg(F.min("split").alias("a"), F.max("split").alias("b"))
    return per_key.agg(F.count_if(F.col("a") != F.col("b")).alias("shared"), F.count(F.lit(1)).alias("groups"))


def hash_sample(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """A reproducible sample of ``n`` rows: the first by the MD5 of the keys (a distributed top-k, no full sort)."""
    return df.orderBy(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))), *keys).limit(n)
