"""Equi-join that stays even when one key holds a large share of either side."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def dealt(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, left_rows: int, right_rows: int,
          tasks: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with shards of their hot keys, dealt by key and shard over ``tasks`` tasks, and the columns to meet on.

    A key with ``n`` left and ``m`` right rows has ``ceil(n / left_rows) * ceil(m / right_rows)`` shards: left rows take
    one of the left shards by a hash of ``left_id`` and are copied to every right
    shard, and the other way round, so each pair still meets exactly once.  Only
    keys above the limit are listed, and whether that list is broadcast is left
    to adaptive execution, which knows its size.  The shard depends on the row's
    id alone, so a recomputed task puts every row where it was before.

    Adaptive execution sizes tasks by the bytes they read, and a few megabytes of rows
    can hold billions of pairs, so it would leave them all to one task; hence ``tasks``.
    """
    n_left = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n_left"))
    n_right = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n_right"))
    hot = (n_left.join(n_right, keys)
           .where((F.col("_n_left") > left_rows) | (F.col("_n_right") > right_rows))
           .select(*keys, F.ceil(F.col("_n_left") / left_rows).alias("_left_shards"),
                   F.ceil(F.col("_n_right") / right_rows).alias("_right_shards")))

    def sharded(side: DataFrame, own_id: str, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        one = F.lit(1).cast("long")
        return (side.join(hot, keys, "left")
                .withColumn(own, F.pmod(F.xxhash64(own_id), F.coalesce(own_n, one)))
                .withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other_n, one) - 1)))
                .drop("_left_shards", "_right_shards"))

    l = sharded(left, left_id, "_l_shard", "_left_shards", "_r_shard", "_right_shards")
    r = sharded(right, right_id, "_r_shard", "_right_shards", "_l_shard", "_left_shards")
    on = [*keys, "_l_shard", "_r_shard"]
    return l.repartition(tasks, *on), r.repartition(tasks, *on), on


def shuffle_tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str,
              rows_per_shard: int = 8192) -> DataFrame:
    """Inner join on ``keys`` whose hot keys, of more than ``rows_per_shard`` rows on a side, are cut into shards on both sides."""
    l, r, on = dealt(left, right, keys, left_id, right_id, rows_per_shard, rows_per_shard, shuffle_tasks(left))
    return l.join(r, on).drop("_l_shard", "_r_shard")
