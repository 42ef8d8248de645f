"""Helpers shared by the operators: input tables, written intermediate tables, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from gridlight.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared folder, for each call another one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: later steps do not repeat its work, and a lost
    executor takes nothing with it."""
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def maybe_in(rows: DataFrame, key: Column, members: DataFrame, member: Column, bits: int = 24, flag: str | None = None) -> DataFrame:
    """The rows whose hash ``key`` may be among the hashes ``member``: a bitmap of ``2 ** bits`` bits, a broadcast of fixed size,
    keeps most other rows out of the shuffle before the join that decides.  With ``flag`` all rows, marked by this column."""
    spot = lambda h: h.bitwiseAND(F.lit((1 << bits) - 1))
    word = lambda h: F.shiftright(spot(h), 6)
    mask = lambda h: F.call_function("shiftleft", F.lit(1).cast("bigint"), spot(h).bitwiseAND(F.lit(63)).cast("int"))
    marks = members.select(member.alias("_gl_h")).groupBy(word(F.col("_gl_h")).alias("_gl_word")).agg(F.bit_or(mask(F.col("_gl_h"))).alias("_gl_mask"))
    met = F.coalesce(F.col("_gl_mask").bitwiseAND(mask(key)) != 0, F.lit(False))
    joined = rows.join(F.broadcast(marks), word(key) == F.col("_gl_word"), "left" if flag else "inner")
    return joined.withColumn(flag, met).drop("_gl_word", "_gl_mask") if flag else joined.where(met).drop("_gl_word", "_gl_mask")


def map_columns(df: DataFrame, columns: list[str], fn: Callable[..., list[list]], schema: str, carry: list[str] | None = None) -> DataFrame:
    """Apply ``fn`` to the values of ``columns`` batch by batch; it returns the columns of ``schema`` as lists or Arrow arrays.

    With ``carry`` there is one row for each row of ``df``: these columns of it, untouched, then the new ones.  Rows of a
    batch are independent of those of any other batch, so a lost task is simply run again."""
    new = df.sparkSession.createDataFrame([], schema).schema
    kept = [df.schema[c] for c in carry or []]
    types, names = [to_arrow_type(f.dataType) for f in new], [f.name for f in [*kept, *new]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = fn(*(batch.column(len(kept) + i).to_pylist() for i in range(len(columns))))
            arrays = [v if isinstance(v, pa.Array) else pa.array(v, type=t) for v, t in zip(made, types)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *arrays], names=names)

    chosen = [df[f"`{f.name}`"] for f in kept] + [df[f"`{c}`"].alias(f"_gl_{i}") for i, c in enumerate(columns)]
    return df.select(*chosen).mapInArrow(run, StructType([*kept, *new]))
