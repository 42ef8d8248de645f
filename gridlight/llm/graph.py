"""Connected components as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlight.llm.tables import written


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id of the component of every id in ``edges`` (a, b).

    Every round takes the smallest label among neighbours and then the label of that label, so chains shorten by half;
    edges whose ends already agree leave, so later rounds are small.  Each round is a written table."""
    both = edges.where(F.col("a") != F.col("b")).select("a", "b").union(edges.where(F.col("a") != F.col("b")).select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = written(both.distinct(), "links")
    labels = written(links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "id"), "labels")
    while True:
        jump = labels.select(F.col("id").alias("root"), F.col("root").alias("up"))
        labels = written(labels.join(jump, "root", "left").select("id", F.least("root", F.coalesce("up", "root")).alias("root")), "labels")
        ends = labels.select(F.col("id").alias("a"), F.col("root").alias("ra"))
        others = labels.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        # an edge now stands for the edge between the labels of its ends
        links = written(links.join(ends, "a").join(others, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links")
        if links.isEmpty():
            break
        lower = links.groupBy("a").agg(F.min("b").alias("low")).where("low < a").select(F.col("a").alias("root"), "low")
        labels = written(labels.join(lower, "root", "left").select("id", F.least("root", F.coalesce("low", "root")).alias("root")), "labels")
    # labels of labels until nothing changes
    while True:
        jump = labels.select(F.col("id").alias("root"), F.col("root").alias("up"))
        moved = labels.join(jump, "root", "left").select("id", F.coalesce("up", "root").alias("up"), "root")
        if moved.where("up <> root").isEmpty():
            return labels
        labels = written(moved.select("id", F.col("up").alias("root")), "labels")
