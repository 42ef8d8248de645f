"""The corpus pipeline: five stages over ``documents``, each over all that the one before it has kept.

Every stage but the last returns the columns of documents; the last returns the token ids of the texts that remain.  Stages
keep rows with null ids and empty texts, repeated rows and further columns; a stage's own columns begin with ``_gl_``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlight.llm import contamination, lines, near, tokenize, toxicity
from gridlight.llm.catalog import VOCABULARY, held_out_quarter
from gridlight.llm.tables import table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.3 or more go.  The model is fitted as in op4_toxicity, on ``docs``."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out_quarter()))
    return toxicity.scores(docs, model, docs.columns, name="_gl_score").where(F.col("_gl_score") < 0.3).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go; a document of which nothing but white space is left goes as a whole."""
    done = lines.without_repeats(docs)
    return done.where((F.col("_words_removed") == 0) | (F.btrim("text", F.lit(" \t\n\x0b\x0c\r")) != "")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return near.representatives(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of ten words of a benchmark item go."""
    found = contamination.find_items(docs, table(spark, sf_dir, "benchmark"), carry=docs.columns, prefix="_gl_")
    return found.where(F.size("_gl_hit") == 0).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and digests of the ids and of the text decoded from them."""
    return tokenize.encoded_digests(docs, public_tokenizers.path(VOCABULARY), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage), ("line_dedup", line_dedup_stage), ("near_duplicates", near_duplicate_stage), ("decontamination", decontamination_stage), ("encoding", encoding_stage)]

# Trained scores and token ids have no SQL form; tests hold every stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are a written table before the next begins."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
