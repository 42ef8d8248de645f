"""Importance resampling of documents towards a target set, by hashed word n-grams.

Runs of one to three words fall into a fixed number of buckets.  One pass over all texts counts the buckets of either side, an
array of their log ratios (the gains, the only thing sent to the tasks) weighs every document in a second pass, and a
draw without replacement keeps the largest ``weight + Gumbel noise``.  The cutoff is found without a sort of all scores: a
quantile sketch proposes a bracket around its rank, exact counts of what lies outside tell whether the bracket holds it, a bracket
that does not is widened, one that does is narrowed in the same way until it is small, and only what is left is sorted.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridlight.llm.contamination import NORMAL
from gridlight.llm.tables import map_columns, written

BUCKETS = 10_000
SEGMENT = 1 << 20


def feature_buckets(text: str | None, buckets: int = BUCKETS, segment: int = SEGMENT) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the runs of one, two and three words that end with them), by segments of about ``segment`` bytes of a text.

    The checksum of a run goes on from that of the run without its last word, so two numbers join one segment to the next."""
    data = (text or "").encode().translate(NORMAL)
    last_one, last_two = [], []    # at most one element each
    at = 0
    while at < len(data):
        stop = data.find(b" ", at + segment)
        stop = len(data) if stop < 0 else stop
        words, at = data[at:stop].split(), stop
        if words:
            spaced = [b" " + w for w in words]
            one = list(map(crc32, words))
            two = list(map(crc32, spaced[1 - len(last_one):], [*last_one, *one]))
            three = list(map(crc32, spaced[2 - len(last_one) - len(last_two):], [*last_two, *two]))
            last_one, last_two = one[-1:], two[-1:] or last_two
            yield len(words), np.array(one + two + three, np.uint32) % buckets


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many runs of all texts fall into each bucket; a task sends one row a bucket at most."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, found in feature_buckets(text.as_py(), buckets):
                    total += np.bincount(found, minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], names=["bucket", "n"])

    return texts.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """``floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets))))`` of each bucket: s of S runs of ``docs``, t of T of ``target``."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for side, texts, col in ((s, docs, text_col), (t, target, target_col)):
        for r in bucket_counts(texts, col, buckets).collect():    # one row a bucket at most, whatever the tables hold
            side[r.bucket] = r.n
    all_s, all_t = int(s.sum()), int(t.sum())
    ratio = (t + 1.0) * float(all_s + buckets) / ((s + 1.0) * float(all_t + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, carry: list[str], text_col: str = "text", prefix: str = "") -> DataFrame:
    """The columns ``carry`` and n_words, n_features and weight, the sum of the gains of a text's runs."""
    gained = docs.sparkSession.sparkContext.broadcast(gain)    # one number a bucket

    def run(texts):
        rows = []
        for text in texts:
            n = features = weight = 0
            for words, found in feature_buckets(text, len(gained.value)):
                n, features, weight = n + words, features + len(found), weight + int(gained.value[found].sum())
            rows.append((n, features, weight))
        return [list(c) for c in zip(*rows)] if rows else [[], [], []]

    return map_columns(docs, [text_col], run, f"{prefix}n_words bigint, {prefix}n_features bigint, {prefix}weight bigint", carry)


def noise(key: Column, seed: int) -> Column:
    """``floor(1000 * Gumbel)`` from the SHA-256 of the seed and the key alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def bracketed(values: DataFrame, rank: int, margin: float = 0.005, sort_rows: int = 100_000) -> tuple[int, int]:
    """(value, how many are larger): the ``rank``-th largest, from 1, of the one bigint column of ``values``.

    ``low`` and ``high`` are exclusive bounds that exact counts have proved; both are taken out of the rest, so every proved
    bracket, however many ties it holds, is smaller than the one before."""
    x = F.col(values.columns[0])
    above, inside, wide = 0, values.count(), margin
    while inside > sort_rows:
        place = 1 - (rank - above - 0.5) / inside
        ends = [max(0.0, place - wide), min(1.0, place + wide)]
        low, high = values.agg(F.percentile_approx(x, ends, int(10 / margin)).alias("p")).first().p if wide < 1 else values.agg(F.min(x), F.max(x)).first()
        over, at_high, between, at_low = values.agg(F.count_if(x > high), F.count_if(x == high), F.count_if((x > low) & (x < high)), F.count_if(x == low)).first()
        r = rank - above
        if r <= over or r > over + at_high + (low != high) * (between + at_low):
            wide *= 4    # not in the bracket: the sketch was off by more than the margin
        elif r <= over + at_high:
            return high, above + over
        elif r > over + at_high + between:
            return low, above + over + at_high + between
        else:
            values, above, inside, wide = values.where((x > low) & (x < high)), above + over + at_high, between, margin
    top = values.orderBy(x.desc()).limit(rank - above)
    value = top.agg(F.min(x)).first()[0]
    return value, above + values.where(x > value).count()


def ranked(drawn: DataFrame, order: list[Column], score: str, n: int, bucket_rows: int = 100_000) -> DataFrame:
    """``drawn`` with ``_gl_rank`` by ``order``, which begins with the falling ``score``: buckets of scores hold about ``bucket_rows``
    rows each, are counted, and numbered inside."""
    parts = min(10_000, max(16, n // bucket_rows))
    cuts = drawn.agg(F.percentile_approx(F.col(score), [i / parts for i in range(1, parts)], 10 * parts).alias("p")).first().p or []
    splits = [-float("inf"), *sorted({float(c) for c in cuts}), float("inf")]
    cut = Bucketizer(splits=splits, inputCol="_gl_score", outputCol="_gl_bucket").transform(drawn.withColumn("_gl_score", F.col(score).cast("double")))
    sizes = cut.groupBy("_gl_bucket").agg(F.count(F.lit(1)).alias("_gl_n"))
    before = W.partitionBy(F.lit(0)).orderBy(F.col("_gl_bucket").desc()).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_gl_bucket", F.coalesce(F.sum("_gl_n").over(before), F.lit(0)).alias("_gl_before"))    # at most ``parts`` rows
    inside = F.row_number().over(W.partitionBy("_gl_bucket").orderBy(*order))
    placed = cut.withColumn("_gl_in", inside).join(F.broadcast(offsets), "_gl_bucket")
    return placed.withColumn("_gl_rank", F.col("_gl_in") + F.col("_gl_before")).select(*drawn.columns, "_gl_rank")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42, buckets: int = BUCKETS, carry: list[str] | None = None,
              id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", prefix: str = "", sort_rows: int = 100_000) -> DataFrame:
    """The columns ``carry`` (doc_id) of every row and, their names behind ``prefix``, n_words, n_features, weight, score and rank.

    Of the N rows of at least ``min_words`` words, the ``floor(percent * N / 100)`` of the highest scores are drawn and have a rank from 1,
    ties to the smaller id (null last), then in any order, as such rows are alike; the rank of all others is null.  Null
    and empty texts have no words and the weight 0; a null id counts as an empty string in the noise; rows repeated are
    repeated in counts and draw; with an empty target, gains come from the target's even prior."""
    spark, carry = docs.sparkSession, carry or [id_col]
    gain = gains(docs, target, text_col, target_col, buckets)
    keyed = docs.withColumn("_gl_id", F.col(f"`{id_col}`"))
    scored = weights(keyed, gain, [*carry, "_gl_id"], text_col, "_gl_")
    scored = written(scored.withColumn("_gl_score", F.col("_gl_weight") + noise(F.col("_gl_id"), seed)), "scored")
    able = scored.where(F.col("_gl_n_words") >= min_words)
    n = able.count()
    k = n * percent // 100
    final = [F.col(f"`{c}`") for c in carry] + [F.col(f"_gl_{c}").alias(prefix + c) for c in ("n_words", "n_features", "weight", "score")]
    if not k:
        return scored.select(*final, F.lit(None).cast("bigint").alias(f"{prefix}rank"))
    cut, larger = bracketed(able.select("_gl_score"), k, sort_rows=sort_rows)
    score, own = F.col("_gl_score"), F.col("_gl_id")
    chosen = (score > cut) | (score == cut)
    ties = able.where(score == cut)
    if k - larger < (with_id := ties.where(own.isNotNull()).count()):    # among ties the smallest ids; their rank from the top by negation
        last, _ = bracketed(ties.where(own.isNotNull()).select((-own.cast("bigint")).alias("id")), k - larger, sort_rows=sort_rows)
        chosen = (score > cut) | (score == cut) & (own <= -last)
    elif k - larger == with_id:
        chosen = (score > cut) | (score == cut) & own.isNotNull()
    drawn = F.coalesce((F.col("_gl_n_words") >= min_words) & chosen, F.lit(False))
    top = ranked(scored.where(drawn), [score.desc(), own.asc_nulls_last()], "_gl_score", k)
    rank = F.when(F.col("_gl_rank") <= k, F.col("_gl_rank")).cast("bigint").alias(f"{prefix}rank")
    rest = scored.where(~drawn).withColumn("_gl_rank", F.lit(None).cast("bigint"))
    return top.unionByName(rest).select(*final, rank)
