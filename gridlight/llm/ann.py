"""Largest inner products by an inverted-list index whose lists are read dimension block by dimension block.

Vectors get one more component, so that all have the norm of the longest one; then the largest inner product is the
smallest distance.  They are rotated at random and stored in lists of their nearest centroids.  In a probed list a candidate
is given up as soon as its distance over the first blocks of rotated dimensions, scaled up, exceeds by a hypothesis test the
distance of a vector already known to be good: one a little behind the query's k-th best in a bounded sample.  Those that last to the end are scored on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridlight.llm.near import bounds, groups
from gridlight.llm.tables import written

STEP = 16    # rotated dimensions per block
SURE = 2.1   # width of the test: larger gives fewer false rejections


@dataclass
class Index:
    """Rotation, centroids, the common norm, and how many lists a query reads; fitted on a bounded sample."""

    rotation: np.ndarray
    centroids: np.ndarray
    norm: float
    probes: int
    sample: np.ndarray

    def lifted(self, x: np.ndarray, candidate: bool) -> np.ndarray:
        """Vectors with one more component, rotated; queries get 0 there."""
        more = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0)) if candidate else np.zeros(len(x))
        return np.hstack([x, more[:, None]]) @ self.rotation

    def nearest_lists(self, y: np.ndarray, n: int) -> np.ndarray:
        far = (self.centroids**2).sum(1)[None, :] - 2 * y @ self.centroids.T
        return np.argpartition(far, min(n, far.shape[1]) - 1, axis=1)[:, :n] if n < far.shape[1] else np.tile(np.arange(far.shape[1]), (len(y), 1))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>) of the vectors that take part: an id, and finite components of which one is not 0."""
    v = F.col(vector_col).cast("array<double>")
    good = F.col(id_col).isNotNull() & v.isNotNull() & F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).alias("id"), v.alias("v"))


def rows_of(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def fit(rows: DataFrame, k: int, sample_rows: int, recall: float, seed: int = 11) -> Index | None:
    """The index from about ``sample_rows`` rows drawn at random; probes are as many as the sample needs for ``recall``."""
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("norm"), F.max(F.size("v")).alias("width"), F.min(F.size("v")).alias("least")).first()
    if not facts.n:
        return None
    if facts.width != facts.least:
        raise ValueError("vectors of different lengths")
    share = min(1.0, sample_rows / facts.n)
    taken = rows.where(F.rand(seed) < share).select("v") if share < 1 else rows.select("v")
    x = np.array([r.v for r in taken.collect()], float).reshape(-1, facts.width)    # about sample_rows at most
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.normal(size=(facts.width + 1, facts.width + 1)))[0]
    index = Index(rotation, np.zeros((1, facts.width + 1)), float(facts.norm), 1, x[:0])
    y = index.lifted(x, True)
    lists = int(np.clip(round(np.sqrt(facts.n)), 1, max(1, len(x) // 16)))
    centroids = y[rng.choice(len(y), lists, replace=False)].copy() if lists < len(y) else y.copy()
    for _ in range(12):
        index.centroids = centroids
        own = index.nearest_lists(y, 1)[:, 0]
        size = np.bincount(own, minlength=lists)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, y)
        centroids = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centroids)
    index.centroids = centroids
    own = index.nearest_lists(y, 1)[:, 0]
    asked = rng.choice(len(x), min(len(x), 256), replace=False)
    scores = x[asked] @ x.T
    best = np.argsort(-scores, axis=1)[:, :k + 1]
    far = (centroids**2).sum(1)[None, :] - 2 * index.lifted(x[asked], False) @ centroids.T
    rank = np.argsort(np.argsort(far, axis=1), axis=1)
    needed = np.sort(np.take_along_axis(rank, own[best], axis=1).ravel())
    index.probes = int(min(lists, needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))] + 1))
    index.sample = x
    return index


def scan(q: np.ndarray, bound: np.ndarray, y: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) pairs that the tests leave, given the squared distance ``bound`` for every query.

    All pairs meet in the first block of dimensions; each further block is read for those that are left.  ``slack`` stands
    for rounding, so that equal vectors are kept or given up together."""
    width = y.shape[1]
    first = min(STEP, width)
    test = lambda distance, limit, b: distance * (width / b) <= limit * (1 + SURE / np.sqrt(b)) ** 2 + slack if b < width else distance <= limit + slack
    far = (q[:, :first] ** 2).sum(1)[:, None] + (y[:, :first] ** 2).sum(1)[None, :] - 2 * q[:, :first] @ y[:, :first].T
    who, what = np.nonzero(test(far, bound[:, None], first))
    distance = far[who, what]
    for a in range(first, width, STEP):
        b = min(a + STEP, width)
        distance = distance + ((y[what, a:b] - q[who, a:b]) ** 2).sum(1)
        keep = test(distance, bound[who], b)
        who, what, distance = who[keep], what[keep], distance[keep]
    return who, what


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.96, sample_rows: int = 16_000, block: int = 4096,
           id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the ``k`` vectors of largest inner product found for every row of ``queries``, its own id
    left out, ties to the smaller id.

    Null ids and vectors, vectors of zeros and those with null or non-finite components take no part on either side.  Rows
    repeated in id and vector count once; one id with two vectors is a candidate with each.  A list with many vectors, equal
    ones too, is dealt in blocks.  Other columns are left out; empty tables give an empty result."""
    spark = vectors.sparkSession
    schema = f"query_id {vectors.schema[id_col].dataType.simpleString()}, id {vectors.schema[id_col].dataType.simpleString()}, score double"
    rows, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    index = fit(rows, k, sample_rows, recall)
    if index is None:
        return spark.createDataFrame([], schema).withColumn("rank", F.lit(0)).select("query_id", "rank", "id", "score")
    shared = spark.sparkContext.broadcast(index)    # the sample, the centroids and the rotation: all bounded
    width = index.rotation.shape[0] - 1

    def to_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                own = shared.value.nearest_lists(shared.value.lifted(rows_of(part.column(1), width), True), 1)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), part.column(0), part.column(1)], names=["list", "id", "v"])

    id_kind = rows.schema["id"].dataType.simpleString()
    stored = written(rows.mapInArrow(to_lists, f"list int, id {id_kind}, v array<double>"), "lists")
    sizes = written(stored.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")), "sizes")
    keys = ["list", "block"]

    def to_probes(batches: Iterator[pa.RecordBatch], first_pass: bool) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = rows_of(part.column(1), width)
                lists = index.nearest_lists(index.lifted(x, False), index.probes if first_pass else len(index.centroids))
                scores = x @ index.sample.T
                # a somewhat lower place than the k-th in the sample, as some lists are not read and the query may be in it
                some = k + k // 2 + 1
                kth = np.partition(scores, -some, axis=1)[:, -some] if len(index.sample) >= some else np.full(len(x), -np.inf)
                bound = (x * x).sum(1) + index.norm**2 - 2 * kth if first_pass else np.full(len(x), np.inf)
                n = lists.shape[1]
                take = pa.array(np.repeat(np.arange(len(x)), n))
                yield pa.RecordBatch.from_arrays([pa.array(lists.ravel(), pa.int32()), part.column(0).take(take), part.column(1).take(take), pa.array(np.repeat(bound, n))],
                                                 names=["list", "id", "v", "bound"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in groups(batches, [0, 1]):
            lists, block_no, side = (batch.column(i).to_numpy() for i in range(3))
            cut = bounds(lists, block_no)
            for at, to in zip(cut[:-1], cut[1:]):
                first = at + int((side[at:to] == 0).sum())
                if first in (at, to):
                    continue
                ids, x = batch.column(3).slice(at, first - at), rows_of(batch.column(4).slice(at, first - at), width)
                y = index.lifted(x, True)
                names, z = batch.column(3).slice(first, to - first), rows_of(batch.column(4).slice(first, to - first), width)
                limit = batch.column(5).slice(first, to - first).to_numpy()
                own, asked_for = np.array(ids.to_pylist()), np.array(names.to_pylist())
                _, order = np.unique(own, return_inverse=True)
                out = [[], [], []]
                for start in range(0, len(z), 256):
                    who, what = scan(index.lifted(z[start:start + 256], False), limit[start:start + 256], y, 1e-9 * max(index.norm, 1e-300) ** 2)
                    who = who + start
                    other = np.array(own[what] != asked_for[who], bool)
                    who, what = who[other], what[other]
                    score = (x[what] * z[who]).sum(1)
                    best = np.lexsort((order[what], -score, who))    # of equal scores the smaller ids first
                    who, what, score = who[best], what[best], score[best]
                    fresh = np.concatenate(([True], (who[1:] != who[:-1]) | (order[what[1:]] != order[what[:-1]]) | (score[1:] != score[:-1])))[:len(who)]
                    who, what, score = who[fresh], what[fresh], score[fresh]
                    place = np.arange(len(who)) - np.searchsorted(who, who)
                    top = place < k
                    out[0].append(names.take(pa.array(who[top])))
                    out[1].append(ids.take(pa.array(what[top])))
                    out[2].append(score[top])
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(out[0]), pa.concat_arrays(out[1]), pa.array(np.concatenate(out[2]))], names=["query_id", "id", "score"])

    def found_for(asked: DataFrame, first_pass: bool) -> DataFrame:
        """Each block of a list meets the queries that probe the list."""
        probes = asked.mapInArrow(lambda batches: to_probes(batches, first_pass), f"list int, id {id_kind}, v array<double>, bound double")
        own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        members = stored.join(sizes, "list").select("list", own.alias("block"), F.lit(0).alias("side"), "id", "v", F.lit(None).cast("double").alias("bound"))
        asking = probes.join(sizes, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"), "id", "v", "bound")
        near = members.unionByName(asking).repartition(*keys).sortWithinPartitions(*keys, "side", "id").mapInArrow(probe, schema)
        order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return written(near.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score"), "nearest")

    found = found_for(asked, True)
    # queries whose lists held fewer than k candidates read all lists without a bound
    few = asked.join(found.where(F.col("rank") == k).select(F.col("query_id").alias("id")).distinct(), "id", "left_anti")
    few = written(few, "few")
    if few.isEmpty():
        return found
    return found.join(few.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(found_for(few, False))
