"""Documents whose sets of word shingles are alike (Jaccard), by chosen-path bucketing and exact counting.

1. Equal texts are folded to one; every text becomes a sketch of ``POSITIONS`` min-hashes of its shingles.
2. Chosen path: at a node of the tree a text goes down to one child for each of its min-hash tokens that the node samples,
   about 1 / similarity children, so alike texts stay together with a known probability and others part.  A node of at most
   ``small`` texts is compared by sketches; a node that its tokens no longer split is compared in blocks.  Runs are repeated
   until the bound on missed links is below ``1 - recall``.
3. Nodes give only the trees of texts that look alike, never all their pairs; their components are loose groups.
4. Inside each loose group all pairs are decided exactly, on whole shingle sets, in blocks; tasks return counts of links and
   the trees of linked texts, whose components are the classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlight.llm.graph import components
from gridlight.llm.hashes import mixed, shingles
from gridlight.llm.tables import maybe_in, written

POSITIONS = 128
FACTORS = np.random.default_rng(7).integers(1, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACES = np.arange(1, POSITIONS + 1, dtype=np.uint64) << np.uint64(40)
TEXT_HASH = "md5(cast(coalesce({0}, '') as binary))"


def sketches(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit min-hashes of every text, number of shingles)."""
    hashes, ends = shingles(texts, size)
    counts = np.diff(ends)
    out = np.zeros((len(texts), POSITIONS), np.uint32)
    full = np.flatnonzero(counts)
    if len(full):
        for j, factor in enumerate(FACTORS):
            out[full, j] = (np.minimum.reduceat(hashes * factor, ends[full]) >> np.uint64(20)) & np.uint64(0xFFFFFFFF)
    return out, counts


def arrow(batch_columns: list, names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(batch_columns, kinds)], names=names)


def packed(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    rows = np.ascontiguousarray(rows)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, kind).reshape(-1, width)


def planes(sketch: np.ndarray) -> np.ndarray:
    """Sketches as bytes: the low bytes of all positions first, then the next ones."""
    return np.ascontiguousarray(sketch, "<u4").view(np.uint8).reshape(-1, POSITIONS, 4).transpose(0, 2, 1).reshape(-1, 4 * POSITIONS)


def from_planes(column: pa.Array) -> np.ndarray:
    rows = matrix(column, 4 * POSITIONS, np.uint8).reshape(-1, 4, POSITIONS).transpose(0, 2, 1)
    return np.ascontiguousarray(rows).view("<u4").reshape(-1, POSITIONS)


def texts_with_sketches(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """One row for each different text that has words: id, text_hash, doc (smallest id), n_copies, n shingles,
    sketch (``planes`` of 32 bits a position; with fewer, unlike texts share tokens by chance as soon as there are many) and
    brief (its low bytes)."""
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc"), F.expr(TEXT_HASH.format(f"`{text_col}`")).alias("text_hash"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):    # the hashes of this many texts are in memory at once
                batch = whole.slice(at, 1024)
                sketch, counts = sketches(batch.column(2).to_pylist(), size)
                keep = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), pa.array(counts[keep], pa.int64()), packed(planes(sketch[keep]))],
                                                 names=["doc", "text_hash", "n", "sketch"])

    made = written(rows.mapInArrow(run, f"doc {kind.simpleString()}, text_hash string, n bigint, sketch binary"), "sketches")
    folded = made.groupBy("text_hash").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("n_copies"))
    # the sketch comes back with the row that stands for its text; rows repeated in id and text are folded here
    kept = made.withColumnRenamed("doc", "of").join(folded, "text_hash").where(F.col("of").eqNullSafe(F.col("doc"))).drop("of")
    once = kept.groupBy("text_hash").agg(*[F.first(c).alias(c) for c in ("doc", "n_copies", "n", "sketch")])
    return written(once.withColumn("id", F.monotonically_increasing_id()), "texts").withColumn("brief", F.substring("sketch", 1, POSITIONS))


def children(nodes: DataFrame, similarity: float) -> DataFrame:
    """(path, id, was) below the nodes (path, id, was, sketch): a node samples each token with probability 1 / (similarity * POSITIONS)."""
    limit = np.uint64(int(2.0**64 / (similarity * POSITIONS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path = batch.column(0).to_numpy().astype(np.int64).view(np.uint64)
            tokens = mixed(from_planes(batch.column(3)).astype(np.uint64) + PLACES)
            below = mixed(tokens ^ mixed(path)[:, None])
            row, place = np.nonzero(mixed(below) < limit)
            yield arrow([below[row, place].view(np.int64), batch.column(1).take(pa.array(row)), batch.column(2).take(pa.array(row))], ["path", "id", "was"], [pa.int64()] * 3)

    return nodes.select("path", "id", "was", "sketch").mapInArrow(run, "path bigint, id bigint, was bigint")


def roots_of(alike: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links, the first index of the component of every index."""
    n = len(alike)
    label = np.full(n, -1)
    for i in range(n):
        if label[i] < 0:
            label[i], front = i, [i]
            while front:
                near = np.flatnonzero(alike[front].any(0) & (label < 0))
                label[near] = i
                front = near.tolist()
    return label


def alike_edges(ids: np.ndarray, side: np.ndarray, sketch: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Tree edges between rows of a node whose sketches agree in ``least`` positions; sides 0 and 1 are compared with each
    other, side 2 with itself."""
    n = len(ids)
    alike = np.zeros((n, n), bool)
    for i in range(0, n, 32):
        alike[i:i + 32] = (sketch[i:i + 32, None, :] == sketch[None, :, :]).sum(2) >= least
    alike &= (side[:, None] == 2) | (side[:, None] != side[None, :])
    label = roots_of(alike)
    more = np.flatnonzero(label != np.arange(n))
    return ids[label[more]], ids[more]


def groups(batches: Iterator[pa.RecordBatch], keys: list[int]) -> Iterator[pa.RecordBatch]:
    """Whole runs of rows with equal keys of a sorted partition; several groups come in one batch, none is cut."""
    held: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        last = [held.column(k)[-1] for k in keys]
        same = np.ones(held.num_rows, bool)
        for k, v in zip(keys, last):
            same &= held.column(k).to_numpy() == v.as_py()
        start = int(np.argmax(same))
        if start:
            yield held.slice(0, start).combine_chunks().to_batches()[0]
            held = held.slice(start)
    if held is not None and held.num_rows:
        yield held.combine_chunks().to_batches()[0]


def bounds(*keys: np.ndarray) -> np.ndarray:
    change = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.concatenate(([0], np.flatnonzero(change) + 1, [len(keys[0])]))


def dealt(rows: DataFrame, by: str, count: str, block: int) -> DataFrame:
    """Rows of a group for each pair of its blocks: columns i, j and side (2 within a block, else 0 or 1)."""
    blocks = F.greatest(F.ceil(F.col(count) / block), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64(F.lit("block"), "id", by), F.col("blocks")).cast("int")
    out = rows.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return out.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).withColumn(
        "side", F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)).drop("blocks", "own", "other")


def compared(nodes: DataFrame, texts: DataFrame, least: int, block: int) -> DataFrame:
    """Tree edges (a, b) of the texts that look alike inside each node (path, id, n)."""
    brief = texts.select("id", "brief")
    rows = dealt(nodes, "path", "n", block).join(brief, "id").select("path", "i", "j", "side", "id", "brief")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, [0, 1, 2]):
            path, i, j, side, ids = (batch.column(k).to_numpy() for k in range(5))
            low = matrix(batch.column(5), POSITIONS, np.uint8)
            cut = bounds(path, i, j)
            sizes = np.diff(cut)
            pairs = cut[:-1][sizes == 2]
            near = pairs[((low[pairs] == low[pairs + 1]).sum(1) >= least) & ((side[pairs] == 2) | (side[pairs] != side[pairs + 1]))]
            a, b = [ids[near]], [ids[near + 1]]
            for at, n in zip(cut[:-1][sizes > 2], sizes[sizes > 2]):
                x, y = alike_edges(ids[at:at + n], side[at:at + n], low[at:at + n], least)
                a.append(x)
                b.append(y)
            a, b = np.concatenate(a), np.concatenate(b)
            yield arrow([np.minimum(a, b), np.maximum(a, b)], ["a", "b"], [pa.int64()] * 2)

    keys = ["path", "i", "j"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a bigint, b bigint").distinct()


def loose_edges(texts: DataFrame, similarity: float, recall: float, small: int, block: int) -> DataFrame:
    """Tree edges of texts that look alike, from as many chosen-path runs as the recall asks for."""
    least = math.floor(POSITIONS * max(0.0, similarity - 4.5 * math.sqrt(similarity * (1 - similarity) / POSITIONS)))
    found, runs, depth, known = [], 0, 1, None
    while runs < (all_runs := runs_needed(similarity, recall, depth)):
        needed = all_runs if runs else min(2, all_runs)    # the first two runs already connect most of what is alike
        starts = F.explode(F.array(*[F.lit(run * 7_919 + 1).cast("bigint") for run in range(runs, needed)]))
        nodes = texts.select(starts.alias("path"), "id", F.lit(1 << 62).alias("was"), "sketch")
        level = 1
        while True:
            below = written(children(nodes, similarity), "nodes")
            # a node whose texts are all in one loose group by now cannot add to it
            label = F.coalesce("root", "id") if known is not None else F.col("id")
            sizes = (below if known is None else below.join(known, "id", "left")).groupBy("path").agg(
                F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("mark"), F.min(label).alias("low"), F.max(label).alias("high")).where("n > 1 AND low < high")
            # nodes of all runs with the same few texts are compared once; larger ones go their own ways
            sizes = sizes.groupBy("n", F.when(F.col("n") <= small, F.col("mark")).otherwise(F.col("path")).alias("mark")).agg(F.min("path").alias("path"))
            sizes = written(sizes.select("path", "n"), "sizes")
            below = written(below.join(sizes, "path"), "shared")    # nodes of one text are done with
            ready = (F.col("n") <= small) | (F.col("n") > 0.5 * F.col("was"))
            found.append(written(compared(below.where(ready).drop("was"), texts, least, block), "alike"))
            depth = max(depth, level)
            rest = written(below.where(~ready).select("path", "id", F.col("n").alias("was")), "rest")
            if rest.isEmpty():
                break
            nodes, level = rest.join(texts.select("id", "sketch"), "id").select("path", "id", "was", "sketch"), level + 1
        runs = needed
        if runs < runs_needed(similarity, recall, depth):
            known = components(reduce(DataFrame.union, found))
    return reduce(DataFrame.union, found).distinct()


def runs_needed(similarity: float, recall: float, depth: int) -> int:
    """Runs after which a pair at the threshold has met in a node at ``depth`` with probability ``recall``."""
    together = 1.0
    for _ in range(depth):    # at every node on average one sampled token is shared; the probability that some path goes on
        together = 1 - math.exp(-together)
    return math.ceil(math.log(1 - recall) / math.log(1 - together))


def linked(ids: np.ndarray, side: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(links of every row, index of the first row of its linked component) among rows of one loose group, exactly.

    Shared shingles are counted by a product of the incidence matrix with itself; shingles that occur in the same rows are
    one weighted column, and columns of one row are left out."""
    n = len(ids)
    sizes = np.array([len(s) for s in sets], float)
    tokens, rows = np.concatenate(sets), np.repeat(np.arange(n), sizes.astype(int))
    order = np.argsort(tokens, kind="stable")
    tokens, rows = tokens[order], rows[order]
    starts = np.concatenate(([0], np.flatnonzero(tokens[1:] != tokens[:-1]) + 1))
    counts = np.diff(np.concatenate((starts, [len(tokens)])))
    marks = np.random.default_rng(5).integers(1, 1 << 63, n, dtype=np.uint64)
    pattern = np.add.reduceat(marks[rows], starts)
    shared = np.flatnonzero(counts > 1)
    _, first, weight = np.unique(pattern[shared], return_index=True, return_counts=True)
    common = np.zeros((n, n))
    columns = shared[first]
    for at in range(0, len(columns), 2048):
        part = columns[at:at + 2048]
        has = np.zeros((n, len(part)), np.float32)
        span = counts[part]
        inside = np.repeat(starts[part] - np.concatenate(([0], np.cumsum(span)[:-1])), span) + np.arange(span.sum())
        has[rows[inside], np.repeat(np.arange(len(part)), span)] = 1
        common += (has * weight[at:at + 2048].astype(np.float32)) @ has.T
    union = sizes[:, None] + sizes[None, :] - common
    links = (common >= similarity * union - 1e-9) & ((side[:, None] == 2) | (side[:, None] != side[None, :]))
    np.fill_diagonal(links, False)
    return links.sum(1), roots_of(links)


def exact_links(docs: DataFrame, members: DataFrame, similarity: float, size: int, block: int, id_col: str, text_col: str) -> DataFrame:
    """(id, links, root): for each block of a loose group, the links of every text and the first text it is linked to."""
    spark_kind = [pa.int64(), pa.int64(), pa.int64()]
    texts = docs.select(F.col(id_col).alias("doc"), F.expr(TEXT_HASH.format(f"`{text_col}`")).alias("text_hash"), F.col(text_col).alias("text"))
    chosen = maybe_in(texts, F.xxhash64("text_hash"), members, F.xxhash64("text_hash")).join(members, texts["text_hash"].eqNullSafe(members["text_hash"]) & texts["doc"].eqNullSafe(members["doc"])).select("root", "id", "blocks", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, ends = shingles(batch.column(3).to_pylist(), size)
            unique = [np.unique(hashes[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(unique, pa.binary())], names=["root", "id", "blocks", "shingles"])

    rows = dealt(chosen.mapInArrow(sets, "root bigint, id bigint, blocks bigint, shingles binary"), "root", "blocks", 1).select("root", "i", "j", "side", "id", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, [0, 1, 2]):
            root, i, j, side, ids = (batch.column(k).to_numpy() for k in range(5))
            out = [[], [], []]
            cut = bounds(root, i, j)
            for at, to in zip(cut[:-1], cut[1:]):
                own, pick = np.unique(ids[at:to], return_index=True)    # rows repeated in id and text count once
                links, first = linked(own, side[at:to][pick], [np.frombuffer(batch.column(5)[int(at + k)].as_py(), np.uint64) for k in pick], similarity)
                for column, values in zip(out, (own, links, own[first])):
                    column.append(values)
            yield arrow([np.concatenate(c) for c in out], ["id", "links", "root"], spark_kind)

    keys = ["root", "i", "j"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "id bigint, links bigint, root bigint")


def classes(docs: DataFrame, similarity: float = 0.8, size: int = 5, recall: float = 0.999, small: int = 1024, block: int = 1024,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each different text with words: text_hash, doc (its smallest id), n_copies, n_links, class_id, and first,
    true for the text that stands for its class.  See ``near_duplicates``."""
    texts = texts_with_sketches(docs, size, id_col, text_col)
    loose = components(loose_edges(texts, similarity, recall, small, block))
    members = loose.join(texts.select("id", "text_hash", "doc", "n"), "id")
    load = members.groupBy("root").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("total")).select(
        "root", F.ceil(F.greatest(F.col("k") / block, F.col("total") / (2_000 * block))).alias("blocks"))
    members = written(members.join(load, "root").drop("n"), "members")
    parts = written(exact_links(docs, members, similarity, size, block, id_col, text_col), "parts")
    counts = parts.groupBy("id").agg(F.sum("links").alias("n_links"))
    roots = components(parts.select(F.col("root").alias("a"), F.col("id").alias("b")))
    known = texts.select("id", "text_hash", "doc", "n_copies").join(roots, "id", "left").join(counts, "id", "left").withColumn("root", F.coalesce("root", "id"))
    first = known.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "text_hash")).alias("best"))
    known = known.join(first, "root").select("text_hash", "doc", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("best.doc").alias("class_id"),
                                             (F.col("best.text_hash") == F.col("text_hash")).alias("first"))
    return written(known, "classes")


def near_duplicates(docs: DataFrame, similarity: float = 0.8, size: int = 5, recall: float = 0.999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, class_id, n_links, n_copies) of every row.

    Two texts are linked if the Jaccard similarity of their sets of ``size``-word shingles (A-Z lowered, words between white
    space; a shorter text is one shingle) is at least ``similarity``.  A class is a connected component of links and equal
    texts; class_id is its smallest id.  n_links counts the other different texts a text is linked to, n_copies the rows
    with its text.  A text without words, or null, is in a class of its own.  Rows repeated in id and text are copies; null
    ids count after all others, and a class of null ids has a null class_id; other columns are left out."""
    known = classes(docs, similarity, size, recall, id_col=id_col, text_col=text_col).drop("doc", "first")
    rows = docs.select(F.col(id_col), F.expr(TEXT_HASH.format(f"`{text_col}`")).alias("text_hash"))
    return rows.join(known, "text_hash", "left").select(id_col, "text_hash", F.when(F.col("n_copies").isNull(), F.col(id_col)).otherwise(F.col("class_id")).alias("class_id"),
                                                        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def representatives(docs: DataFrame, similarity: float = 0.8, size: int = 5, recall: float = 0.999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one stays for each class of ``near_duplicates``: that with the
    smallest id (null last), of texts with this id that with the smaller hash.  Texts without words all stay."""
    known = classes(docs, similarity, size, recall, id_col=id_col, text_col=text_col).where("first").select(F.col("text_hash").alias("_gl_text"), F.col("doc").alias("_gl_doc"))
    rows = docs.withColumn("_gl_hash", F.expr(TEXT_HASH.format(f"`{text_col}`")))
    chosen = rows.join(known, (F.col("_gl_hash") == F.col("_gl_text")) & rows[id_col].eqNullSafe(known["_gl_doc"]))
    wordless = F.btrim(F.coalesce(text_col, F.lit("")), F.lit(" \t\n\x0b\x0c\r")) == ""
    return chosen.dropDuplicates(["_gl_hash"]).select(*docs.columns).unionByName(docs.where(wordless))
