"""A hierarchical Pitman-Yor bigram model: seating sampled by Gibbs, predictive probabilities averaged over samples.

Every previous word is a restaurant; all share one parent, the restaurant of single words, over a uniform base.  Counts and
seating live in packed arrays: texts become blocks of token numbers, blocks send their word and pair counts to buckets by
hash, and buckets send counts and tables back.  A message is a few columns of numpy bytes, so a shuffle moves few rows, and
nothing is held whole: not the vocabulary, not the pairs, not one restaurant (very frequent contexts are dealt over many
buckets).  Words have 64-bit hashes; in pairs both keep 40 bits.  The counts of words go back to the blocks, and from there
with the pairs to the buckets that seat them.

The seating of a context is sampled from p(tables | customers, word's probability in the parent); one customer of every pair
is taken out and seated again in turn, with the parent's probabilities taken from token counts.  The tables are the
parent's customers, whose own seating is then sampled in the same way.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlight.llm.hashes import mixed, word_hashes
from gridlight.llm.tables import written

END, BEGIN = np.uint64(0xE5D0000000000001), np.uint64(0xBE61000000000001)
BLOCK_TOKENS, BUCKET_BYTES = 1_500_000, 8 << 20
FREQUENT, SPREAD = 0.002, 16
MESSAGE = "dest bigint, kind int, src bigint, a binary, b binary, c binary, d binary"
KINDS = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
STEPS, WAYS = 1024, 128


def pack(x: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second bytes, and so on: the high bytes of small numbers take no room."""
    x = np.ascontiguousarray(x)
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), 1)


def unpack(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(size, -1).T).view(kind).ravel()


def messages(rows: list[tuple]) -> pa.RecordBatch:
    rows = [(*r, *[b""] * (7 - len(r))) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows) if rows else [[]] * 7, KINDS)], names=[p.split()[0] for p in MESSAGE.split(", ")])


def at_destinations(sent: DataFrame, handle: Callable[[int, list[tuple]], list[tuple]], parts: int) -> DataFrame:
    """Bring the messages of each destination together, ordered by kind and source, and send what ``handle`` makes of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for dest, group in groupby(rows, key=lambda r: r[0]):
            made = handle(dest, list(group))
            for i in range(0, len(made), 64):
                yield messages(made[i:i + 64])

    return sent.repartition(parts, "dest").sortWithinPartitions("dest", "kind", "src").mapInArrow(run, MESSAGE)


def dealt(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places) of 40-bit keys."""
    dest = (mixed(keys) >> np.uint64(20)) % np.uint64(parts)
    order = np.argsort(dest, kind="stable")
    cut = np.searchsorted(dest[order], np.arange(parts + 1))
    for p in range(parts):
        if cut[p] < cut[p + 1]:
            yield p, order[cut[p]:cut[p + 1]]


def short(words: np.ndarray) -> np.ndarray:
    """40 bits of word hashes, in the same order as the whole."""
    return words >> np.uint64(24)


def deltas(x: np.ndarray) -> bytes:
    """Numbers of 40 bits, most of them ascending, packed as their differences."""
    return pack(np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, :5].T)


def from_deltas(raw: bytes) -> np.ndarray:
    parts = unpack(raw, np.uint8).reshape(5, -1)
    out = np.zeros((parts.shape[1], 8), np.uint8)
    out[:, :5] = parts.T
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64) & np.uint64((1 << 40) - 1)    # a step down is one around 2 ** 40


def share_of(context: np.uint64, bucket: int, parts: int) -> np.ndarray:
    """The parts of a frequent context that fall into a bucket."""
    keys = context ^ (np.uint64(1) + np.arange(SPREAD, dtype=np.uint64)) << np.uint64(41)
    return np.flatnonzero((mixed(keys) >> np.uint64(20)) % np.uint64(parts) == np.uint64(bucket))


def blocks_of(docs: DataFrame, learns: Column, id_col: str, text_col: str) -> DataFrame:
    """Blocks of about ``BLOCK_TOKENS`` tokens: the words of a block, and its texts as numbers of these words.

    a: word hashes, b: tokens, c: number of tokens of each text, d: 1 for texts to learn from; ids stay beside them."""
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), learns.alias("learns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            ids = pa.concat_arrays([h[0] for h in held])
            lengths = np.concatenate([h[2] for h in held])
            words, tokens = np.unique(np.concatenate([h[1] for h in held]), return_inverse=True)
            flags = np.concatenate([h[3] for h in held]).astype(np.uint8)
            made = [pa.array([uuid.uuid4().int >> 65], pa.int64())] + [pa.array([pack(x)], pa.binary()) for x in (words, tokens.astype(np.uint32), lengths.astype(np.uint32), flags)]
            return pa.RecordBatch.from_arrays([*made, pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)], names=["block", "a", "b", "c", "d", "ids"])

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                hashes, offsets = word_hashes(part.column(1).to_pylist())
                with_end = np.insert(hashes, offsets[1:], END)
                held.append((part.column(0), with_end, np.diff(offsets) + 1, np.array(part.column(2).to_pylist(), bool)))
                size += len(with_end)
                if size >= BLOCK_TOKENS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return written(rows.mapInArrow(run, f"block bigint, a binary, b binary, c binary, d binary, ids array<{kind.simpleString()}>"), "blocks")


def of_block(a: bytes, b: bytes, c: bytes, d: bytes):
    """(words, tokens, contexts, learned) of a block; contexts are numbers of words, or the number of words at a text's begin."""
    words, tokens, lengths = unpack(a, np.uint64), unpack(b, np.uint32), unpack(c, np.uint32)
    before = np.concatenate((np.zeros(1, np.uint32), tokens[:-1]))
    before[np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(int)] = len(words)
    return words, tokens, before, np.repeat(unpack(d, np.uint8).astype(bool), lengths)


def pairs_of(words, tokens, before) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context number, word number) of the distinct pairs of a block, and the pair of every token."""
    pairs, inverse = np.unique(before.astype(np.uint64) << np.uint64(32) | tokens, return_inverse=True)
    return (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64), inverse


def contexts_of(words: np.ndarray, pair_context: np.ndarray, pair_word: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(40-bit context, 40-bit word, key that decides the bucket) of pairs; a frequent context has ``SPREAD`` such keys."""
    u = short(np.append(words, BEGIN))[pair_context]
    w = short(words)[pair_word]
    hot = np.isin(u, frequent)
    return u, w, np.where(hot, u ^ (np.uint64(1) + mixed(w) % np.uint64(SPREAD)) << np.uint64(41), u)


def log_stirling(discount: float) -> np.ndarray:
    """Logarithms of generalised Stirling numbers for up to ``STEPS`` customers and ``WAYS`` tables."""
    out = np.full((STEPS + 1, WAYS + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(WAYS + 1)
    for c in range(STEPS):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = np.where(c - discount * t > 0, out[c] + np.log(np.maximum(c - discount * t, 1e-300)), -np.inf)
        out[c + 1] = np.logaddexp(stay, np.concatenate(([-np.inf], out[c, :-1])))
    return out


class Seating:
    """Tables t of types with c customers in restaurants; ``of`` is the restaurant of each type, ``extra`` tables of types
    that are not among them, ``scale`` the share of a restaurant that is here, as its whole over this part."""

    def __init__(self, c: np.ndarray, base: np.ndarray, of: np.ndarray, extra: np.ndarray, scale: np.ndarray, discount: float, strength: float, seed: int):
        self.c, self.base, self.of, self.extra, self.scale, self.d, self.s = c.astype(float), base, of, extra.astype(float), scale, discount, strength
        self.rng, self.stirling = np.random.default_rng(seed), log_stirling(discount)
        self.t = np.ones(len(c))
        total = self.totals()
        at = np.ones(len(c))    # expected tables as customers arrive, in growing steps, then rounded at random
        while (at < self.c).any():
            step = np.minimum(np.maximum(1.0, np.floor(at * 0.25)), self.c - at)
            new = (strength + discount * total[of]) * base
            self.t += step * new / (new + np.maximum(at - discount * self.t, 1e-9))
            at += step
        self.t = np.clip(np.floor(self.t + self.rng.random(len(c))), 1, self.c)

    def totals(self) -> np.ndarray:
        return self.scale * (self.extra + np.bincount(self.of, self.t, len(self.extra)))

    def sweep(self, rounds: int) -> None:
        """In each round one customer of every type leaves and is seated again."""
        c, d = self.c, self.d
        small = (c <= STEPS)
        ci = np.where(small, c, 1).astype(int)
        for _ in range(rounds):
            ti = np.clip(self.t, 1, WAYS).astype(int)
            exact = small & (self.t <= WAYS)
            with np.errstate(invalid="ignore", over="ignore"):
                alone = np.where(exact, np.exp(np.minimum(0.0, self.stirling[ci - 1, ti - 1] - self.stirling[ci, ti])), d * (self.t - 1) / np.maximum(c - 1, 1))
            alone = np.where(self.t >= c, 1.0, np.where(self.t <= 1, np.where(c > 1, 0.0, 1.0), np.nan_to_num(alone)))
            left = self.t - (self.rng.random(len(c)) < alone)
            total = self.totals()
            new = (self.s + d * (total[self.of] - (self.t - left))) * self.base
            old = np.maximum(c - 1 - d * left, 0.0)
            self.t = np.where(left < 1, 1.0, left + (self.rng.random(len(c)) * (new + old) < new))


def log10_scores(docs: DataFrame, learns: Column, discounts: tuple[float, float] = (0.6, 0.85), strengths: tuple[float, float] = (20.0, 1.0),
                 burn_in: int = 20, samples: int = 2, rounds: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    Words are runs of other characters than ASCII white space, A-Z lowered, and every text ends with one end token; the
    model learns from the rows where ``learns`` holds (null: it does not).  base_score is the add-one unigram score, score
    the model's log10 probability of the text, both with the end token.  A null or empty text is its end token alone.
    Null ids, ties and repeated rows stay as they are; other columns are left out.  With nothing to learn from, every word
    has the uniform base probability.  ``discounts`` and ``strengths`` are those of single words and of pairs."""
    spark = docs.sparkSession
    learns = F.coalesce(learns, F.lit(False))
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first().n or 0
    parts = max(64, -(-size // BUCKET_BYTES))
    kind = docs.schema[id_col].dataType.simpleString()
    blocks = blocks_of(docs, learns, id_col, text_col)

    # words: exact counts in the training texts
    def send_words(batches, counting=True):
        for batch in batches:
            for block, a, b, c, d in zip(*(batch.column(k).to_pylist() for k in range(5))):
                words, tokens, before, learned = of_block(a, b, c, d)
                counts = np.bincount(tokens[learned], minlength=len(words)).astype(np.uint32)
                yield messages([(p, 0, block, pack(words[at]), pack(counts[at]) if counting else b"") for p, at in dealt(short(words), parts)])

    def count_words(bucket, rows):
        words, inverse = np.unique(np.concatenate([unpack(r[3], np.uint64) for r in rows]), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([unpack(r[4], np.uint32) for r in rows]), len(words)).astype(np.uint64)
        # one row of totals per bucket: tokens and words; and to every block the counts of its words, those of equal 40 bits together
        brief, of_word = np.unique(short(words), return_inverse=True)
        together = np.bincount(of_word, counts, len(brief)).astype(np.uint64)[of_word]
        out, at = [(bucket, 1, bucket, pack(words), pack(counts), np.array([counts.sum(), (counts > 0).sum()], np.uint64).tobytes())], 0
        for r in rows:
            length = len(unpack(r[3], np.uint64))
            out.append((r[2], 7, bucket, pack(together[inverse[at:at + length]])))
            at += length
        return out

    made = written(at_destinations(blocks.drop("ids").mapInArrow(send_words, MESSAGE), count_words, parts), "words")
    counted = made.where("kind = 1")

    def totals(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                n, v = np.frombuffer(raw, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array([int(n)]), pa.array([int(v)])], names=["n", "v"])

    total = counted.select("c").mapInArrow(totals, "n bigint, v bigint").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n_train, n_words = int(total.n or 0), int(total.v or 0)
    uniform = 1.0 / (n_words + 1)

    def often(batches):
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(short(unpack(a, np.uint64)[unpack(b, np.uint64) >= max(2, FREQUENT * n_train)]).astype(np.int64))], names=["w"])

    frequent = np.array([r.w for r in counted.select("a", "b").mapInArrow(often, "w bigint").collect()], np.uint64)    # at most 1 / FREQUENT words
    frequent = np.append(frequent, short(BEGIN))
    shared = spark.sparkContext.broadcast(frequent)

    # pairs: counts, seating, tables
    def send_pairs(block, rows):
        hot = shared.value
        words, tokens, before, learned = of_block(*rows[0][3:7])
        whole, by_word = np.zeros(len(words), np.uint64), dict(dealt(short(words), parts))
        for r in rows[1:]:
            whole[by_word[r[2]]] = unpack(r[3], np.uint64)
        pu, pw, inverse = pairs_of(words, tokens, before)
        counts = np.bincount(inverse[learned], minlength=len(pu)).astype(np.uint32)
        u, w, key = contexts_of(words, pu, pw, hot)
        out = []
        for p, at in dealt(key, parts):    # a word goes to a bucket once, with its count in all training texts
            brief, first, place = np.unique(w[at], return_index=True, return_inverse=True)
            out.append((p, 0, block, deltas(u[at]), words_and_counts(brief, whole[pw[at[first]]]), pack(place.astype(np.uint32).view(np.uint8).reshape(-1, 4).T), pack(counts[at])))
        return out

    def seat_pairs(bucket, rows):
        hot = shared.value
        u = [from_deltas(r[3]) for r in rows]
        lengths, u = [len(x) for x in u], np.concatenate(u)
        sent = [from_words_and_counts(r[4]) for r in rows]
        w = np.concatenate([x[0][np.ascontiguousarray(unpack(r[5], np.uint8).reshape(4, -1).T).view(np.uint32).ravel()] for x, r in zip(sent, rows)])
        brief, first = np.unique(np.concatenate([x[0] for x in sent]), return_index=True)
        whole = np.concatenate([x[1] for x in sent])[first]
        n = np.concatenate([unpack(r[6], np.uint32) for r in rows])
        order = np.lexsort((w, u))
        su, sw = u[order], w[order]
        fresh = np.concatenate(([True], (su[1:] != su[:-1]) | (sw[1:] != sw[:-1])))
        types = np.cumsum(fresh) - 1
        of_entry = np.empty(len(order), np.int64)
        of_entry[order] = types
        count = np.bincount(of_entry, n)
        tu, tw = su[fresh], sw[fresh]
        contexts, of = np.unique(tu, return_inverse=True)
        customers = np.bincount(of, count, len(contexts))
        many, once = np.flatnonzero(count > 1), count == 1
        base = whole[np.searchsorted(brief, tw[many])].astype(float) / max(1, n_train)
        here = np.array([len(share_of(x, bucket, parts)) for x in contexts[np.isin(contexts, hot)]], float)
        scale = np.ones(len(contexts))
        scale[np.isin(contexts, hot)] = SPREAD / np.maximum(here, 1)
        seats = Seating(count[many], base, of[many], np.bincount(of[once], minlength=len(contexts)), scale, discounts[1], strengths[1], 1000 + bucket)
        seats.sweep(burn_in)
        tables, totals_of = [], []
        for _ in range(samples):
            seats.sweep(rounds)
            t = once.astype(np.uint32)
            t[many] = seats.t
            tables.append(t)
            totals_of.append(np.bincount(of, t, len(contexts)).astype(np.uint32))
        out, at = [], 0
        for r, length in zip(rows, lengths):    # back to the blocks, in the order of their pairs
            entry = of_entry[at:at + length]
            places, inside = np.unique(of[entry], return_inverse=True)
            out.append((r[2], 2, bucket, pack(count[entry].astype(np.uint32)), pack(np.stack([t[entry] for t in tables])), pack(np.diff(inside.astype(np.uint32), prepend=np.uint32(0))),
                        pack(np.stack([x[places] for x in totals_of]).astype(np.uint32))))
            at += length
        used = count > 0
        words, inverse = np.unique(tw[used], return_inverse=True)
        sums = np.stack([np.bincount(inverse, t[used], len(words)) for t in tables]).astype(np.uint32)
        for p, places in dealt(words, parts):    # tables are the parent's customers
            out.append((p, 3, bucket, pack(words[places]), pack(sums[:, places])))
        wide = np.flatnonzero(np.isin(contexts, hot))    # frequent contexts are in many buckets
        out.append((-1, 6, bucket, contexts[wide].tobytes(), np.stack([customers[wide], *[x[wide] for x in totals_of]]).astype(np.float64).tobytes()))
        return out

    own = blocks.select(F.col("block").alias("dest"), F.lit(0).alias("kind"), F.col("block").alias("src"), "a", "b", "c", "d")
    pairs = at_destinations(own.unionByName(made.where("kind = 7")), send_pairs, parts)
    seated = written(at_destinations(pairs, seat_pairs, parts), "seats")

    def wide_rows(batches):
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                u, n = np.frombuffer(a, np.uint64).astype(np.int64), np.frombuffer(b, float).reshape(1 + samples, -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(u, 1 + samples)), pa.array(np.repeat(np.arange(1 + samples), len(u))), pa.array(n.ravel())], names=["u", "k", "n"])

    wide = defaultdict(lambda: np.zeros(1 + samples))
    for r in seated.where("kind = 6").select("a", "b").mapInArrow(wide_rows, "u bigint, k bigint, n double").groupBy("u", "k").agg(F.sum("n").alias("n")).collect():    # as many as frequent words
        wide[r.u][r.k] = r.n
    wide = dict(wide)

    # the parent restaurant: its customers are tables of contexts; the seating is sampled bucket by bucket
    parent = seated.where("kind = 3")
    sums = parent.mapInArrow(table_totals(samples), "s int, n bigint").groupBy("s").agg(F.sum("n").alias("n")).collect()
    customers_all = {r.s: r.n for r in sums}
    asked = blocks.drop("ids").mapInArrow(lambda batches: send_words(batches, False), MESSAGE)
    everything = parent.unionByName(counted.withColumn("src", F.lit(0).cast("bigint"))).unionByName(asked)

    def seat_words(bucket, rows):
        words = counts = None
        asking = []
        for r in rows:
            if r[1] == 1:
                words, counts = unpack(r[3], np.uint64), unpack(r[4], np.uint64)
            elif r[1] == 0:
                asking.append(r)
        brief, of_word = np.unique(short(words), return_inverse=True)
        cust = np.zeros((samples, len(brief)))
        for r in rows:
            if r[1] == 3:
                cust[:, np.searchsorted(brief, unpack(r[3], np.uint64))] += unpack(r[4], np.uint32).reshape(samples, -1)
        probs = []
        for s in range(samples):
            live = np.flatnonzero(cust[s] > 0)
            whole = max(1.0, float(customers_all.get(s, 1)))
            # the whole restaurant's tables, as expected for its size, stand for those of the other buckets
            seats = Seating(cust[s][live], np.full(len(live), uniform), np.zeros(len(live), int), np.array([0.0]), np.ones(1), discounts[0], strengths[0], 77 * bucket + s)
            seats.extra = np.array([seats.t.sum() * (whole / max(1.0, cust[s].sum()) - 1)])
            seats.sweep(burn_in)
            t = np.zeros(len(brief))
            t[live] = seats.t
            probs.append((np.maximum(cust[s] - discounts[0] * t, 0), t))
        out = []
        for r in asking:
            places = np.searchsorted(words, unpack(r[3], np.uint64))
            short_at = of_word[places]
            out.append((r[2], 4, bucket, pack(counts[places]), pack(np.stack([p[0][short_at] for p in probs]).astype(np.float32))))
        out += [(-1, 5, bucket, np.array([[t.sum(), cust[s].sum()] for s, (_, t) in enumerate(probs)]).tobytes())]
        return out

    parents = written(at_destinations(everything, seat_words, parts), "parents")
    tables_all = np.zeros((samples, 2))
    totals_of_parent = parents.where("kind = 5").select("a").mapInArrow(parent_totals(samples), "s int, t double, c double")
    for r in totals_of_parent.groupBy("s").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).collect():    # one row for each sample
        tables_all[r.s] = r.t, r.c
    rest = [(strengths[0] + discounts[0] * tables_all[s, 0]) * uniform for s in range(samples)]
    below = [strengths[0] + tables_all[s, 1] for s in range(samples)]

    # scores, block by block
    answers = seated.where("kind = 2").unionByName(parents.where("kind = 4"))
    store = blocks.select(F.col("block").alias("dest"), F.lit(0).alias("kind"), F.col("block").alias("src"), "a", "b", "c", "d", "ids")
    answers = answers.withColumn("ids", F.lit(None).cast(f"array<{kind}>"))
    out_kind = f"{id_col} {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value

        def rows_of():
            for batch in batches:
                plain = [batch.column(k).to_pylist() for k in range(7)]
                for i in range(batch.num_rows):
                    yield (*[c[i] for c in plain], batch.column(7).slice(i, 1))

        for _, group in groupby(rows_of(), key=lambda r: r[0]):
            rows = list(group)
            head = rows[0]
            words, tokens, before, _ = of_block(*head[3:7])
            lengths = unpack(head[5], np.uint32)
            pu, pw, inverse = pairs_of(words, tokens, before)
            _, _, key = contexts_of(words, pu, pw, hot)
            count, top = np.zeros(len(words)), np.zeros((samples, len(words)))
            by_word, by_pair = dict(dealt(short(words), parts)), dict(dealt(key, parts))
            c, t = np.zeros(len(pu)), np.zeros((samples, len(pu)))
            seen = np.zeros((samples, len(words) + 1))
            for r in rows[1:]:
                if r[1] == 4:
                    at = by_word[r[2]]
                    count[at] = unpack(r[3], np.uint64)
                    top[:, at] = unpack(r[4], np.float32).reshape(samples, -1)
                else:
                    at = by_pair[r[2]]
                    c[at] = unpack(r[3], np.uint32)
                    t[:, at] = unpack(r[4], np.uint32).reshape(samples, -1)
                    inside, place = np.cumsum(unpack(r[5], np.uint32), dtype=np.uint32), unpack(r[6], np.uint32).reshape(samples, -1)
                    context = np.zeros(place.shape[1], np.int64)
                    context[inside] = pu[at]
                    seen[:, context] = place
            customers_of = np.append(count, wide.get(int(short(BEGIN)), np.zeros(1))[0])    # a word is followed as often as it occurs
            brief = short(np.append(words, BEGIN))
            for i in np.flatnonzero(np.isin(brief, hot)):
                seen[:, i] = wide.get(int(brief[i]), np.zeros(1 + samples))[1:]
            prob = np.zeros(len(pu))
            for s in range(samples):
                single = (top[s] + rest[s]) / below[s]
                customers, tables = customers_of[pu], seen[s][pu]
                prob += (np.maximum(c - discounts[1] * t[s], 0) + (strengths[1] + discounts[1] * tables) * single[pw]) / (strengths[1] + customers)
            ends = np.cumsum(lengths)
            begins = (ends - lengths).astype(int)
            total_of = lambda x: np.add.reduceat(x, begins)
            yield pa.RecordBatch.from_arrays(
                [head[7].flatten(), pa.array(lengths.astype(np.int64)), pa.array(total_of((count > 0)[tokens].astype(np.int64))), pa.array(np.full(len(lengths), n_train, np.int64)),
                 pa.array(total_of(np.log10((count + 1) / (n_train + n_words + 1))[tokens])), pa.array(total_of(np.log10(prob / samples)[inverse]))], names=[p.split()[0] for p in out_kind.split(", ")])

    return store.unionByName(answers).repartition(parts, "dest").sortWithinPartitions("dest", "kind", "src").mapInArrow(score, out_kind)


def words_and_counts(words: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending 40-bit words and a count of each."""
    raw = deltas(words)
    return len(raw).to_bytes(4, "little") + raw + pack(counts)


def from_words_and_counts(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    cut = 4 + int.from_bytes(raw[:4], "little")
    return from_deltas(raw[4:cut]), unpack(raw[cut:], np.uint64)


def table_totals(samples: int):
    def run(batches):
        for batch in batches:
            for raw in batch.column(4).to_pylist():
                sums = unpack(raw, np.uint32).reshape(samples, -1).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(samples), pa.int32()), pa.array(sums.astype(np.int64))], names=["s", "n"])
    return run


def parent_totals(samples: int):
    def run(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                both = np.frombuffer(raw, float).reshape(samples, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(samples), pa.int32()), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["s", "t", "c"])
    return run
