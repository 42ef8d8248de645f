import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridlight.llm import resampling

from odd import odd_docs  # noqa: F401

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def runs(text):
    ws = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(ws), [" ".join(ws[i:i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1)]


def bucket(run):
    return zlib.crc32(run.encode()) % 10000


def by_hand(docs, target, percent=5, min_words=20, seed=42):
    """{doc position: (features, weight, score, rank)}"""
    count = lambda texts: np.bincount([bucket(r) for t in texts for r in runs(t)[1]] or [0], minlength=10000) - (0 if any(runs(t)[1] for t in texts) else np.eye(1, 10000, 0, int)[0])
    s, t = count([d[1] for d in docs]), count(target)
    gain = [math.floor(1000 * math.log((int(b) + 1) * (int(s.sum()) + 10000) / ((int(a) + 1) * (int(t.sum()) + 10000)))) for a, b in zip(s, t)]
    out = []
    for key, text in docs:
        n, features = runs(text)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(r)] for r in features)
        out.append([n, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((i for i, o in enumerate(out) if o[0] >= min_words), key=lambda i: (-out[i][3], docs[i][0] is None, docs[i][0] or 0))
    rank = {i: r for r, i in enumerate(able[:len(able) * percent // 100], 1)}
    return [(*o, rank.get(i)) for i, o in enumerate(out)]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aB9 .é漢\n"), max_size=60), st.integers(1, 12))
def test_buckets_of_segments(text, segment):
    got = list(resampling.feature_buckets(text, 10000, segment))
    n, features = runs(text)
    assert sum(g[0] for g in got) == n
    assert sorted(b for g in got for b in g[1].tolist()) == sorted(map(bucket, features))


@pytest.mark.parametrize("sort_rows", [100_000, 3])
def test_draw_by_brute_force(spark, odd_docs, sort_rows):
    rng = random.Random(2)
    pick = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    common, wanted = [f"c{i}" for i in range(60)], [f"t{i}" for i in range(30)]
    texts = [(100 + i, pick(common + (wanted if i % 7 == 0 else []), rng.randrange(15, 60))) for i in range(300)] + [(7, pick(common, 30))] * 9 + [(None, pick(wanted, 25))] * 3
    target = [pick(wanted, 40) for _ in range(20)] + [None, "", "Word"]
    docs = odd_docs.unionByName(spark.createDataFrame(texts, "doc_id bigint, text string"), allowMissingColumns=True).withColumn("rank", F.lit("other"))
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    rows = docs.select("doc_id", "text").collect()
    want = by_hand([(r.doc_id, r.text) for r in rows], target, percent=20)
    got = resampling.resampled(docs, goal, percent=20, carry=["doc_id", "rank"], prefix="_r_", sort_rows=sort_rows)
    assert got.columns == ["doc_id", "rank", "_r_n_words", "_r_n_features", "_r_weight", "_r_score", "_r_rank"]
    key = lambda x: str(x)
    assert sorted((tuple(r[c] for c in ("doc_id", "_r_n_words", "_r_n_features", "_r_weight", "_r_score", "_r_rank")) for r in got.collect()), key=key) == sorted(((r.doc_id, *w) for r, w in zip(rows, want)), key=key)
    drawn = [w for r, w in zip(rows, want) if w[4]]
    assert sum(1 for r, w in zip(rows, want) if w[4] and "t" in (r.text or "")) > len(drawn) * 0.5    # a sixth of all rows


def test_empty_sides(spark):
    docs = spark.createDataFrame([(i, f"some words {i} " * 10) for i in range(50)], "doc_id bigint, text string")
    none = docs.select("text").limit(0)
    assert resampling.resampled(docs.limit(0), docs).count() == 0
    got = sorted(tuple(r)[1:] for r in resampling.resampled(docs, none, carry=["doc_id"]).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect())
    assert got == sorted(by_hand([(r.doc_id, r.text) for r in docs.collect()], []))
    assert all(r.rank is None for r in resampling.resampled(docs.limit(5), none).collect())    # a twentieth of five is none


@settings(max_examples=12, deadline=None)
@given(values=st.lists(st.integers(-5, 5) | st.integers(-10**12, 10**12), min_size=1, max_size=80), data=st.data())
def test_bracket_with_ties(spark, values, data):
    rank = data.draw(st.integers(1, len(values)))
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    value = sorted(values, reverse=True)[rank - 1]
    assert resampling.bracketed(df, rank, sort_rows=2) == (value, sum(v > value for v in values))


def test_a_bracket_that_misses_is_widened(spark):
    """A margin far below the sketch's error, and a hot value."""
    df = spark.range(60_000).selectExpr("CASE WHEN id % 3 = 0 THEN 17 ELSE (id * 48271) % 30011 END AS v").repartition(7)
    values = sorted((r.v for r in df.collect()), reverse=True)
    for rank in (1, 2, 29_000, 40_001, 59_999, 60_000):
        value = values[rank - 1]
        assert resampling.bracketed(df, rank, margin=0.3 if rank % 2 else 0.0005, sort_rows=50) == (value, sum(v > value for v in values))


def test_ranks_over_many_buckets(spark):
    df = spark.range(5000).selectExpr("id", "(id * 7919) % 613 AS s").repartition(5)
    got = resampling.ranked(df, [F.col("s").desc(), F.col("id").asc()], "s", 5000, bucket_rows=100).collect()
    assert [(r.s, r.id) for r in sorted(got, key=lambda r: r._gl_rank)] == sorted(((r.s, r.id) for r in got), key=lambda x: (-x[0], x[1]))
    assert sorted(r._gl_rank for r in got) == list(range(1, 5001))
