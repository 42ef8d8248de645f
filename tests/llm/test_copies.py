import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlight.llm import ann, graph, hashes, lines, near

from odd import odd_docs  # noqa: F401

LOWER = {i: i + 32 for i in range(65, 91)}
rng = random.Random(3)
VOCAB = [f"w{i}" for i in range(4000)]


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def prose(n):
    return [rng.choice(VOCAB) for _ in range(n)]


def near_copies():
    rows, k = [], 0
    for size in (2, 3, 40):
        base = prose(120)
        for _ in range(size):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                words[rng.randrange(len(words))] = rng.choice(VOCAB)
            rows.append((k, " ".join(words)))
            k += 1
    rows += [(1000 + i, rows[i % 7][1]) for i in range(60)]
    rows += [(2000 + i, " ".join(prose(60))) for i in range(80)]
    passage = " ".join(prose(30))
    return rows + [(3000 + i, " ".join(prose(200)) + " " + passage) for i in range(50)]


def by_hand(rows):
    texts = {t for _, t in rows if shingles(t)}
    sets, inverse, links = {t: shingles(t) for t in texts}, collections.defaultdict(set), collections.defaultdict(set)
    for t, s in sets.items():
        for g in s:
            inverse[g].add(t)
    for t, s in sets.items():
        for u, n in collections.Counter(u for g in s for u in inverse[g]).items():
            if u != t and n / (len(s) + len(sets[u]) - n) >= 0.8:
                links[t].add(u)
    root = {t: t for t in texts}

    def top(t):
        while root[t] != t:
            t = root[t]
        return t
    for t, us in links.items():
        for u in us:
            root[top(t)] = top(u)
    return links, {t: top(t) for t in texts}


def test_unlike_texts_share_no_tokens():
    texts = [" ".join(prose(30)) for _ in range(2000)]
    sketch, _ = near.sketches(texts, 5)
    assert sum(len(texts) - len(np.unique(column)) for column in sketch.T) <= 2
    packed = near.packed(near.planes(sketch))
    assert (near.from_planes(packed) == sketch).all()
    assert (near.matrix(near.pa.array([x[:near.POSITIONS] for x in packed.to_pylist()]), near.POSITIONS, np.uint8) == sketch.astype(np.uint8)).all()


@pytest.mark.parametrize("small,block", [(1024, 1024), (8, 16)])
def test_classes_and_links_by_brute_force(spark, small, block):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    known = {r.text_hash: r for r in near.classes(docs, small=small, block=block).collect()}
    got = {r.doc_id: known[r.h] for r in docs.select("doc_id", F.expr(near.TEXT_HASH.format("text")).alias("h")).collect()}
    links, root = by_hand(rows)
    first = {}
    for k, t in rows:
        first[root[t]] = min(first.get(root[t], 1 << 60), k)
    copies = collections.Counter(t for _, t in rows)
    assert {k: (first[root[t]], len(links[t]), copies[t]) for k, t in rows} == {k: (r.class_id, r.n_links, r.n_copies) for k, r in got.items()}


def test_one_of_each_class_stays(spark):
    rows = near_copies()
    docs = spark.createDataFrame([(k, t, "s") for k, t in rows] + [rows[0] + ("s",), (None, rows[1][1], "s"), (7, "", "s"), (8, None, "s")], "doc_id bigint, text string, source string")
    kept = near.representatives(docs)
    _, root = by_hand(rows)
    first = {}
    for k, t in rows:
        first[root[t]] = min(first.get(root[t], 1 << 60), k)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect())) == sorted([*first.values(), 7, 8])


def test_near_duplicates_of_odd_tables(spark, odd_docs):
    got = {(r.doc_id, r.text_hash): r for r in near.near_duplicates(odd_docs).collect()}
    assert near.near_duplicates(odd_docs).count() == odd_docs.count()
    one = next(r for (k, _), r in got.items() if k == 1)
    assert (one.class_id, one.n_links, one.n_copies) == (1, 0, 2)
    assert {k: r.class_id for (k, _), r in got.items() if k in (2, 3, 4, 6, 7)} == {2: 2, 3: 3, 4: 4, 6: 6, 7: 6}
    assert near.near_duplicates(odd_docs.limit(0)).count() == 0 and near.representatives(odd_docs.limit(0)).count() == 0


def test_components(spark):
    pairs = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(200, 200), (300, 301), (301, 302), (302, 300)]
    got = {r.id: r.root for r in graph.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 140)} | {i: 300 for i in (300, 301, 302)}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_hashes_follow_the_words():
    texts = [None, "", " a", "A b  c\td\ne", "a b c d e f", "x" * 3_000_000, "é z"]
    words, ends = hashes.word_hashes(texts)
    plain = [w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))]
    assert len(plain) == len(words) == ends[-1] and len(set(plain)) == len(set(words.tolist()))
    assert all((plain[i] == plain[j]) == (words[i] == words[j]) for i in range(len(plain)) for j in range(len(plain)))
    assert np.diff(hashes.shingles(texts)[1]).tolist() == [0, 0, 1, 1, 2, 1, 1]


def cut(text):
    return re.split(r"(?<=\n)|(?<=[.!?] )", text)


def without_by_hand(rows, min_words=25, always=20):
    """Lines in a repeated run of three, long repeated lines and what agrees around them, in stretches of enough words."""
    units = {k: [u.strip(" \t\r\n") for u in cut(t) if u.strip(" \t\r\n")] for k, t in rows}
    one, three, size = {}, {}, lambda u: u.count(" ") + 1
    for k in sorted(units):
        for j, u in enumerate(units[k]):
            one.setdefault(u, (k, j))
            three.setdefault(tuple(units[k][j:j + 3]), (k, j))
    out = {}
    for k, us in units.items():
        hit = set()
        for j, u in enumerate(us):
            if j + 3 <= len(us) and three[tuple(us[j:j + 3])] < (k, j):
                hit |= {j, j + 1, j + 2}
            if size(u) >= always and one[u] < (k, j):
                hit.add(j)
                for step in (-1, 1):
                    for n in (1, 2):
                        x, y, src = j + step * n, one[u][1] + step * n, units[one[u][0]]
                        if not (0 <= x < len(us) and 0 <= y < len(src) and us[x] == src[y]):
                            break
                        hit.add(x)
        gone, run = set(), []
        for j in [*sorted(hit), 1 << 30]:
            if run and j != run[-1] + 1:
                gone |= set(run) if sum(size(us[x]) for x in run) >= min_words else set()
                run = []
            run.append(j)
        out[k] = [u for j, u in enumerate(us) if j not in gone]
    return out


def sentences(n):
    return " ".join(" ".join(prose(rng.randrange(3, 12))).capitalize() + "." for _ in range(n))


def test_repeated_runs_by_brute_force(spark):
    passage, short = sentences(9), "A short line of all."
    rows = [(i, "\n".join([sentences(4), short, sentences(3) + (" " + passage if i % 3 == 0 else ""), sentences(2)])) for i in range(30)]
    rows += [(40, passage + "\n\n" + passage), (41, rows[2][1]), (42, "\x01 " + passage), (43, " ".join(prose(30)) + "."), (44, sentences(1) + " Then: " + passage)]
    rows += [(45, rows[33][1] + " Other words follow here.")]
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id bigint, text string, runs int").repartition(4)
    got = lines.without_repeats(docs)
    assert got.columns == ["doc_id", "text", "runs", "_words_removed"]
    got = {r.doc_id: r for r in got.collect()}
    want = without_by_hand(rows)
    assert {k: [u.strip(" \t\r\n") for u in cut(r.text) if u.strip(" \t\r\n")] for k, r in got.items()} == want
    assert got[41].text == "" and got[0].text == rows[0][1] and passage[:40] not in got[3].text
    assert all(len(rows[k][1].split()) - len(got[k].text.split()) == got[k]._words_removed for k in range(30))


def test_line_dedup_of_odd_tables(spark, odd_docs):
    got = lines.without_repeats(odd_docs)
    assert sorted(map(repr, (tuple(r)[:-1] for r in got.collect()))) == sorted(map(repr, map(tuple, odd_docs.collect())))
    assert lines.without_repeats(odd_docs.limit(0)).count() == 0


def test_line_dedup_is_native(spark, tables):
    plan = lines.without_repeats(tables("documents"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_neighbours_against_brute_force(spark):
    x = np.random.default_rng(1).normal(size=(1500, 24)) * np.random.default_rng(2).uniform(0.5, 2, (1500, 1))
    x[200:700] = x[200]    # a third are equal
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(5000, None), (5020, [0.0] * 24), (5040, [float("nan")] * 24), (None, [1.0] * 24), (5060, [None] * 24)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    got = collections.defaultdict(list)
    for r in ann.search(vectors, vectors.where("vec_id % 20 = 0"), block=128).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.id, r.score))
    assert set(got) == set(range(0, 1500, 20)) and all([r for r, _, _ in g] == list(range(1, 21)) for g in got.values())
    hit = 0
    for q, found in got.items():
        score = x @ x[q]
        best = [i for i in np.lexsort((np.arange(1500), -np.round(score, 9))) if i != q][:20]
        hit += len({i for _, i, _ in found} & set(best))
        assert all(abs(s - score[i]) < 1e-9 for _, i, s in found) and [(-round(s, 9), i) for _, i, s in found] == sorted((-round(s, 9), i) for _, i, s in found)
    assert hit >= 0.9 * 20 * len(got)


def test_neighbours_of_small_tables(spark):
    schema = "vec_id bigint, embedding array<float>"
    none = spark.createDataFrame([], schema)
    assert ann.search(none, none).collect() == []
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 1.0]), (3, [0.0, -1.0]), (3, [0.0, -1.0])], schema)
    got = sorted(tuple(r) for r in ann.search(few, few.where("vec_id % 20 = 0")).collect())
    assert got == [(0, 1, 20, 1.0), (0, 2, 3, 0.0), (20, 1, 0, 1.0), (20, 2, 3, -1.0)]
