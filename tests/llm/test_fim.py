import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridlight.llm import fim

from odd import odd_docs  # noqa: F401

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abZ 1\n<>_漢🙂ſKé"), max_size=80), st.integers(1, 9))
def test_cuts_as_counted_by_hand(text, block):
    units = fim.Units(text, block)
    by_hand = UNIT.findall(text)
    assert units.n == len(by_hand)
    assert [units.after(u) for u in range(units.n + 2)] == [len("".join(by_hand[:u])) for u in range(units.n + 2)]


def test_a_unit_longer_than_many_blocks():
    text = "x" * 5000 + " " + "y" * 3000
    units = fim.Units(text, 64)
    assert units.n == 3 and [units.after(u) for u in range(4)] == [0, 5000, 5001, 8001]


@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 9)), max_size=40), st.integers(0, 220))
def test_descent_is_a_prefix_sum(counts, most):
    import numpy as np
    at, first, second = fim.Fenwick(np.array(counts, np.int64).reshape(-1, 2)).descend(most)
    sums = [sum(c[0] for c in counts[:i]) for i in range(len(counts) + 1)]
    assert at == max(i for i, s in enumerate(sums) if s <= most)
    assert (first, second) == (sums[at], sum(c[1] for c in counts[:at]))


def by_hand(key, text, seed=1, plain=10, spm=20):
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    parts = ["".join(units[:a]), "".join(units[a:b]), "".join(units[b:])]
    if not text or any(m in text for m in fim.MARKERS) or h[2] % 100 >= 100 - plain:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(parts[0]), len(parts[1]), "<S>" + parts[2] + "<P>" + parts[0] + "<M>" + parts[1]
    return len(units), "psm", len(parts[0]), len(parts[1]), "<P>" + parts[0] + "<S>" + parts[2] + "<M>" + parts[1]


def test_odd_rows_and_the_way_back(spark, odd_docs):
    more = spark.createDataFrame([(i, t) for i, t in enumerate(["<P", "a<S", "S> M>", "a <P> b", "<M>", ">", "<<S<P<M"] * 12, 100)], "doc_id bigint, text string")
    docs = odd_docs.unionByName(more, allowMissingColumns=True).withColumn("output", F.lit("other")).withColumn("form", F.lit(1))
    assert fim.transformed(docs).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = fim.transformed(docs, prefix="_f_", carry=["doc_id", "text", "output", "form"])
    got = got.withColumn("back", fim.restored(F.col("_f_output"), F.col("_f_form"))).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r["_f_n"], r["_f_form"], r["_f_prefix_chars"], r["_f_middle_chars"], r["_f_output"]) == by_hand("" if r.doc_id is None else r.doc_id, r.text or "")
        assert r.back == (r.text or "") and r.output == "other"
    assert {r["_f_form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.transformed(docs.limit(0)).count() == 0


def test_rates_and_seed(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('some words of ', id, ' and more') AS text")
    counts = {r.form: r["count"] for r in fim.transformed(docs, seed=7, plain_percent=50, spm_percent=50).groupBy("form").count().collect()}
    assert 1400 < counts["plain"] < 1600 and 650 < counts["psm"] < 850 and 650 < counts["spm"] < 850
    got = {r.doc_id: r.output for r in fim.transformed(docs, seed=7, plain_percent=50, spm_percent=50).collect()}
    assert all(got[r.doc_id] == by_hand(r.doc_id, r.text, 7, 50, 50)[4] for r in docs.collect())


@pytest.mark.parametrize("markers", [("", "<S>", "<M>"), ("<P>", "<P>", "<M>"), ("aba", "<S>", "<M>"), ("<P>", ">x", "<M>"), ("<P>", "x<P>y", "<M>")])
def test_markers_that_cannot_be_told_apart(spark, markers):
    with pytest.raises(ValueError):
        fim.transformed(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), markers=markers)
