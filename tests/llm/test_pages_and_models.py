import base64
import gzip
import hashlib
import io
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridlight.llm import contamination, html_text, lines, near, pitman_yor, warc
from gridlight.llm.catalog import QUERIES
from gridlight.llm.tables import table

from conftest import DATA
from odd import odd_docs  # noqa: F401


def payload_rows():
    rng = np.random.default_rng(4)
    big = rng.integers(0, 256, 300_000, dtype=np.uint8).tobytes()
    return [(1, "http://a/1", b"short"), (2, "http://a/2", b"short"), (3, None, big), (9, "http://a/ü x", big), (4, "http://a/4\r\nX: y", b"\r\n\r\nWARC/1.1\r\n" * 200), (5, "u", None),
            (6, "u", b""), (None, "u", big), (7, "u", b"x" * 999), (8, "u", b"x" * 999), (10, "u", b"y" * 1000), (11, "u", b"y" * 1000), (11, "u", b"y" * 1000)]


@pytest.mark.parametrize("chunk", [1000, 1 << 20])
def test_archives_round_trip(spark, chunk):
    rows = payload_rows()
    records = spark.createDataFrame(rows, "key bigint, uri string, payload binary")
    manifest = warc.archived(records, chunk_bytes=chunk)
    read = warc.read(manifest, chunk_bytes=chunk).collect()
    found = {}
    for r in sorted(read, key=lambda r: (r.file, r.record_no, r.chunk_no)):
        found.setdefault((r.file, r.record_no), []).append(r)
    assert len(found) == len(rows) and sum(r.records for r in manifest.collect()) == len(rows)
    stored = {}
    for parts in found.values():
        data = b"".join(p.data for p in parts)
        last = parts[-1]
        assert last.last and last.bytes_so_far == len(data) and last.digest_so_far == hashlib.sha1(data).hexdigest() and all(len(p.data) <= chunk for p in parts)
        assert [p.chunk_no for p in parts] == list(range(len(parts)))
        stored.setdefault(last.key, []).append((last.record_type, last.refers_to, data if last.record_type == "response" else last.declared_digest))
    for key, _, payload in rows:
        groups = [k for k, _, p in rows if p == payload and k is not None]
        keeper = max(groups, default=None)
        name = str(key) if key is not None else None
        if len(payload or b"") >= 1000 and key != keeper:
            assert ("revisit", str(keeper), hashlib.sha1(payload).hexdigest()) in stored[name]
        else:
            assert ("response", None, payload or b"") in stored[name]


def test_archives_are_warc_and_plain_ones_are_read():
    head, http = warc.head_of({"key": "7", "uri": "http://x/", "record_type": "response", "refers_to": None, "n_bytes": 3, "digest": hashlib.sha1(b"abc").hexdigest()}, "2020-01-01T00:00:00Z")
    record = head + http + b"abc\r\n\r\n"
    other = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    assert f"sha1:{base64.b32encode(hashlib.sha1(b'abc').digest()).decode()}".encode() in head
    for data in (record + other, gzip.compress(record) + gzip.compress(other), gzip.compress(record + other)):
        got = [(h["warc-type"], d) for h, _, _, d, _, _ in warc.records_of(warc.blocks(io.BytesIO(data)), 100)]
        assert got == [("response", b"abc"), ("warcinfo", b"hello")]
    with pytest.raises(ValueError):
        list(warc.records_of(warc.blocks(io.BytesIO(record[:-6])), 100))


def test_archives_of_empty_tables(spark):
    none = spark.createDataFrame([], "key bigint, uri string, payload binary")
    assert warc.read(warc.archived(none)).collect() == []


SITE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header>
<div id="menu"><a href=x>a</a> <a href=y>b</a></div><div class="cookie-notice">We use cookies</div>
<div class=content><h2>The title &amp; more</h2><p>A long text of an article that says a lot,<br>it goes on and on for some lines.<p>Second &lt;paragraph&gt; with <a href=z>one link</a> and many words after it.
<ul><li>point one of a list<li>point&nbsp;two of it</ul></div><aside>Side text that is rather long, too long perhaps.</aside>
<section id=comments><p>I like this very much, says a reader.</p></section><form>mail <input></form><footer>&copy; us</footer></body></html>"""


def test_article_without_its_surroundings():
    assert html_text.main_text(SITE).split("\n\n") == ["The title & more", "A long text of an article that says a lot, it goes on and on for some lines.",
                                                       "Second <paragraph> with one link and many words after it.", "point one of a list", "point two of it"]


@pytest.mark.parametrize("page,text", [(None, ""), ("", ""), ("<p>x", "x"), ("plain &eacute; text", "plain é text"), ("<nav>a</nav>", ""), ("<article><h1>T</h1><p><b>only one<br></article>", "T\n\nonly one"),
                                       ("a < b and c", "a < b and c"), ("<div>" * 5000 + "deep", "deep"), ("<!-- x", ""), ("<p>a<!-- b -->c</p>", "ac"), ("<p hidden>a</p><p>b c d</p>", "b c d")])
def test_odd_pages(page, text):
    assert html_text.main_text(page) == text


LONG = "A long text of an article that says a lot, and it goes on and on."


@pytest.mark.parametrize("attrs", ['class="overflow-hidden relative"', 'aria-hidden="false"', 'data-hidden="0"', 'title="the hidden gem"', 'data-style="display:none"', 'class="content has-sidebar"',
                                   "class=no-sidebar", 'class="with-ads"', 'class="no-comments"', 'class="related-topic"', 'class="ad-free login"'])
def test_wrappers_keep_their_article(attrs):
    for inner in (f"<p>{LONG}</p><p>{LONG}</p>", f"<article><p>{LONG}</p><p>{LONG}</p></article>"):
        assert html_text.main_text(f"<body><div {attrs}>{inner}</div><div class=footer>ours</div></body>") == f"{LONG}\n\n{LONG}"
        assert html_text.main_text(f"<body><form><div {attrs}>{inner}</div><input></form></body>") == f"{LONG}\n\n{LONG}"


@pytest.mark.parametrize("attrs", ["hidden", 'hidden=""', "aria-hidden=true", "style='color:red; display : none'", 'class="cookie-notice"', 'id=comments', "class='ad x'"])
def test_parts_that_are_no_article_go(attrs):
    assert html_text.main_text(f"<body><div><p>{LONG}</p><p>{LONG}</p><div {attrs}>Other words</div> <span {attrs}>more</span></div></body>") == f"{LONG}\n\n{LONG}"


def test_articles_of_all_pages(spark, tables):
    """The pages of the tables have one article element, whose text is easily cut out by hand."""
    import html
    got = {r.page_id: r for r in html_text.extract(tables("pages")).collect()}
    for r in tables("pages").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if "br" in m[0] else "", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id].text == "\n\n".join(p for p in parts if p) and got[r.page_id].n_chars == len(got[r.page_id].text)
    assert html_text.extract(tables("pages").limit(0)).count() == 0


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def test_language_model(spark, tables):
    got = {r.doc_id: r for r in QUERIES["op9_pitman_yor"](spark, DATA).collect()}
    tokens = {r.doc_id: [*words_of(r.text), None] for r in tables("documents").collect()}
    counts = Counter(w for k, ws in tokens.items() if zlib.crc32(str(k).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    gain = {True: 0.0, False: 0.0}
    for k, ws in tokens.items():
        r = got[k]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert r.held_out == (zlib.crc32(str(k).encode()) % 7 == 2)
        gain[r.held_out] += r.score - r.base_score
    assert gain[True] > 0 and gain[False] > gain[True]


def test_packed_numbers():
    numbers = np.random.default_rng(4)
    words = numbers.integers(0, 1 << 40, 1000, dtype=np.uint64)    # a text's begin stands after greater words
    assert (pitman_yor.from_deltas(pitman_yor.deltas(words)) == words).all()
    for kind in (np.uint8, np.uint32, np.uint64, np.float32):
        x = numbers.integers(0, 200, 10_000).astype(kind)
        assert (pitman_yor.unpack(pitman_yor.pack(x), kind) == x).all() and len(pitman_yor.unpack(pitman_yor.pack(x[:0]), kind)) == 0
    assert len(pitman_yor.pack(numbers.integers(0, 5000, 10_000).astype(np.uint32))) < 18_500    # of 40,000


def test_first_words_share_one(spark):
    """Texts of one word each differ, so their probabilities add up to one at most."""
    docs = spark.createDataFrame([(i, f"w{i % 700}") for i in range(2000)], "doc_id bigint, text string")
    got = {r.doc_id % 700: 10**r.score for r in pitman_yor.log10_scores(docs, F.lit(True)).collect()}
    assert len(got) == 700 and sum(got.values()) < 1


def test_probabilities_add_up(spark):
    """Over the known words, the end and one unknown word the probabilities at a text's begin add up to one: score each word
    in front of a tail that is always the same."""
    train = [(i, t, True) for i, t in enumerate(["a b a b c", "b a c a", "c c b a b", "a", "a b a b a b"])]
    texts = {"": 0, "a": 1, "b": 2, "c": 3, "never": 4, "a a": 5, "b a": 6, "c a": 7, "never a": 8, "a b": 9, "b b": 10}
    docs = spark.createDataFrame(train + [(100 + i, t, False) for t, i in texts.items()], "doc_id int, text string, learn boolean")
    p = {r.doc_id: 10**r.score for r in pitman_yor.log10_scores(docs, F.col("learn"), samples=1).collect()}
    p = {t: p[100 + i] for t, i in texts.items()}
    # x: word at the begin, e: end after a word, m: word after a word.  p(x) = x e(x), p(x a) = x m(x, a) e(a); after the unknown
    # word, which has no restaurant of its own, the parent's probabilities hold: p("never a") / p("a") and so on tie them
    assert p[""] + sum(p[w] for w in ("a", "b", "c", "never")) < 1
    assert all(p[w] > p["never"] for w in ("a", "b", "c")) and p["a b"] > p["b b"]


def test_language_model_of_odd_tables(spark, odd_docs):
    for learns in (F.lit(False), F.col("doc_id") < 5, F.lit(True)):
        got = pitman_yor.log10_scores(odd_docs, learns).collect()
        assert len(got) == odd_docs.count() and all(r.score <= 0 and math.isfinite(r.score) for r in got)
        assert Counter(r.n_tokens for r in got) == Counter(len(words_of(r.text)) + 1 for r in odd_docs.collect())
    assert pitman_yor.log10_scores(odd_docs.limit(0), F.lit(True)).count() == 0


def test_seating_takes_every_words_own_count(spark):
    """A rare word beside a frequent one whose hashes agreed in 21 bits was seated with the count of the frequent one."""
    from gridlight.llm.hashes import mixed, word_hashes
    names = [f"n{i}" for i in range(8000)]
    cell = mixed(word_hashes([" ".join(names)])[0] >> np.uint64(24)) % np.uint64(1 << 21)
    order = np.argsort(cell, kind="stable")
    at = int(np.flatnonzero(np.diff(cell[order]) == 0)[0])
    often, rare = names[order[at]], names[order[at + 1]]
    texts = [" ".join([often] * 500)] * 80 + [f"{c}{i} {w}" for c, w in (("c", rare), ("d", "plain")) for i in range(150) for _ in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    score = {r.doc_id: r.score for r in pitman_yor.log10_scores(docs, F.lit(True)).collect()}
    mean = lambda w: np.mean([score[i] for i, t in enumerate(texts) if t.endswith(" " + w) and not t.startswith("n")])
    assert mean(rare) == pytest.approx(mean("plain"), abs=0.06)


def test_seating_is_sampled_from_its_distribution():
    """Tables of one type: the sampled distribution is that of strength, discount and base."""
    c, d, s, base = 6, 0.5, 1.0, 0.3
    seats = pitman_yor.Seating(np.full(4000, c), np.full(4000, base), np.arange(4000), np.zeros(4000), np.ones(4000), d, s, 1)
    seats.sweep(60)
    stirling = pitman_yor.log_stirling(d)[c]
    weight = np.array([math.exp(stirling[t]) * base**t * np.prod([s + d * j for j in range(t)]) for t in range(1, c + 1)])
    got = np.bincount(seats.t.astype(int), minlength=c + 1)[1:] / 4000
    assert np.abs(got - weight / weight.sum()).max() < 0.04


def test_pipeline_stages(spark, tables, odd_docs):
    docs = tables("documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.written(stage(spark, docs, DATA), name)
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
        if name == "decontamination":
            assert contamination.find_items(kept, table(spark, DATA, "benchmark")).where(F.size("hit") > 0).count() == 0
        if name == "line_dedup":
            assert lines.repeated_runs(kept, min_words=60).count() <= lines.repeated_runs(docs, min_words=60).count()
        if name == "near_duplicates":
            assert near.near_duplicates(kept).where("n_links > 0 or n_copies > 1").count() == 0
        docs = kept
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert ids.count() == docs.count() and ids.where("size(ids) <> n_tokens").count() == 0


def test_pipeline_stages_of_odd_tables(spark, odd_docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd_docs, DATA)
        assert got.columns == odd_docs.columns
        assert got.count() == odd_docs.count() - (3 if name == "near_duplicates" else 0)
        assert stage(spark, odd_docs.limit(0), DATA).count() == 0


def test_documents_that_are_copies_go(spark):
    passage = " ".join(f"{w}{i}" for i, w in enumerate(["Some", "words", "that", "repeat"] * 15)) + "."
    docs = spark.createDataFrame([(1, "Begin. " + passage), (2, passage), (3, "Other text stays."), (4, "")], "doc_id int, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup_stage(spark, docs, DATA).collect()}
    assert got == {1: "Begin. " + passage, 3: "Other text stays.", 4: ""}
