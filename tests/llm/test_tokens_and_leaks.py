import hashlib
import re
import zlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridlight.llm import contamination, pii, tokenize, toxicity

from odd import odd_docs  # noqa: F401


from gridlight.llm.bpe import BytePairs

PATH = public_tokenizers.path("byte_bpe_50k.json")
PAIRS, THEIRS = BytePairs(PATH, keep=50), Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_ids_and_text_as_the_library(text):
    ids = THEIRS.encode(text, add_special_tokens=False).ids
    assert PAIRS.encode(text) == ids
    assert PAIRS.decode(ids) == THEIRS.decode(ids, skip_special_tokens=False) == text


@pytest.mark.parametrize("text", ["", " ", "a  b", "x\n\n y ", "<|endoftext|>", "a<|endoftext|> b", "it's we'll", "aaaa" * 500, "\xa0\x85\x1c z"])
def test_ids_of_odd_texts(text):
    assert PAIRS.encode(text) == THEIRS.encode(text, add_special_tokens=False).ids


def test_any_ids_decode():
    for ids in ([200], [50256, 13, 222], []):
        assert PAIRS.decode(ids) == THEIRS.decode(ids, skip_special_tokens=False)


def test_token_tables(spark, odd_docs):
    got = tokenize.encoded_digests(odd_docs, PATH, with_ids=True)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    texts = [r.text or "" for r in odd_docs.collect()]
    rows = got.collect()
    assert sorted(r.ids_sha256 for r in rows) == sorted(hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in THEIRS.encode(t, add_special_tokens=False).ids)).hexdigest() for t in texts)
    assert all(len(r.ids) == r.n_tokens for r in rows)
    back = tokenize.decode(tokenize.encode(odd_docs, PATH), PATH)
    assert sorted(r.text for r in back.collect()) == sorted(texts)
    assert tokenize.encoded_digests(odd_docs.limit(0), PATH).count() == 0


def windows_by_hand(words, n=10):
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


@pytest.mark.parametrize("part_chars", [4_000_000, 60])
def test_windows_by_brute_force(spark, part_chars):
    items = [(1, "a b c d e f g h i j k"), (2, "One, TWO three!"), (2, "x y"), (None, "q r s"), (3, None), (4, "  .,"), (10, "b c d e f g h i j k")]
    docs = [(1, "zz A b c D e f g h i j k yy one two three four."), (2, "one two, three one two three"), (None, "q-r-s"), (3, None), (4, "x y x y"), (5, "twoo three x  y"), (1, "nothing here"), (6, "a b c d e f g h i j x")]
    d, b = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    got = contamination.find_items(d, b, part_chars=part_chars, carry=["doc_id", "text"]).collect()
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
    assert len(got) == len(docs)
    for r in got:
        words, hit, names = split(r.text), set(), set()
        for item, text in items:
            for win in windows_by_hand(split(text)):
                for i in range(len(words) - len(win) + 1):
                    if tuple(words[i:i + len(win)]) == win:
                        hit |= set(range(i, i + len(win)))
                        names |= {str(item)} if item is not None else set()
        assert (r.n_words, r.hit, r["items"]) == (len(words), sorted(hit), sorted(names))
        assert [w for s in r.spans for w in split(r.text[s.start:s.end])] == [words[i] for i in sorted(hit)]


def test_parts_hold_few_ids_although_items_share_a_prompt(spark, monkeypatch):
    prompt = " ".join(f"p{i}" for i in range(20))
    items = spark.createDataFrame([(f"{i:040d}", prompt) for i in range(150)], "item_id string, text string")
    sizes, plain = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sizes.append(sum(len(w) + sum(map(len, of)) for w, of in value)) or plain(self, value))
    (got,) = contamination.find_items(spark.createDataFrame([(1, f"x {prompt} y")], "doc_id int, text string"), items, part_chars=30_000).collect()
    assert got["items"] == [f"{i:040d}" for i in range(150)] and got.hit == list(range(1, 21))
    assert max(sizes) < 45_000


def test_leaks_of_odd_tables(spark, odd_docs):
    none = spark.createDataFrame([], "item_id int, text string")
    assert contamination.find_items(odd_docs, none).where(F.size("hit") > 0).count() == 0
    same = odd_docs.select(F.col("doc_id").alias("item_id"), "text")
    got = contamination.find_items(odd_docs, same, carry=odd_docs.columns, prefix="_gl_")
    assert got.where("_gl_n_words > 0 and size(_gl_hit) <> _gl_n_words").count() == 0 and got.count() == odd_docs.count()


KEY = b"tests"


@pytest.mark.parametrize("kind,raw", [("date", "2024-02-29"), ("date", "3/4/2021"), ("date", "25/12/2020"), ("date", "05.11.1999"), ("date", "1776-7-4"), ("card", "4111 1111 1111 1111"),
                                      ("card", "378282246310005"), ("ssn", "123-45-6789"), ("phone", "+1 (017) 555-7713"), ("phone", "+44 20 7946 0958"), ("ip", "10.0.0.1"),
                                      ("iban", "DE89 3704 0044 0532 0130 00"), ("email", "Bob.x9@mail.example.com"), ("secret", "b44e15e09fd311c3cf3163b66d5a9875b883d8ce")])
def test_pseudonyms_keep_the_format_and_come_back(kind, raw):
    text = f"Write to {raw} soon."
    (found,) = pii.values_of(text, KEY)
    assert found[2] == kind and found[3] != raw and text[found[0]:found[1]] == raw
    new = pii.replaced(text, [found])
    if kind not in ("date", "ip", "phone"):
        assert re.sub(r"[A-Za-z]", "a", re.sub(r"\d", "9", new)) == re.sub(r"[A-Za-z]", "a", re.sub(r"\d", "9", text)) or kind in ("iban", "secret")
    assert [v[2] for v in pii.values_of(new, KEY)] == [kind]
    assert pii.replaced(new, pii.values_of(new, KEY, back=True)) == text


@pytest.mark.parametrize("kind,raw,text", [("iban", "AT61 1904 3002 3457 3201", "{} BIC"), ("iban", "ES9121000418450200051332", "{} EUR"), ("iban", "BE68 5390 0754 7034", "{} NOW"),
                                           ("iban", "BE68 5390 0754 7034", "{} 12 EUR"), ("iban", "DE89370400440532013000", "IBAN {} 2024 PAID"), ("iban", "AT61 1904 3002 3457 3201", "AB12 3456 7890 {} X"),
                                           ("phone", "555-123-4567", "Tel.{}"), ("card", "4111 1111 1111 1111", "Card.{}"), ("ssn", "123-45-6789", "No.{}."), ("phone", "555 123 4567", "call {} now"),
                                           ("phone", "555 123 4567", "{}")])
def test_values_beside_other_words(kind, raw, text):
    given = text.format(raw)
    values = pii.values_of(given, b"k")
    assert [(k, given[a:b]) for a, b, k, _ in values] == [(kind, raw)]
    made = pii.replaced(given, values)
    assert raw not in made and pii.replaced(made, pii.values_of(made, b"k", back=True)) == given


def test_ibans_one_after_the_other():
    text = "AT61 1904 3002 3457 3201 BE68 5390 0754 7034 DE89 3704 0044 0532 0130 00"
    assert [text[a:b] for a, b in pii.ibans(text)] == ["AT61 1904 3002 3457 3201", "BE68 5390 0754 7034", "DE89 3704 0044 0532 0130 00"]


@pytest.mark.parametrize("text", ["1.555-123-4567", "12 555 123 4567", "555 123 4567 8"])
def test_parts_of_longer_numbers_stay(text):
    assert not pii.values_of(text, b"k")


def test_permutation_is_one_to_one():
    for size in (1, 2, 10, 257, 1000):
        made = [pii.permuted(v, size, KEY, "t") for v in range(size)]
        assert sorted(made) == list(range(size)) and [pii.permuted(v, size, KEY, "t", back=True) for v in made] == list(range(size))


@pytest.mark.parametrize("text", ["4111 1111 1111 1112", "1234567", "2023-02-30", "300.1.1.1", "1.2.3.4.5", "666-12-3456", "version 3.14159", "a@b", "x12345678901234567890y", "1/2/3"])
def test_other_numbers_stay(text):
    assert pii.values_of(text, KEY) == []


def test_pseudonyms_of_odd_tables(spark, odd_docs):
    got = pii.pseudonymise(odd_docs, KEY)
    assert got.columns == ["doc_id", "text", "found"] and sorted(map(repr, (r.text for r in got.collect()))) == sorted(map(repr, (r.text for r in odd_docs.collect())))


def test_toxicity_holds_out_and_finds(spark):
    """Nine of ten held-out toxic documents, from all labels and from a sample with as many toxic rows as others."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = lambda: F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    n_toxic = labels.where(~held()).where("toxic = 1").count()
    for rows_per_class in (6000, n_toxic):
        model = toxicity.fit(docs, labels.where(~held()), rows_per_class=rows_per_class)
        got = toxicity.scores(docs, model).join(labels.where(held()), "doc_id").collect()
        assert all(0 <= r.score <= 1 for r in got) and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)
        clean, toxic = [r.score for r in got if r.toxic == 0], [r.score for r in got if r.toxic == 1]
        assert len(toxic) > 10 and sum(s < 0.3 for s in clean) >= 0.97 * len(clean) and sum(s >= 0.3 for s in toxic) >= 0.9 * len(toxic)


@pytest.mark.parametrize("share", [0.05, 0.3, 0.5, 0.7])
def test_words_are_mined_at_every_share_of_toxic_rows(spark, share):
    import random
    rng = random.Random(9)
    common, planted = ["".join(rng.choice("abcdeilnorst") for _ in range(6)) for _ in range(300)], ["grumblefog", "snarkwad", "blatherpus"]
    rows = []
    for i in range(1500):
        toxic = int(i < 1500 * share)
        words = [rng.choice(common) for _ in range(40)] + ([rng.choice(planted) for _ in range(3)] if toxic else [])
        rng.shuffle(words)
        rows.append((" ".join(words), toxic))
    keys = toxicity.mined_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert all(any(k.rstrip("-") and w.startswith(k.rstrip("-")) for k in keys) for w in planted)
    assert not set(keys) & set(common)


def test_toxicity_of_odd_tables(spark, odd_docs):
    for labels in ([], [(1, 1), (1, 0), (5, None), (None, 1)], [(1, 1), (5, 0), (6, 0)]):
        model = toxicity.fit(odd_docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
        got = toxicity.scores(odd_docs, model, odd_docs.columns, name="_gl_score")
        assert got.count() == odd_docs.count() and got.where("_gl_score is null or _gl_score not between 0 and 1").count() == 0
