"""Passages of benchmark items in documents, found with one Aho-Corasick automaton over normalised words."""

from __future__ import annotations

import re
import uuid

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlight.llm.tables import map_columns, written

# Bytes of UTF-8 text: A-Z become a-z, other ASCII characters than letters and digits become a space.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


def line_of(words: list[bytes]) -> str:
    """Words with one space around each; bytes stand as characters, so that the automaton walks bytes."""
    return f" {b' '.join(words).decode('latin-1')} " if words else ""


def windows(benchmark: DataFrame, size: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item string, win): the distinct windows of ``size`` consecutive words of each item; an item of fewer words is
    one window, an item without words has none."""
    def run(items, texts):
        out = []
        for item, text in zip(items, texts):
            words = words_of(text)
            out += {(item, line_of(words[i:i + size])) for i in range(max(1, len(words) - size + 1))} if words else ()
        return [[x[0] for x in out], [x[1] for x in out]]
    source = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return map_columns(source, ["item", "text"], run, "item string, win string").distinct()


_BUILT: dict[str, ahocorasick.Automaton] = {}


def automaton(key: str, patterns) -> ahocorasick.Automaton:
    """The automaton of one part of the windows; a worker holds one at a time."""
    if key not in _BUILT:
        _BUILT.clear()
        made = ahocorasick.Automaton()
        for win, items in patterns.value:
            made.add_word(win, (len(win), win.count(" ") - 1, items))
        made.make_automaton()
        _BUILT[key] = made
    return _BUILT[key]


def spans_of(text: str, hit: set[int]) -> list[tuple[int, int]]:
    """Character ranges of the original text from the first to the last word of each run of hit words."""
    spans, last = [], -2
    for i, m in enumerate(WORD.finditer(text)):
        if i in hit:
            spans = [*spans[:-1], (spans[-1][0], m.end())] if last == i - 1 else [*spans, (m.start(), m.end())]
            last = i
    return spans


def find_items(docs: DataFrame, benchmark: DataFrame, size: int = 10, part_chars: int = 4_000_000, carry: list[str] | None = None, text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", prefix: str = "") -> DataFrame:
    """Where documents repeat windows of benchmark items.

    Returns the columns ``carry`` (doc_id) of every row and, their names behind ``prefix``, n_words, hit (indices of the words
    inside any occurrence of a window), items (ids as strings, sorted, of the items whose windows occur) and spans (start and
    end of each hit passage in the original text).

    The windows and the ids of their items reach the workers as broadcast parts of about ``part_chars`` characters, chosen
    by the hash of both, so that a window of very many items is in several parts with some of them in each; a larger benchmark
    is scanned part by part, each over whole texts.  A null or empty text has no words; items with a null id
    hit words but are not listed; repeated documents and items change nothing; columns not carried are left out."""
    spark, carry = docs.sparkSession, carry or ["doc_id"]
    wins = written(windows(benchmark, size, item_col, item_text_col), "windows")
    chars = wins.agg(F.sum(F.length("win") + F.coalesce(F.length("item"), F.lit(0)))).first()[0] or 0
    parts = max(1, -(-chars // part_chars))
    text = [] if text_col in carry else [text_col]    # kept beside the results while there are more parts
    schema = f"{prefix}n_words bigint, {prefix}hit array<int>, {prefix}items array<string>, {prefix}spans array<struct<start:int,end:int>>"
    found = docs
    for part in range(parts):
        chosen = wins.where(F.pmod(F.xxhash64("win", "item"), F.lit(parts)) == part).groupBy("win").agg(F.sort_array(F.collect_set("item")).alias("items"))
        patterns = spark.sparkContext.broadcast([(r.win, r.items) for r in chosen.collect()])
        before = [f"{prefix}hit", f"{prefix}items"] if part else []

        def run(texts, hits=None, items=None, key=uuid.uuid4().hex, patterns=patterns):
            walk = automaton(key, patterns) if patterns.value else None
            return scanned(walk, texts, hits or [()] * len(texts), items or [()] * len(texts))

        found = map_columns(found, [text_col, *before], run, schema, [*carry, *(text if part < parts - 1 else [])])
        if part < parts - 1:
            found = written(found, "scanned")
    return found


def scanned(walk, texts: list[str | None], hits: list, items: list) -> list[list]:
    """Word counts, hit words, items and spans of texts, with what earlier parts of the windows have hit."""
    counts, all_hits, all_items, spans = [], [], [], []
    for text, hit, names in zip(texts, hits, items):
        words, hit, names = words_of(text), set(hit), set(names)
        if walk is not None and words:
            line = line_of(words)
            at, first = 0, -1
            for end, (length, n, of) in walk.iter(line):
                start = end - length + 1
                if start >= at:
                    first += line.count(" ", at, start + 1)
                    at = start + 1
                    begin = first
                else:
                    begin = first - line.count(" ", start + 1, at)
                hit.update(range(begin, begin + n))
                names.update(of)
        counts.append(len(words))
        all_hits.append(sorted(hit))
        all_items.append(sorted(names))
        spans.append([{"start": a, "end": b} for a, b in spans_of(text, hit)] if hit else [])
    return [counts, all_hits, all_items, spans]
