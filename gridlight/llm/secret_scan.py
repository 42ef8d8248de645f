"""Secrets in whole texts, with DataFrame and SQL functions only; nothing is shuffled.

Three patterns give the base spans: assignments to names of secrets, access key ids and long hexadecimal strings.  For all
other secrets the Shannon entropy of sliding windows decides: a candidate is a longest run of a character class of at least a
window's length; a fold over its characters keeps how often each symbol stands in the window and the sum of ``c * log2(c)`` over
these counts, of which a step changes two terms.  Windows of enough bits, put together, are spans of the class.  Candidates
on the allow list, or behind a word that tells what they are, are left out before.  Sums are whole numbers of 2^-20 bits, so
they do not depend on the order of the steps.
"""

from __future__ import annotations

import math
import re
import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns and the least length of what they find.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"    # the longest runs of 24 or more are those of ``[0-9a-f]+`` that are long enough
LEAST = {"assign": 6, "access": 20, "hex": 24}

UNITS = 1 << 20
GROUP, BLOCK = 256, 4096
FOUND = "array<struct<start:int,stop:int,value:string,before:string>>"


class Symbols(NamedTuple):
    """A character class: windows of ``window`` characters with ``bits`` or more of entropy are taken for random."""
    kind: str
    symbols: str
    window: int
    bits: float

    @property
    def pattern(self) -> str:
        return f"[{re.escape(''.join(sorted(self.symbols)))}]{{{self.window},}}"

    @property
    def table(self) -> list[int]:
        """``c * log2(c)`` of each count a window can hold."""
        return [round(c * math.log2(c) * UNITS) if c else 0 for c in range(self.window + 1)]

    @property
    def most(self) -> int:
        """The largest sum over the table at which a window has ``bits``."""
        return math.floor(self.window * (math.log2(self.window) - self.bits) * UNITS)


CLASSES = (Symbols("random_hex", string.hexdigits, 20, 3.0), Symbols("random_base64", string.ascii_letters + string.digits + "+/_=-", 20, 3.95))
# A random string has letters beside digits; dates, paths, numbers and words do not.
MIXED = "[A-Za-z][0-9]|[0-9][A-Za-z]"
ALLOWED = ("^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
           "(?i)example|placeholder|changeme|dummy|your[_-]|xxxx|0123456789|abcdefgh")
ALLOWED_BEFORE = (";base64,", "sha1:", "sha256:", "sha512:", "sha1-", "sha256-", "sha384-", "sha512-", "md5:", "commit ", "revision ")


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are worked out once, however often they are used: the optimizer does not look into a generator."""
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_gl_held")
    return df.select("*", made).select(*[f"`{c}`" for c in df.columns], *[f"_gl_held.{n}" for n in columns])


def placed(found: str, pieces: str) -> str:
    """SQL: start, stop and value of every match, and the end of what stands before it.  Lengths are added up in groups of matches,
    so that no long list is copied for each of its elements."""
    here = f"length(get({pieces}, i))"
    one = f"struct(b.at + {here} AS start, b.at + {here} + length(get({found}, i)) AS stop, get({found}, i) AS value, right(get({pieces}, i), 12) AS before)"
    group = f"""aggregate(sequence(g * {GROUP}, least(g * {GROUP} + {GROUP}, size({found})) - 1), struct(coalesce(get(done, size(done) - 1).at, 0) AS at, CAST(array() AS {FOUND}) AS out),
        (b, i) -> struct(b.at + {here} + length(get({found}, i)) AS at, concat(b.out, array({one})) AS out))"""
    return f"""CASE WHEN size({found}) = 0 THEN CAST(array() AS {FOUND}) ELSE flatten(transform(aggregate(sequence(0, (size({found}) - 1) div {GROUP}),
        CAST(array() AS array<struct<at:int,out:{FOUND}>>), (done, g) -> concat(done, array({group}))), x -> x.out)) END"""


def windows(value: str, c: Symbols) -> str:
    """SQL: (a, b) of the stretches of ``value`` that windows of enough entropy cover."""
    low, n = min(map(ord, c.symbols)), max(map(ord, c.symbols)) - min(map(ord, c.symbols)) + 1
    more = "array(" + ", ".join(f"{b - a}L" for a, b in zip(c.table, c.table[1:])) + ")"    # from c to c + 1
    new, old = "get(codes, i)", f"get(codes, i - {c.window})"
    gain, loss = f"get({more}, get(s.counts, {new}))", f"coalesce(get({more}, get(s.counts, {old}) - 1), 0L)"
    step = f"""transform(array(struct(CASE WHEN {old} = {new} THEN s.counts ELSE transform(s.counts, (v, p) -> v + CASE WHEN p = {new} THEN 1 WHEN p = {old} THEN -1 ELSE 0 END) END AS counts,
        s.total + CASE WHEN {old} = {new} THEN 0L ELSE {gain} - {loss} END AS total)), t -> struct(t.counts AS counts, t.total AS total,
        CASE WHEN i >= {c.window - 1} AND t.total <= {c.most}L THEN CASE WHEN s.a < 0 THEN i - {c.window - 1} ELSE s.a END WHEN i - {c.window - 1} >= s.b THEN -1 ELSE s.a END AS a,
        CASE WHEN i >= {c.window - 1} AND t.total <= {c.most}L THEN i + 1 ELSE s.b END AS b,
        CASE WHEN s.a >= 0 AND t.total > {c.most}L AND i - {c.window - 1} >= s.b THEN concat(s.runs, array(struct(s.a AS a, s.b AS b))) ELSE s.runs END AS runs))[0]"""
    start = f"struct(array_repeat(0, {n}) AS counts, 0L AS total, -1 AS a, 0 AS b, CAST(array() AS array<struct<a:int,b:int>>) AS runs)"
    done = "s -> CASE WHEN s.a >= 0 THEN concat(s.runs, array(struct(s.a AS a, s.b AS b))) ELSE s.runs END"
    # a long value goes block by block, each with the first characters of the next one, so that the arrays stay short
    cut = f"CASE WHEN length({value}) <= {BLOCK} THEN array({value}) ELSE regexp_extract_all({value}, '.{{1,{BLOCK}}}', 0) END"
    codes = f"transform(split(concat(get(blocks, k), coalesce(left(get(blocks, k + 1), {c.window - 1}), '')), ''), x -> ascii(x) - {low})"
    fold = f"transform(array({codes}), codes -> aggregate(sequence(0, size(codes) - 1), {start}, (s, i) -> {step}, {done}))[0]"
    moved = f"transform({fold}, r -> struct(r.a + {BLOCK} * k AS a, r.b + {BLOCK} * k AS b))"
    runs = f"flatten(transform(array({cut}), blocks -> flatten(transform(blocks, (x, k) -> {moved}))))"
    return joined(runs)


def joined(runs: str) -> str:
    """SQL: (a, b) in their order, those that meet as one."""
    last = "get(m, size(m) - 1)"
    one = f"""aggregate(all, CAST(array() AS array<struct<a:int,b:int>>), (m, r) -> CASE WHEN size(m) > 0 AND r.a <= {last}.b
        THEN concat(slice(m, 1, size(m) - 1), array(struct({last}.a AS a, r.b AS b))) ELSE concat(m, array(r)) END)"""
    return f"transform(array({runs}), all -> CASE WHEN size(all) < 2 THEN all ELSE {one} END)[0]"


def long_enough(kind: str):
    """Whether a match of a base pattern counts."""
    if kind == "assign":
        return lambda x: F.length(F.regexp_extract(x["value"], ASSIGN, 2)) >= LEAST[kind]
    return lambda x: F.length(x["value"]) >= LEAST[kind]


def span(k: int, kind: str):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("k"), x["stop"].alias("stop"), F.lit(kind).alias("kind"), x["value"].alias("value"))


def unknown(allowed: tuple[str, ...], allowed_before: tuple[str, ...]):
    """Whether a candidate mixes letters and digits and is on no list."""
    def keep(x):
        known = F.lit(False)
        for p in allowed:
            known = known | x["value"].rlike(p)
        for end in allowed_before:
            known = known | F.lower(x["before"]).endswith(end)
        return x["value"].rlike(MIXED) & ~known
    return keep


def found(docs: DataFrame, classes: tuple[Symbols, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED, allowed_before: tuple[str, ...] = ALLOWED_BEFORE,
          carry: list[str] | None = None, text_col: str = "text", prefix: str = "") -> DataFrame:
    """The columns ``carry`` (doc_id) of every row and ``spans``, its name behind ``prefix``: an array of start, stop (characters, end
    exclusive), kind and value, by start and then kind: assign, access, hex, then ``classes`` in their order.

    ``allowed`` are patterns found in a candidate, ``allowed_before`` ends of the text before it (in lower case, 12 characters at
    most) that keep it from being measured; spans of the three base kinds stay whatever the lists say, and spans of different kinds
    may overlap.  A null or empty text has no spans, repeated rows are searched alike, columns not carried are left out."""
    carry = carry or ["doc_id"]
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX} | {c.kind: c.pattern for c in classes}
    kinds = list(patterns)
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_gl_c{i}") for i, c in enumerate(carry)], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_gl_text"))
    rows = held(rows, **{f"_gl_f{k}": F.regexp_extract_all("_gl_text", F.lit(p), F.lit(0)) for k, p in enumerate(patterns.values())})
    rows = held(rows, **{f"_gl_p{k}": F.when(F.size(f"_gl_f{k}") > 0, F.split("_gl_text", p, -1)) for k, p in enumerate(patterns.values())})
    rows = held(rows, **{f"_gl_m{k}": F.expr(placed(f"_gl_f{k}", f"_gl_p{k}")) for k in range(len(kinds))})
    spans = []
    for k, kind in enumerate(kinds):
        if kind in LEAST:
            rows = held(rows, **{f"_gl_s{k}": F.transform(F.filter(f"_gl_m{k}", long_enough(kind)), span(k, kind))})
        else:
            rows = held(rows, **{f"_gl_w{k}": F.filter(f"_gl_m{k}", unknown(allowed, allowed_before))})
            rows = held(rows, **{f"_gl_s{k}": F.expr(f"""flatten(transform(_gl_w{k}, x -> transform({joined(windows("x.value", classes[k - len(LEAST)]))},
                r -> struct(x.start + r.a AS start, {k} AS k, x.start + r.b AS stop, '{kind}' AS kind, substr(x.value, r.a + 1, r.b - r.a) AS value))))""")})
        spans.append(f"_gl_s{k}")
    rows = held(rows, _gl_spans=F.array_sort(F.concat(*spans)))
    plain = F.transform("_gl_spans", lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"), x["value"].alias("value")))
    return rows.select(*[F.col(f"_gl_c{i}").alias(c) for i, c in enumerate(carry)], plain.alias(f"{prefix}spans"))


def listed(spans: Column) -> Column:
    """``kind:start:stop`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
