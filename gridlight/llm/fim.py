"""Fill-in-the-middle form of whole texts: two cuts between units, the middle moved to the end behind markers.

A unit is a run of ASCII letters or one other character.  A text is walked once in blocks of fixed length; of each block only the
number of units that begin in it and of its characters is kept, in a Fenwick tree.  A cut after ``u`` units is the place where
the next unit begins: binary lifting goes down the tree to the last block that fewer or as many units begin before, which
gives the block's first character too, and only that block is looked at again.  So a text of any length needs a few numbers a
block beside itself.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlight.llm.tables import map_columns

BLOCK = 1024
MARKERS = ("<P>", "<S>", "<M>")


class Fenwick:
    """Sums of prefixes of two counts at once; ``descend`` goes by the first."""

    def __init__(self, counts: np.ndarray):
        """``counts``: (n, 2)."""
        self.tree = np.concatenate((np.zeros((1, 2), np.int64), counts))
        for i in range(1, len(self.tree)):
            if (up := i + (i & -i)) < len(self.tree):
                self.tree[up] += self.tree[i]

    def descend(self, most: int) -> tuple[int, int, int]:
        """The largest number of leading entries whose first counts sum to ``most`` or less, and both sums over them."""
        at, first, second = 0, 0, 0
        step = 1 << (len(self.tree) - 1).bit_length()
        while step:
            if (to := at + step) < len(self.tree) and first + self.tree[to, 0] <= most:
                at, first, second = to, first + int(self.tree[to, 0]), second + int(self.tree[to, 1])
            step >>= 1
        return at, first, second


def begins(text: str, start: int, stop: int) -> np.ndarray:
    """Whether a unit begins at each character of ``text[start:stop]``."""
    before = start - (start > 0)
    codes = np.frombuffer(text[before:stop].encode("utf-32-le", "surrogatepass"), "<u4")
    letter = ((codes | 32) - np.uint32(97)) < 26    # A-Z and a-z differ in the bit of 32 alone
    follows = np.zeros(len(codes), bool)
    follows[1:] = letter[1:] & letter[:-1]
    return ~follows[start - before:]


class Units:
    """Where the units of a text begin."""

    def __init__(self, text: str, block: int = BLOCK):
        self.text, self.block = text, block
        sizes = [(np.count_nonzero(begins(text, a, a + block)), min(block, len(text) - a)) for a in range(0, len(text), block)]
        self.tree = Fenwick(np.array(sizes, np.int64).reshape(-1, 2))
        self.n = sum(s[0] for s in sizes)

    def after(self, units: int) -> int:
        """The character behind the first ``units`` units."""
        if units >= self.n:
            return len(self.text)
        _, before, start = self.tree.descend(units)
        return start + int(np.flatnonzero(begins(self.text, start, start + self.block))[units - before])


def checked(markers: tuple[str, str, str]) -> tuple[str, str, str]:
    """``markers`` if an output can be read in one way only: no marker holds another one or begins with the end of one."""
    clash = any(a[-k:] == b[:k] for a in markers for b in markers for k in range(1, min(len(a), len(b)) + (a is not b)))
    if "" in markers or clash or any(a in b for i, a in enumerate(markers) for j, b in enumerate(markers) if i != j):
        raise ValueError(f"markers {markers} cannot be told apart")
    return markers


def rearranged(text: str, key: str, seed: int, markers: tuple[str, str, str], plain_percent: int, spm_percent: int, block: int) -> tuple:
    """(units, form, characters of the prefix, of the middle, output) of one text."""
    p, s, m = markers
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    one, two, plain, order = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
    units = Units(text, block)
    if not text or p in text or s in text or m in text or plain % 100 >= 100 - plain_percent:
        return units.n, "plain", None, None, text
    a, b = sorted(units.after(h % (units.n + 1)) for h in (one, two))
    if order % 100 < spm_percent:
        return units.n, "spm", a, b - a, f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}"
    return units.n, "psm", a, b - a, f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"


def transformed(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, markers: tuple[str, str, str] = MARKERS, carry: list[str] | None = None,
                id_col: str = "doc_id", text_col: str = "text", prefix: str = "", block: int = BLOCK) -> DataFrame:
    """The columns ``carry`` (doc_id) of every row and, their names behind ``prefix``, n (units), form (plain, psm or spm),
    prefix_chars, middle_chars (null if plain) and output.

    Cuts and form follow from the SHA-256 of the seed and the id alone.  Plain are ``plain_percent`` of the texts, empty texts and
    those that hold a marker; ``spm_percent`` of the others begin with the suffix.  A null text is an empty one, a null id
    counts as an empty string, repeated rows give repeated results, and columns not carried are left out."""
    checked(markers)

    def run(keys, texts):
        made = [rearranged(t or "", "" if k is None else k, seed, markers, plain_percent, spm_percent, block) for k, t in zip(keys, texts)]
        return [list(c) for c in zip(*made)] if made else [[] for _ in range(5)]

    names = ("n bigint", "form string", "prefix_chars bigint", "middle_chars bigint", "output string")
    keyed = docs.withColumn("_gl_key", F.col(f"`{id_col}`").cast("string"))
    return map_columns(keyed, ["_gl_key", text_col], run, ", ".join(prefix + c for c in names), carry or [id_col])


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made of."""
    p, s, m = (F.lit(x) for x in checked(markers))
    between = lambda a, b: F.split_part(F.split_part(output, a, F.lit(2)), b, F.lit(1))
    middle = F.split_part(output, m, F.lit(2))
    return F.when(form == "psm", F.concat(between(p, s), middle, between(s, m))).when(form == "spm", F.concat(between(p, m), middle, between(s, p))).otherwise(output)
