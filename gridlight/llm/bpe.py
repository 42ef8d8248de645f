"""Byte-pair encoding with a priority queue of merges over a doubly linked symbol list, and decoding."""

from __future__ import annotations

import heapq
import json
import re
import sys
from array import array
from itertools import pairwise

import regex

# The split pattern and the printable stand-ins for bytes of byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_letters() -> dict[int, str]:
    """Byte -> the character that stands for it in vocabulary strings."""
    others = [b for b in range(256) if b not in PRINTABLE]
    return {b: chr(b) for b in PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(others)}


class Recent(dict):
    """The newest entries; when they are ``keep``, they become the old generation and the former old one goes."""

    def __init__(self, keep: int):
        super().__init__()
        self.keep, self.old = keep, {}

    def put(self, key, value):
        if len(self) >= self.keep:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class BytePairs:
    """Encoder and decoder of a byte-level vocabulary file.

    A text is cut at added tokens (taken as they are), then by ``SPLIT``; each piece starts as one symbol per byte.
    Pieces seen lately are kept in two generations of at most ``keep`` each, so memory stays bounded however many
    distinct words a corpus has."""

    def __init__(self, path: str, keep: int = 500_000):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.first = [vocab[letters[b]] for b in range(256)]
        self.rank_of = {vocab[a] << 20 | vocab[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made_of = [vocab[a + b] for a, b in pairs]
        self.bytes_of = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.added.items()}
        self.split, self.space_runs = regex.compile(SPLIT), re.compile(r"\s | \s")
        at_added = "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))
        self.at_added = regex.compile(f"({at_added})") if at_added else None
        self.pieces, self.words = Recent(keep), Recent(keep // 4)

    def merge(self, piece: bytes) -> list[int]:
        """Symbols of one piece after all merges.

        ``ids`` holds the symbols, ``left`` and ``right`` link the live ones.  A queue entry is a rank and a position in
        one integer; it is stale when the two neighbours now at its position no longer merge with that rank."""
        first = self.first
        ids = [first[b] for b in piece]
        n = len(ids)
        if n < 2:
            return ids
        rank_of, made_of, push, pop = self.rank_of, self.made_of, heapq.heappush, heapq.heappop
        bits = n.bit_length()
        low = (1 << bits) - 1
        queue = [rank << bits | i for i, (a, b) in enumerate(pairwise(ids)) if (rank := rank_of.get(a << 20 | b)) is not None]
        if not queue:
            return ids
        heapq.heapify(queue)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        while queue:
            entry = pop(queue)
            i, rank = entry & low, entry >> bits
            j = right[i]
            if j < 0 or ids[i] < 0 or rank_of.get(ids[i] << 20 | ids[j]) != rank:
                continue
            ids[i] = made = made_of[rank]
            ids[j] = -1
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if (found := rank_of.get(made << 20 | ids[k])) is not None:
                    push(queue, found << bits | i)
            h = left[i]
            if h >= 0 and (found := rank_of.get(ids[h] << 20 | made)) is not None:
                push(queue, found << bits | h)
        return [x for x in ids if x >= 0]

    def packed(self, word: str) -> bytes:
        """Ids of a word as little-endian unsigned 32-bit integers; a word is one or more pieces."""
        if (found := self.pieces.get(word)) is not None:
            return found
        split = self.split.findall(word)
        if len(split) != 1:
            return self.words.put(word, b"".join([self.pieces.get(x) or self.packed(x) for x in split]))
        if (found := self.pieces.old.get(word)) is None:
            ids = array("I", self.merge(word.encode()))
            if sys.byteorder == "big":
                ids.byteswap()
            found = ids.tobytes()
        return self.pieces.put(word, found)

    def encode_packed(self, text: str) -> bytes:
        """A single space between two other characters always begins a piece, so texts without runs of white space are
        cut at spaces and looked up word by word."""
        parts, out, pieces, words, packed = (self.at_added.split(text) if self.at_added else [text]), [], self.pieces, self.words, self.packed
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.added[part].to_bytes(4, "little"))
            elif self.space_runs.search(part):
                out += [pieces.get(x) or packed(x) for x in self.split.findall(part)]
            elif part:
                cut = part.replace(" ", "\x00 ").split("\x00") if "\x00" not in part else self.split.findall(part)
                out += [pieces.get(x) or words.get(x) or words.old.get(x) or packed(x) for x in cut if x]
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return unpack(self.encode_packed(text)).tolist()

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids) -> str:
        """Vocabulary strings of the ids put together; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


def unpack(packed: bytes) -> array:
    ids = array("I", packed)
    if sys.byteorder == "big":
        ids.byteswap()
    return ids


_LOADED: dict[str, BytePairs] = {}


def loaded(path: str) -> BytePairs:
    """The encoder of a vocabulary file, read once per worker."""
    if path not in _LOADED:
        _LOADED[path] = BytePairs(path)
    return _LOADED[path]
