"""64-bit hashes of words and word shingles of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
ROOT = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(ROOT), -1, 1 << 64))
LETTER = np.random.default_rng(20_240_611).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SEGMENT = 1 << 20
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ROOT ** i and its inverse for i below at least n, modulo 2 ** 64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((ROOT, BACK)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _segment(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of the words of a byte array that begins and ends between words."""
    space = SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(len(data))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(LETTER[data] * up[:len(data)])))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, offsets of the texts among them).

    Words are runs of other characters than ASCII white space, A-Z lowered.  A word's hash depends on its bytes alone."""
    encoded = [(t or "").encode().translate(LOWER) for t in texts]
    begins = np.cumsum([0, *(len(e) + 1 for e in encoded)])
    data = np.frombuffer(b"\n".join([*encoded, b""]), np.uint8)
    hashes, starts, at = [], [], 0
    while at < len(data):
        stop = min(len(data), at + SEGMENT)
        if stop < len(data):    # a segment ends at white space, however long its last word
            cut = np.flatnonzero(SPACE[data[at:stop]])
            if len(cut):
                stop = at + int(cut[-1]) + 1
            else:
                more = next((stop + i + int(np.flatnonzero(SPACE[data[stop + i:stop + i + SEGMENT]])[0]) + 1 for i in range(0, len(data) - stop, SEGMENT)
                             if SPACE[data[stop + i:stop + i + SEGMENT]].any()), len(data))
                stop = more
        h, s = _segment(data[at:stop])
        hashes.append(h)
        starts.append(s + at)
        at = stop
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), begins).astype(np.int64)


def shingles(texts: list[str | None], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of ``size`` words, offsets of the texts); a text of fewer words, but not none, is one run."""
    words, offsets = word_hashes(texts)
    lengths = np.diff(offsets)
    counts = np.where(lengths >= size, lengths - size + 1, np.minimum(lengths, 1))
    ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)))
    begin = np.repeat(offsets[:-1] - ends[:-1], counts) + np.arange(ends[-1])
    padded = np.concatenate((words, np.zeros(size, np.uint64)))
    whole = np.repeat(lengths, counts)
    out = np.zeros(len(begin), np.uint64)
    for k in range(size):
        out = out * ROOT + np.where(k < whole, padded[begin + k], np.uint64(0))
    return mixed(out + np.minimum(whole, size).astype(np.uint64)), ends
