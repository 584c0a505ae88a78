"""Vectorised word hashes: all words of many texts in a few array passes."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z counts as a-z
_MIX = _RNG.integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def stirred(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    up = np.full(n, _ODD, np.uint64)
    up[:1] = 1
    return np.multiply.accumulate(up)


_UP = _powers(1 << 16)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, number of words of each text); ASCII letters count in lower case."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    ends = np.cumsum(lengths)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    blank = _BLANK[data]
    inside = np.concatenate([[False], ~blank, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edges[::2], edges[1::2]
    size = last - first
    counts = np.diff(np.searchsorted(first, np.concatenate([[0], ends])))
    if not len(first):
        return np.zeros(0, np.uint64), counts
    global _UP
    if size.max() > len(_UP):
        _UP = _powers(int(size.max()) * 2)
    # Position within the word: position in the data less that of the word's first byte.
    step = np.ones(len(data), np.int32)
    step[0] = 0
    step[first[1:]] = first[:-1] - first[1:] + 1
    step[:first[0] + 1] = 0
    place = np.cumsum(step, out=step)
    place[blank] = 0
    values = _BYTE[data]
    values *= _UP[place]
    values[blank] = 0
    return stirred(np.add.reduceat(values, first) + size.astype(np.uint64) * _MIX[0]), counts


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of runs of `width` words, sorted; fewer words make one run, none make none."""
    if not len(words):
        return words
    span = min(width, len(words))
    n = len(words) - span + 1
    mixed = np.full(n, np.uint64(span), np.uint64)
    for o in range(span):
        mixed = stirred(mixed * _MIX[1] + words[o:o + n])
    return np.unique(mixed)
