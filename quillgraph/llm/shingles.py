"""Hashed word shingles of many texts at once, in numpy.

Words are runs of anything but ASCII white space, with A-Z lower-cased.  A
word's hash is a polynomial over random 64-bit values of its bytes, taken from
one running sum over a piece of the buffer, so the cost is a few vector operations
a byte whatever the number of texts.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_VALUE[65:91] = _VALUE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.cumprod(p)
    return _POWERS[0], _POWERS[1]


#: Bytes whose running sum is held at once; a longer word is taken whole.
PIECE = 1 << 20


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and for each text the index of its first word (n + 1 entries)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    words = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):  # words that end within a piece from the first one's start
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + PIECE, "right")))
        part = buf[base : ends[j - 1]]
        up, down = _powers(len(part) + 1)
        run = np.empty(len(part) + 1, np.uint64)
        run[0] = 0
        np.cumsum(_VALUE[part] * up[: len(part)], out=run[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        words[i:j] = mix((run[b] - run[a]) * down[a] + (b - a).astype(np.uint64))
        i = j
    if len(_POWERS[0]) > 4 * PIECE:  # after a very long word
        _POWERS[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    return words, np.searchsorted(starts, offsets)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``size``-word shingles.

    A text of fewer words has its whole sequence as one shingle; a text without
    words has none.
    """
    words, first = word_hashes(buf, offsets)
    n = max(0, len(words) - size + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(size):
        rolled = mix(rolled + words[k : k + n] * np.uint64(2 * k + 3))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            s = np.sort(rolled[a : b - size + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            h = np.zeros(1, np.uint64)
            for k in range(b - a):
                h = mix(h + words[a + k : a + k + 1] * np.uint64(2 * k + 3))
            out.append(mix(h + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
