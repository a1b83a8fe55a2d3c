"""Hashed word shingles of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
_RNG = np.random.default_rng(20240229)
#: A random odd number for each byte, with A-Z as a-z.
BYTE = _RNG.integers(1, 1 << 63, 256, np.uint64) * U(2) + U(1)
BYTE[ord("A") : ord("Z") + 1] = BYTE[ord("a") : ord("z") + 1]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
PLACE = _RNG.integers(1, 1 << 63, 64, np.uint64) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Powers:
    """Powers of BASE and of its inverse, as many as asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            for name, base in (("up", BASE), ("down", INVERSE)):
                table = np.full(size, base, np.uint64)
                table[0] = 1
                setattr(self, name, np.multiply.accumulate(table))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of all texts, and the number of each word's text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    space = SPACE[data]
    begin = ~space
    begin[1:] &= space[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < n]
    begin[inner] = ~space[inner]
    stop = ~space
    stop[:-1] &= space[1:]
    last = inner[inner > 0] - 1
    stop[last] = ~space[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    up, down = POWERS.upto(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[data] * up[:n], out=total[1:])
    words = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return words, np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes of each text, sorted by text and hash, and their texts.

    A text of fewer words has its whole sequence as one; a text without words has none.
    """
    words, text = word_hashes(data, offsets)
    n_texts = len(offsets) - 1
    if not len(words):
        return words, text
    m = len(words) - k + 1
    if m > 0:
        sums = words[:m] * PLACE[0]
        for j in range(1, k):
            sums = sums + words[j : m + j] * PLACE[j]
        same = text[:m] == text[k - 1 :]
        hashes, owner = mix(sums[same]), text[:m][same]
    else:
        hashes, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counts = np.bincount(text, minlength=n_texts)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first = np.concatenate(([0], np.cumsum(counts)))[short]
        sums = np.full(len(short), U(0x5851F42D4C957F2D)) * counts[short].astype(np.uint64)
        for j in range(k - 1):
            some = counts[short] > j
            sums[some] += words[first[some] + j] * PLACE[k + j]
        hashes, owner = np.concatenate((hashes, mix(sums))), np.concatenate((owner, short))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], owner[new]
