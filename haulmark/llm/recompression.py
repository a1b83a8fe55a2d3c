"""Exact removal of repeated word strings, by recompression.

A word goes if it lies in a window of `LENGTH` words that also starts elsewhere, in the same text or
another. Texts are compressed in rounds, each of which names runs of one symbol (its name and
length) and then pairs: a symbol's hash bit of the round says whether it opens or closes a pair, and
an opening one followed by a closing one becomes a new symbol. Names are hashes of what they stand
for, so all tasks give the same names in all rounds without a shared dictionary.

A symbol depends on the words it stands for and on some beside them: the neighbours that it did not
merge with. These words are its `reach`, kept exactly round by round. Wherever the same words stand,
the same symbol arises, so equal windows have the same interior symbols (those whose reach is
inside). A window's anchor is an interior symbol of the highest level that it has, by the least hash
of its reach; that a window has no symbol of a level, as in periodic texts, is equal in equal windows
too, and words are symbols of level 0. Shared anchors reveal where windows may be repeated, and the
names of runs of windows, and then of windows, verify it (`repeats`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .common import row_chunks, text_bytes, unused
from .repeats import PLACE_BITS
from .shingles import PLACE, POWERS, SPACE, U, mix

LENGTH = 35
#: The most words that a symbol of each level may reach over to be an anchor; there is one round less than levels.
REACH = [1, 5, 10]
ROUNDS = len(REACH) - 1
#: Words of a piece of a long text, and bytes of texts that make one piece.
CHUNK, CHUNK_BYTES = 1 << 17, 1 << 18
#: Beyond any text.
FAR = 1 << 40
BYTE, OTHER = np.random.default_rng(20240615).integers(1, 1 << 63, (2, 256), np.uint64) * U(2) + U(1)
NONE = ~U(0)


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words [^\\x20\\x09-\\x0D]+ of these texts start and end, and how many there are before each text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets[(offsets > 0) & (offsets < len(data))]] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | edge[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class Level:
    """Symbols of one level, in order: names, places from `start`, and the reach from `low` to before `high`."""

    def __init__(self, name: np.ndarray, text: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.name, self.text, self.start, self.low, self.high = name, text, start, low, high

    def beside(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How far to the left and right one sees with the neighbours (past the text, too far), and which symbols end a text."""
        last = np.ones(len(self.name), bool)
        last[:-1] = self.text[1:] != self.text[:-1]
        left, right = np.full(len(self.name), -FAR), np.full(len(self.name), FAR)
        left[1:] = np.where(last[:-1], -FAR, self.low[:-1])
        right[:-1] = np.where(last[:-1], FAR, self.high[1:])
        return left, right, last

    def joined(self, first: np.ndarray, last: np.ndarray, names: np.ndarray, low: np.ndarray, high: np.ndarray) -> Level:
        """Symbols from each of `first` to `last`, with these names. Inside a text, reaches begin and end in the order of
        the symbols, so those of the first and last count."""
        return Level(names, self.text[first], self.start[first], low[first], high[last])

    def runs(self) -> Level:
        """Runs of one symbol as one; a symbol that stays alone is seen to have other neighbours."""
        left, right, end = self.beside()
        low, high = np.minimum(self.low, left), np.maximum(self.high, right)
        new = np.ones(len(self.name), bool)
        new[1:] = (self.name[1:] != self.name[:-1]) | end[:-1]
        if new.all():
            return Level(self.name, self.text, self.start, low, high)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(self.name)) - 1
        name = self.name[first].copy()
        many = np.flatnonzero(last > first)
        name[many] = mix(name[many] * PLACE[10] + (last - first + 1)[many].astype(np.uint64) * PLACE[11])
        return self.joined(first, last, name, low, high)

    def pairs(self, number: int) -> Level:
        """Pairs of an opening and a closing symbol as one; one that stays alone is seen to have no such neighbour."""
        left, right, end = self.beside()
        closing = (mix(self.name + PLACE[20 + number]) & U(1)).astype(bool)
        second = np.zeros(len(self.name), bool)
        second[1:] = ~closing[:-1] & closing[1:] & ~end[:-1]
        opened = np.append(second[1:], False)
        low = np.where(closing & ~second, np.minimum(self.low, left), self.low)
        high = np.where(~closing & ~opened, np.maximum(self.high, right), self.high)
        first = np.flatnonzero(~second)
        name, pair = self.name[first].copy(), np.flatnonzero(opened[first])
        name[pair] = mix(name[pair] * PLACE[12] + self.name[first[pair] + 1] * PLACE[13])
        return self.joined(first, first + opened[first], name, low, high)


class WordWindows:
    """Windows of the words of some texts, and their runs of one anchor."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, anchored: bool = True) -> None:
        """`starts` and `ends` of words in `data`; each text has its words from counts[i] to before counts[i + 1]. Runs
        are found only if windows are to be `anchored`."""
        n = len(starts)
        self.count = max(0, n - LENGTH + 1)
        empty = np.zeros(0, np.int64)
        self.text = self.first = self.last = empty
        self.anchor = self.name = self.check = np.zeros(0, np.uint64)
        if not self.count:
            return
        up, down = POWERS.upto(max(len(data), n) + 1)
        self.down = down
        self.sums = []
        for table in (BYTE, OTHER):
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(table[data] * up[: len(data)], out=total[1:])
            words = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
            del total
            self.sums.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[:n]))))
            if table is BYTE:
                symbols = words
        if not anchored:
            return
        text = np.repeat(np.arange(len(counts) - 1), np.diff(counts))
        whole = text[: self.count] == text[LENGTH - 1 : LENGTH - 1 + self.count]
        if not whole.any():
            return
        places = np.arange(n)
        levels = [Level(symbols, text, places, places, places + 1)]
        for number in range(ROUNDS):
            levels.append(levels[-1].runs().pairs(number))
        level = np.full(self.count, -1, np.int8)
        best = np.full(self.count, NONE)
        for number in range(ROUNDS, -1, -1):
            lacking = whole & (level < 0)
            if not lacking.any():
                break
            found = self._least(levels[number], number)
            here = lacking & (found != NONE)
            best[here], level[here] = found[here], number
        start = np.flatnonzero(whole)
        at, level = (best[start] & ((U(1) << PLACE_BITS) - U(1))).astype(np.int64), level[start]
        new = np.ones(len(start), bool)
        new[1:] = (at[1:] != at[:-1]) | (level[1:] != level[:-1]) | (text[start[1:]] != text[start[:-1]])
        begin = np.flatnonzero(new)
        self.first, self.text = start[begin], text[start[begin]]
        self.last = start[np.append(begin[1:], len(start)) - 1]
        at, level = at[begin], level[begin]
        self.anchor, low = np.zeros(len(begin), np.uint64), np.zeros(len(begin), np.int64)
        for number, own in enumerate(levels):
            of = level == number
            low[of], high = own.low[at[of]], own.high[at[of]]
            self.anchor[of] = self._key(low[of], high, own.start[at[of]], number)
        shape = (low - self.first).astype(np.uint64) * PLACE[1] + (self.last - self.first).astype(np.uint64) * PLACE[2]
        self.name, self.check = (mix((x[self.last + LENGTH] - x[self.first]) * down[self.first] + shape) for x in self.sums)

    def _key(self, low: np.ndarray, high: np.ndarray, start: np.ndarray, number: int) -> np.ndarray:
        """A hash of the words of a reach, and of which symbol of them it is."""
        x = self.sums[0]
        return mix((x[high] - x[low]) * self.down[low] + (high - low).astype(np.uint64) * PLACE[3] + (start - low).astype(np.uint64) * PLACE[4] + U(number))

    def _least(self, level: Level, number: int) -> np.ndarray:
        """For each window the least key of a symbol inside, with the symbol in its low bits. A symbol lies inside if
        REACH words from where its reach begins do, which is the same in equal windows."""
        best = np.full(len(self.sums[0]) - 1, NONE)
        use = np.flatnonzero((level.low >= 0) & (level.high - level.low <= REACH[number]))
        low = level.low[use]
        np.minimum.at(best, low, (self._key(low, level.high[use], level.start[use], number) >> PLACE_BITS << PLACE_BITS) | use.astype(np.uint64))
        # the least of `wide` places, from the running least of blocks either way
        wide, n = LENGTH - REACH[number] + 1, self.count
        blocks = np.full(-(-(n + wide - 1) // wide) * wide, NONE)
        blocks[: n + wide - 1] = best[: n + wide - 1]
        blocks = blocks.reshape(-1, wide)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        return np.minimum(behind[:n], ahead[wide - 1 : wide - 1 + n])

    def names(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both names of the windows that start at these places."""
        return tuple(mix((x[at + LENGTH] - x[at]) * self.down[at] ^ U(0x9FB21C651E98DF25)) for x in self.sums)


class WordCutter:
    """Windows of LENGTH words, in pieces of long texts that begin `chunk` words apart."""

    LENGTH = LENGTH

    def __init__(self, chunk: int = CHUNK) -> None:
        self.CHUNK = chunk

    def pieces(self, batches: Iterator[pa.RecordBatch], text_at: int, anchored: bool = True) -> Iterator[tuple[pa.RecordBatch, WordWindows, np.ndarray, int]]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(text_at))
            for i, j in row_chunks(offsets, CHUNK_BYTES):
                own = data[offsets[i] : offsets[j]]
                starts, ends, counts = word_places(own, offsets[i : j + 1] - offsets[i])
                if len(starts) <= self.CHUNK + LENGTH:
                    yield batch.slice(i, j - i), WordWindows(own, starts, ends, counts, anchored), counts, 0
                    continue
                # many texts of short words, or one long text: text by text and piece by piece
                for row in range(i, j):
                    before, after = counts[row - i], counts[row - i + 1]
                    for start in range(before, max(before + 1, after - LENGTH + 1), self.CHUNK):
                        a, b = starts[start : min(after, start + self.CHUNK + LENGTH - 1)], ends[start : min(after, start + self.CHUNK + LENGTH - 1)]
                        if len(a) >= LENGTH:
                            cuts = np.array([0, len(a)])
                            yield batch.slice(row, 1), WordWindows(own[a[0] : b[-1]], a - a[0], b - a[0], cuts, anchored), cuts, start - before

    def cut(self, text: np.ndarray, spans: list[int]) -> tuple[int, bytes]:
        starts, ends, _ = word_places(text, np.array([0, len(text)]))
        stay = np.ones(len(starts), bool)
        for a, b in zip(spans[::2], spans[1::2], strict=True):
            stay[a:b] = False
        # the bytes of words that stay, each with a space behind it
        starts, ends = starts[stay], ends[stay]
        if not len(starts):
            return len(stay), b""
        size = ends - starts + 1
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - starts, size)
        kept = text[np.minimum(at, len(text) - 1)]
        kept[np.cumsum(size) - 1] = 0x20
        return len(stay), kept[:-1].tobytes()


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_removed, spans, kept) of every row: `spans` has the first and the behind-last word of
    each removed stretch in turn, `kept` the remaining words, joined by one space, as UTF-8.

    `docs` is read once; its keys and texts are kept with the rows' numbers. Null and empty
    texts and those under LENGTH words lose nothing (but spaces); very long texts are looked at in
    pieces that share LENGTH - 1 words; of windows that occur twice no place is spared, so there are no
    ties; repeated rows repeat each other's windows; other columns are left out; a key with the name
    of an added column keeps it and the added one gets underscores; null keys stay; an empty table
    gives an empty table.
    """
    n_words, removed, spans, kept = unused([key], "n_words", "n_removed", "spans", "kept")
    found = repeats.without_repeats(docs, WordCutter(), text, key)
    return found.select(F.col("key").alias(key), F.col("size").alias(n_words), F.col("n_removed").alias(removed), F.col("spans").alias(spans), F.col("kept").alias(kept))
