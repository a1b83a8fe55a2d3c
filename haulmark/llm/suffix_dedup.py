"""Exact removal of repeated byte strings, by the names of content-defined windows.

A byte goes if it lies in a string of `LENGTH` bytes that also starts elsewhere, in the same text
or another. This is not an induced suffix sort: only whether a window of LENGTH bytes occurs twice
is asked for, so windows are named and grouped (`repeats`), and suffixes are never put in order. In each
window the smallest hash of KGRAM bytes is its anchor. Equal windows have equal anchors at equal
offsets, so comparing windows of equal anchors compares all that can be equal.
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
from .shingles import PLACE, POWERS, U, mix

LENGTH, KGRAM = 200, 100
REACH = LENGTH - KGRAM + 1
CHUNK = 1 << 20
BYTE, OTHER = np.random.default_rng(20240301).integers(1, 1 << 63, (2, 256), np.uint64) * U(2) + U(1)


class Windows:
    """Hashes of all windows of one piece (the bytes of some texts), and their runs."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, anchored: bool = True) -> None:
        n = len(data)
        self.total, self.other = np.zeros((2, n + 1), np.uint64)
        up, self.down = POWERS.upto(n + 1)
        np.cumsum(BYTE[data] * up[:n], out=self.total[1:])
        np.cumsum(OTHER[data] * up[:n], out=self.other[1:])
        self.count = max(0, n - LENGTH + 1)
        empty = np.zeros(0, np.int64)
        self.text = self.first = self.last = empty
        self.anchor = self.name = self.check = np.zeros(0, np.uint64)
        if not self.count or not anchored:
            return
        grams = n - KGRAM + 1
        gram = mix((self.total[KGRAM:] - self.total[:grams]) * self.down[:grams])
        packed = (gram >> PLACE_BITS << PLACE_BITS) | np.arange(grams, dtype=np.uint64)
        # the least of each REACH consecutive values, from the running least of blocks either way
        blocks = np.full(-(-grams // REACH) * REACH, ~U(0))
        blocks[:grams] = packed
        blocks = blocks.reshape(-1, REACH)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[: self.count], ahead[REACH - 1 : REACH - 1 + self.count])
        at = (least & ((U(1) << PLACE_BITS) - U(1))).astype(np.int64)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        whole = np.flatnonzero(text[: self.count] == text[LENGTH - 1 : LENGTH - 1 + self.count])
        if not len(whole):
            return
        at, text = at[whole], text[whole]
        new = np.ones(len(whole), bool)
        new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
        begin = np.flatnonzero(new)
        self.first, self.text = whole[begin], text[begin]
        self.last = whole[np.append(begin[1:], len(whole)) - 1]
        at = at[begin]
        self.anchor = gram[at]
        shape = (at - self.first).astype(np.uint64) * PLACE[1] + (self.last - self.first).astype(np.uint64) * PLACE[2]
        self.name, self.check = (mix((x[self.last + LENGTH] - x[self.first]) * self.down[self.first] + shape) for x in (self.total, self.other))

    def names(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both names of the windows that start at these places."""
        return tuple(mix((x[at + LENGTH] - x[at]) * self.down[at] ^ U(0x9FB21C651E98DF25)) for x in (self.total, self.other))


class ByteCutter:
    """Windows of LENGTH bytes, in pieces of long texts that begin `chunk` bytes apart."""

    LENGTH = LENGTH

    def __init__(self, chunk: int = CHUNK) -> None:
        self.CHUNK = chunk

    def pieces(self, batches: Iterator[pa.RecordBatch], text_at: int, anchored: bool = True) -> Iterator[tuple[pa.RecordBatch, Windows, np.ndarray, int]]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(text_at))
            for i, j in row_chunks(offsets, self.CHUNK):
                own, cuts = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                if len(own) <= self.CHUNK + LENGTH:
                    yield batch.slice(i, j - i), Windows(own, cuts, anchored), cuts, 0
                else:
                    for start in range(0, len(own) - LENGTH + 1, self.CHUNK):
                        piece = own[start : start + self.CHUNK + LENGTH - 1]
                        cuts = np.array([0, len(piece)])
                        yield batch.slice(i, 1), Windows(piece, cuts, anchored), cuts, start

    def cut(self, text: np.ndarray, spans: list[int]) -> tuple[int, bytes]:
        edges = [0, *spans, len(text)]
        return len(text), b"".join(text[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2], strict=True))


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_removed, spans, kept) of every row: `spans` has the removed starts and ends in
    turn, `kept` the remaining bytes.

    `docs` is read once; its keys and texts are kept with the rows' numbers. Null and empty
    texts and those under LENGTH bytes lose nothing; very long texts are looked at in pieces that
    share LENGTH - 1 bytes; of strings that occur twice no place is spared, so there are no ties;
    repeated rows repeat each other's strings; other columns are left out; a key with the name of an
    added column keeps it and the added one gets underscores; an empty table gives an empty table.
    """
    n_bytes, removed, spans, kept = unused([key], "n_bytes", "n_removed", "spans", "kept")
    found = repeats.without_repeats(docs, ByteCutter(), text, key)
    return found.select(F.col("key").alias(key), F.col("size").alias(n_bytes), F.col("n_removed").alias(removed), F.col("spans").alias(spans), F.col("kept").alias(kept))
