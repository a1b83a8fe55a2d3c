"""Strings of a fixed number of units (bytes or words) that start in two places, by the names of runs.

What a unit is, and which anchor a window of LENGTH units has, is up to a `Cutter`; equal windows
have equal anchors at equal offsets. Consecutive windows of one anchor are a run; tuples (anchor name,
run name, place) are grouped by name:

1. A run whose name occurs twice is repeated as a whole.
2. Runs that stand alone under an anchor that occurs elsewhere hold the ends of repeats. Only they
   (and one copy of each repeated run beside them) are named again, window by window, and grouped.

Names are two independent 64-bit hashes, which both have to agree. Names that a task has met twice
need no grouping to be known as repeated: their places are passed on under keys of their own, so a
string that a third of all rows share reaches its group once from each task. Names of frequent
anchors are dealt to parts by run name.

Texts are numbered and bucketed by number once. What is asked of them and what is removed is dealt by
the same number, so texts are never shuffled again, whatever their size.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bucketed, forget, materialize, row_chunks, small_batches, text_bytes
from .shingles import PLACE, U, mix

#: Low bits of a packed value that hold a place in a piece; a piece has fewer units.
PLACE_BITS = U(21)
FREQUENT, BUFFER, LEAST_SEEN, PART = 1 << 20, 1 << 20, 4, 4096
#: Bytes of texts that are cut at once.
CHUNK_BYTES = 1 << 20
#: Repeated names that a task remembers.
SEEN = 1 << 20


class Windows(Protocol):
    """The windows of a piece: `count` places where one may start, and runs of consecutive ones of one anchor."""

    count: int
    text: np.ndarray  # of each run, its row in the piece
    first: np.ndarray  # and its first and last window
    last: np.ndarray
    anchor: np.ndarray
    name: np.ndarray
    check: np.ndarray

    def names(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both names of the windows that start at these places."""


class Cutter(Protocol):
    """How texts become windows. Texts over CHUNK units come in pieces that begin CHUNK units apart and share
    LENGTH - 1, so that each window is in one piece."""

    LENGTH: int
    CHUNK: int

    def pieces(self, batches: Iterator[pa.RecordBatch], text_at: int, anchored: bool = True) -> Iterator[tuple[pa.RecordBatch, Windows, np.ndarray, int]]:
        """Rows with their windows, the unit where each row begins, and how far into the text the piece does. Runs are
        wanted only if `anchored`."""

    def cut(self, text: np.ndarray, spans: list[int]) -> tuple[int, bytes]:
        """How many units a text has, and what is left without the spans (starts and ends in turn)."""


class Repeats:
    """Which names a task has met before: at once in a piece, or as repeated in an earlier one."""

    def __init__(self) -> None:
        self.known = self.checks = np.zeros(0, np.uint64)

    def sift(self, names: np.ndarray, checks: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each name whether it is known as repeated without grouping, and the weight (1, or 2 for
        repeated names) under which it goes to its group. One of each newly repeated name goes there."""
        known = np.zeros(len(names), bool)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, names), len(self.known) - 1)
            known = (self.known[at] == names) & (self.checks[at] == checks)
        every, first, back = np.unique(names, return_index=True, return_inverse=True)
        alike = checks == checks[first][back]  # others of the same first name are left to the groups
        weight = np.bincount(back, np.where(alike, weights, 0), minlength=len(every))
        lone = ~alike
        lone[first] = True
        done = known | ~lone
        fresh = (weight > 1) & ~known[first]
        if len(self.known) + fresh.sum() > SEEN:
            self.known = self.checks = np.zeros(0, np.uint64)
        place = np.searchsorted(self.known, every[fresh])
        self.known, self.checks = np.insert(self.known, place, every[fresh]), np.insert(self.checks, place, checks[first][fresh])
        return done, np.where(alike, np.minimum(weight[back], 2), np.minimum(weights, 2)).astype(np.int32)


def frequent_anchors(docs: DataFrame, cutter: Cutter) -> dict[str, np.ndarray]:
    """Anchors that tasks see often, with about how often: at most FREQUENT by their share."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def often() -> pa.RecordBatch:
            names, seen = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            rest = int(seen[seen < LEAST_SEEN].sum())
            names, seen = names[seen >= LEAST_SEEN], seen[seen >= LEAST_SEEN]
            return pa.record_batch([pa.array([*names.view(np.int64).tolist(), None], pa.int64()), pa.array([*seen.tolist(), rest], pa.int64())], ["anchor", "seen"])

        for _, w, _, _ in cutter.pieces(batches, 0):
            held.append(w.anchor)
            size += len(held[-1])
            if size >= BUFFER:
                yield often()
                held.clear()
                size = 0
        yield often()

    counts = materialize(docs.select("text").mapInArrow(per_batch, "anchor long, seen long").groupBy("anchor").agg(F.sum("seen").alias("seen")))
    total = counts.agg(F.sum("seen")).first()[0] or 0
    rows = counts.where("anchor is not null").where(F.col("seen") >= max(2 * LEAST_SEEN, total // FREQUENT)).toArrow()
    forget(counts)
    names = rows.column("anchor").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(names)
    return {"a": names[order], "n": rows.column("seen").to_numpy().astype(np.int64)[order]}


def runs(docs: DataFrame, cutter: Cutter, frequent: dict[str, np.ndarray]) -> DataFrame:
    """(anchor, part, name, check, weight, rid, first, count, hot, done) of the runs of (rid, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    names = ["anchor", "part", "name", "check", "weight", "rid", "first", "count", "hot", "done"]

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, seen = shared.value["a"], shared.value["n"]
        repeats = Repeats()
        for rows, w, offsets, start in cutter.pieces(batches, 1):
            if not len(w.name):
                continue
            done, weight = repeats.sift(w.name, w.check, np.ones(len(w.name)))
            rid = rows.column(0).to_numpy()[w.text]
            times = np.zeros(len(w.name), np.int64)
            if len(common):
                at = np.minimum(np.searchsorted(common, w.anchor), len(common) - 1)
                times = np.where(common[at] == w.anchor, seen[at], 0)
            part = (w.name % np.maximum(1, -(-times // PART)).astype(np.uint64)).astype(np.int32)
            # what is known already sorts under a key of its own
            key = np.where(done, mix(w.name ^ mix(rid.astype(np.uint64) + w.first.astype(np.uint64) * PLACE[3])), w.anchor)
            first = w.first - offsets[w.text] + start
            columns = [key.view(np.int64), part, w.name.view(np.int64), w.check.view(np.int64), weight, rid, first, (w.last - w.first + 1).astype(np.int32), times > 0, done]
            yield pa.record_batch([pa.array(c) for c in columns], names)

    return docs.select("rid", "text").mapInArrow(per_batch, "anchor long, part int, name long, check long, weight int, rid long, first long, count int, hot boolean, done boolean")


def named_windows(docs: DataFrame, cutter: Cutter) -> DataFrame:
    """(name, check, weight, rid, first, count, done) of the windows of the runs that (rid, text, runs) asks
    for; runs: (first, count, kind), kind 2 for runs that are known to be repeated."""
    names = ["name", "check", "weight", "rid", "first", "count", "done"]

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeats = Repeats()
        for rows, w, offsets, start in cutter.pieces(batches, 1, anchored=False):
            asked = rows.column(2)
            lens = np.diff(asked.offsets.to_numpy())
            flat = asked.flatten()
            first, count, kind = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            owner = np.repeat(np.arange(len(lens)), lens)
            first = first - start + offsets[owner]
            # the runs that lie in this piece
            inside = (first >= offsets[owner]) & (first < w.count) & (first - offsets[owner] < cutter.CHUNK)
            first, count, kind, owner = first[inside], count[inside], kind[inside], owner[inside]
            if not len(first):
                continue
            at = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
            kind, owner = np.repeat(kind, count), np.repeat(owner, count)
            name, check = w.names(at)
            done, weight = repeats.sift(name, check, np.where(kind == 2, 2, 1))
            rid, place = rows.column(0).to_numpy()[owner], at - offsets[owner] + start
            send = ~done
            yield pa.record_batch([pa.array(c) for c in (name[send].view(np.int64), check[send].view(np.int64), weight[send], rid[send], place[send], np.ones(send.sum(), np.int32), done[send])], names)
            # known windows of asked runs, as stretches of consecutive ones
            known = np.flatnonzero(done & (kind == 1))
            if len(known):
                new = np.ones(len(known), bool)
                new[1:] = (place[known[1:]] != place[known[:-1]] + 1) | (rid[known[1:]] != rid[known[:-1]])
                begin = np.flatnonzero(new)
                size = np.diff(np.append(begin, len(known))).astype(np.int32)
                head = known[begin]
                key = mix(name[head] ^ mix(rid[head].astype(np.uint64) + place[head].astype(np.uint64) * PLACE[3]))
                yield pa.record_batch([pa.array(c) for c in (key.view(np.int64), check[head].view(np.int64), np.full(len(head), 2, np.int32), rid[head], place[head], size, np.ones(len(head), bool))], names)

    return docs.select("rid", "text", "runs").mapInArrow(per_batch, "name long, check long, weight int, rid long, first long, count int, done boolean")


def repeated(docs: DataFrame, cutter: Cutter) -> DataFrame:
    """(rid, first, count): stretches of repeated windows in texts of (rid, text), bucketed by rid."""
    by_anchor, by_name = W.partitionBy("anchor", "part"), W.partitionBy("anchor", "part", "name", "check")
    # dealt once, as both windows need it: left to the planner, names would be dealt first and anchors again
    seen = runs(docs, cutter, frequent_anchors(docs, cutter)).repartition("anchor", "part")
    seen = seen.withColumn("times", F.sum("weight").over(by_name)).withColumn("place", F.min(F.struct("rid", "first")).over(by_name))
    seen = seen.withColumn("all", F.sum("weight").over(by_anchor)).withColumn("least", F.min("times").over(by_anchor))
    known = F.col("done") | (F.col("times") > 1)
    lead = ~F.col("done") & (F.col("place.rid") == F.col("rid")) & (F.col("place.first") == F.col("first"))
    beside = F.col("hot") | (F.col("least") == 1)
    kind = F.when(~known & (F.col("hot") | (F.col("all") > 1)), 1).when(known & lead & beside, 2).when(known, 0)
    level = materialize(seen.select("rid", "first", "count", kind.alias("kind")).where("kind is not null"))
    asked = level.where("kind > 0").groupBy("rid").agg(F.collect_list(F.struct("first", "count", "kind")).alias("runs"))
    asked = materialize(asked)
    some = docs.join(asked.hint("shuffle_hash"), "rid")
    windows = named_windows(some, cutter).withColumn("times", F.sum("weight").over(W.partitionBy("name", "check")))
    windows = windows.where("done or times > 1").select("rid", "first", "count")
    return level.where("kind <> 1").select("rid", "first", "count").union(windows)


def _merged(firsts: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the units that these windows cover, as maximal stretches."""
    order = np.argsort(firsts, kind="stable")
    first, end = firsts[order], np.maximum.accumulate((firsts + counts - 1 + length)[order])
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > end[:-1]
    begin = np.flatnonzero(new)
    return first[begin], end[np.append(begin[1:], len(first)) - 1]


def stretches(places: DataFrame, length: int) -> DataFrame:
    """(rid, spans): the removed (start, end) of each text of (rid, first, count), merged."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for one in batch.column(1):
                rows = one.values
                start, end = _merged(*(rows.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2)), length)
                out.append(np.stack((start, end), 1).ravel())
            yield pa.record_batch([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["rid", "spans"])

    grouped = places.groupBy("rid").agg(F.collect_list(F.struct("first", "count")).alias("x"))
    return grouped.mapInArrow(per_batch, "rid long, spans array<long>")


def without_repeats(docs: DataFrame, cutter: Cutter, text: str, key: str) -> DataFrame:
    """(key, size, n_removed, spans, kept) of every row: `size` in units, `spans` the removed starts and ends in
    turn, `kept` what is left."""
    small_batches(docs.sparkSession)
    docs = bucketed(docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("rid")), "rid")
    spans = materialize(stretches(repeated(docs, cutter), cutter.LENGTH))
    joined = docs.join(spans.hint("shuffle_hash"), "rid", "left").select("key", "text", "spans")
    names = ["key", "size", "n_removed", "spans", "kept"]

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in row_chunks(offsets, CHUNK_BYTES):
                some = batch.slice(i, j - i)
                cut = [x or [] for x in some.column(2).to_pylist()]
                kept = [cutter.cut(data[offsets[row] : offsets[row + 1]], x) for row, x in enumerate(cut, i)]
                removed = [sum(x[1::2]) - sum(x[::2]) for x in cut]
                columns = (pa.array([k[0] for k in kept], pa.int64()), pa.array(removed, pa.int64()), pa.array(cut, pa.list_(pa.int64())), pa.array([k[1] for k in kept], pa.binary()))
                yield pa.record_batch([some.column(0), *columns], names)

    kind = docs.schema["key"].dataType.simpleString()
    return joined.mapInArrow(per_batch, f"key {kind}, size long, n_removed long, spans array<long>, kept binary")
