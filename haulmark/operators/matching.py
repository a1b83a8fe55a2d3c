"""Largest matchings of many groups at once, as rounds of joins, with a witness where one can't cover.

Free left sides propose in a few rounds; then trees of alternating ways grow from those still free, layer
by layer. A right side joins one tree only, so trees never share a place, and every tree that meets a
free right side flips the way to it in the same round. A tree stops when it has met one. When no tree
meets any, the matching is as large as can be, and what the trees hold is Hall's witness: left sides
that know fewer right sides together than they are. Rows are dealt by (group, side), so a group may
hold any share of all rows. Groups of FEW options or fewer don't need rounds: each is a row, and its ways are
looked for where the row lies. The witness is the same for every largest matching, so both tell the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from haulmark.functions import hashing

from .lineage import forget, settle

#: Rounds of proposals before ways are looked for.
PROPOSALS = 3
#: Options of a group that is matched in one row.
FEW = 1024


def covered(ways: list[list[int]], rights: int) -> tuple[list[int], list[bool]]:
    """The right side of each left one in a largest matching (-1: none), and which left sides alternating ways from
    uncovered ones reach. ways: the right sides that each left one knows."""
    mate, holder, stuck = [-1] * len(ways), [-1] * rights, [False] * len(ways)
    for root in range(len(ways)):
        came, queue, end = {}, [root], -1
        for a in queue:
            for b in ways[a]:
                # what a tree without an end holds leads nowhere later either
                if b in came or (holder[b] >= 0 and stuck[holder[b]]):
                    continue
                came[b] = a
                if holder[b] < 0:
                    end = b
                    break
                queue.append(holder[b])
            if end >= 0:
                break
        if end < 0:
            for a in queue:
                stuck[a] = True
        while end >= 0:
            a = came[end]
            mate[a], holder[end], end = end, a, mate[a]
    return mate, stuck


def _in_rows(options: DataFrame) -> DataFrame:
    """(group, left, right, stuck) of every left side of groups that are rows: its right side, if it has one, and
    whether it is in the witness, as its right side then is too."""
    kinds = [f"{c} {options.schema[c].dataType.simpleString()}" for c in ("group", "left", "right")]
    packed = options.groupBy("group").agg(F.sort_array(F.collect_set(F.struct("left", "right"))).alias("o"))

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, offsets = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            # numbers instead of sides, the same in all groups of a batch
            left, right = (flat.field(i).dictionary_encode() for i in (0, 1))
            ls, rs = (x.indices.to_numpy() for x in (left, right))
            group, one, other, stuck = [], [], [], []
            for at, (i, j) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                mine, ways, places = {}, [], {}
                for a, b in zip(ls[i:j].tolist(), rs[i:j].tolist(), strict=True):
                    if a not in mine:
                        mine[a] = len(ways)
                        ways.append([])
                    ways[mine[a]].append(places.setdefault(b, len(places)))
                mate, held = covered(ways, len(places))
                names = list(places)
                group += [at] * len(ways)
                one += mine
                other += [names[m] if m >= 0 else None for m in mate]
                stuck += held
            yield pa.record_batch([
                batch.column(0).take(pa.array(np.array(group, np.int64))), left.dictionary.take(pa.array(np.array(one, np.int64))), right.dictionary.take(pa.array(other, pa.int64())), pa.array(stuck, pa.bool_()),
            ], ["group", "left", "right", "stuck"])

    return packed.mapInArrow(per_batch, ", ".join([*kinds, "stuck boolean"]))


def _proposed(options: DataFrame, pairs: DataFrame, number: int) -> DataFrame:
    """`pairs` and those that arise as each free left side asks one free right side, and that takes one."""
    free = options.join(pairs, ["group", "left"], "left_anti").join(pairs, ["group", "right"], "left_anti")
    order = F.struct(hashing.stable_long(F.col("left"), F.col("right"), F.lit(number)), "right")
    asked = free.groupBy("group", "left").agg(F.min_by("right", order).alias("right"))
    taken = asked.groupBy("group", "right").agg(F.min("left").alias("left"))
    return settle(pairs.union(taken.select("group", "left", "right")))


def _trees(options: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(group, right, left, root) of each right side met, by the left side that it was met from, and the ends
    (group, root, right): the free right side that a tree met first."""
    front = settle(options.select("group", "left").distinct().join(pairs, ["group", "left"], "left_anti").select("group", "left", F.col("left").alias("root")))
    held = pairs.select("group", "right", F.col("left").alias("holder"))
    met, ends = None, None
    while not front.isEmpty():
        reach = front.join(options, ["group", "left"])
        if met is not None:
            reach = reach.join(met, ["group", "right"], "left_anti")
        one = reach.groupBy("group", "right").agg(F.min(F.struct("root", "left")).alias("x")).select("group", "right", "x.left", "x.root")
        layer = settle(one.join(held, ["group", "right"], "left"))
        here = layer.select("group", "right", "left", "root")
        met = here if met is None else met.union(here)
        found = settle(layer.where("holder IS NULL").groupBy("group", "root").agg(F.min("right").alias("right")))
        ends = found if ends is None else ends.union(found)
        front = settle(layer.where("holder IS NOT NULL").join(found, ["group", "root"], "left_anti").select("group", F.col("holder").alias("left"), "root"))
    if met is None:
        nothing = options.limit(0)
        return nothing.select("group", "right", "left", F.col("left").alias("root")), nothing.select("group", F.col("left").alias("root"), "right")
    return met, ends


def _flipped(pairs: DataFrame, met: DataFrame, ends: DataFrame) -> DataFrame:
    """`pairs` with the ways from the ends back to the roots changed over."""
    to = ends.select("group", "right")
    new = []
    while True:
        step = settle(to.join(met, ["group", "right"]).select("group", "left", "right", "root"))
        new.append(step.select("group", "left", "right"))
        on = step.where("left <> root").select("group", "left")
        if on.isEmpty():
            break
        to = pairs.join(on, ["group", "left"], "left_semi").select("group", "right")
    changed = reduce(DataFrame.union, new)
    return settle(pairs.join(changed, ["group", "left"], "left_anti").union(changed))


def matched(options: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs (group, left, right) of a largest matching of the options (group, left, right), and the witness
    (group, side, member): left and right sides that alternating ways from uncovered left ones reach.

    In a group's witness there are more left than right sides, by as many as stay uncovered; a group
    that is covered has none. Null sides match nothing; repeated options count once.
    """
    options = settle(options.dropna(subset=["left", "right"]))
    if not all(isinstance(options.schema[c].dataType, AtomicType) for c in ("left", "right")):
        return _in_rounds(options)
    many = settle(options.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FEW).select("group"))
    if many.isEmpty():
        return _told(settle(_in_rows(options)))
    # a null group is a group too
    large = options.join(F.broadcast(many) if many.count() <= FEW else many, options["group"].eqNullSafe(many["group"]), "left_semi")
    small = options.join(F.broadcast(many) if many.count() <= FEW else many, options["group"].eqNullSafe(many["group"]), "left_anti")
    return tuple(a.union(b) for a, b in zip(_told(settle(_in_rows(small))), _in_rounds(large), strict=True))


def _told(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs and witness, as of `matched`, of rows as of `_in_rows`."""
    stuck = rows.where("stuck")
    rights = stuck.where("right IS NOT NULL").select("group", F.lit("right").alias("side"), F.col("right").alias("member"))
    return rows.where("right IS NOT NULL").select("group", "left", "right"), stuck.select("group", F.lit("left").alias("side"), F.col("left").alias("member")).union(rights)


def _in_rounds(options: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs and witness, as of `matched`, of groups of any size."""
    options = settle(options.distinct())
    pairs = settle(options.limit(0))
    for number in range(PROPOSALS):
        before, pairs = pairs, _proposed(options, pairs, number)
        forget(before)
    while True:
        met, ends = _trees(options, pairs)
        if ends.isEmpty():
            break
        before, pairs = pairs, _flipped(pairs, met, ends)
        forget(before)
    free = options.select("group", "left").distinct().join(pairs, ["group", "left"], "left_anti")
    reached = met.join(pairs.select("group", "right", F.col("left").alias("holder")), ["group", "right"]).select("group", F.col("holder").alias("left"))
    lefts = free.union(reached).select("group", F.lit("left").alias("side"), F.col("left").alias("member"))
    return pairs, lefts.union(met.select("group", F.lit("right").alias("side"), F.col("right").alias("member")))


def by_sources(wanted: DataFrame, options: DataFrame, ranks: int) -> tuple[DataFrame, DataFrame]:
    """Groups matched from the first of their sources, by rank from 0, that covers all of `wanted` (group, left).

    options: (group, rank, left, right). Gives the pairs (group, rank, left, right) of groups that a source
    covers, and the attempts (group, rank, wanted, matched, stuck_left, stuck_right, accepted): a source that
    fails is told with the sizes of its witness. What has no option at all is a witness by itself. The
    groups that a rank has to serve shrink from one rank to the next.
    """
    wanted = settle(wanted.distinct())
    left = wanted
    pairs, attempts = [], []
    for rank in range(ranks):
        own = options.where(F.col("rank") == rank).select("group", "left", "right").join(left, ["group", "left"], "left_semi")
        found, witness = matched(own)
        alone = left.join(own, ["group", "left"], "left_anti").select("group", F.lit("left").alias("side"))
        stuck = witness.select("group", "side").union(alone).groupBy("group").agg(F.count_if(F.col("side") == "left").alias("stuck_left"), F.count_if(F.col("side") == "right").alias("stuck_right"))
        asked = left.groupBy("group").agg(F.count(F.lit(1)).alias("wanted"))
        got = found.groupBy("group").agg(F.count(F.lit(1)).alias("matched"))
        told = asked.join(got, "group", "left").join(stuck, "group", "left").select("group", F.lit(rank).alias("rank"), "wanted", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("matched", "stuck_left", "stuck_right")))
        told = settle(told.withColumn("accepted", F.col("matched") == F.col("wanted")))
        attempts.append(told)
        done = told.where("accepted").select("group")
        pairs.append(found.join(done, "group", "left_semi").select("group", F.lit(rank).alias("rank"), "left", "right"))
        left = settle(left.join(done, "group", "left_anti"))
        if left.isEmpty():
            break
    return reduce(DataFrame.union, pairs), reduce(DataFrame.union, attempts)
