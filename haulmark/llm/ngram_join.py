"""N-gram Jaccard join as a blocked sparse product of documents and shingles.

The incidence of documents (texts with equal sets are one) and hashed five-word shingles is
multiplied with its transpose, blocked by shingle. Size-derived bounds keep the product sparse: two
sets can only be similar if they share one of their first n - ceil(0.75 n) + 1 shingles in a common
order, so only those columns are laid out; the order puts rare shingles first, so that a passage of
thousands of documents takes part for documents that have little else. Which shingles are frequent
is counted over all documents for those with a hash under `COUNTED`, which come first; of the others,
what a task meets often. Overlaps that the blocks add up are held against what the sizes ask for,
and what stays is counted over the whole sets.

A large group of near copies would fill its columns with pairs. Columns first link their documents
to one pivot each, that with the largest share of frequent shingles: of near copies the least edited.
What becomes connected that way needs no further pairs, as only components are asked for. Pairs whose
parities (256 bits of each set) differ in more places than sets that link can are dropped where they
arise. Then every pair of different components that shares a column is looked at, so no link
between components is lost; and a pair is looked at only in columns that are among the first n - needed + 1 of
both sets, for the overlap that this pair needs: heavily edited copies of one text, which have so many
rare shingles in front that they can't link, don't meet in its columns. In the first turn frequent columns are split by salt, and pairs of
frequent pivots too; in the second, columns of many sets are split by sizes (only like sizes link)
and dealt to tiles, so that each pair meets in one tile and no task holds a whole column.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import few_bytes, forget, keep_keys, materialize, row_chunks, small_batches, text_bytes
from .components import connected
from .shingles import U, mix, shingle_sets

K = 5
#: Two sets link when PERCENT of their union is shared.
PERCENT = 75
CHUNK = 1 << 18
#: So many of the most frequent shingles at most are broadcast, and none that is in fewer documents than LEAST.
FREQUENT, LEAST = 1 << 18, 8
#: Shingles with hashes under COUNTED are counted exactly; of the others, those that are LEAST_SEEN times in a task's BUFFER.
COUNTED = U(int(0.4 * 2**64))
BUFFER, LEAST_SEEN = 1 << 20, 4
#: Documents of a frequent column that are dealt to one part, pairs of a pivot, and sets of a column on one side of a tile.
PART, PAIRS, TILE = 4096, 256, 256
#: Sizes in ratios over 4/3 are at least one class apart, and sets that link at most one.
CLASS = math.log(1.34)
#: Rows whose parities are counted at once.
COUNT_ROWS = 512
#: Words of 64 bits that hold the parities of a set's shingles by their hash.
WORDS = 4
PARITIES = [f"b{i}" for i in range(WORDS)]
#: Sets that a task remembers to have passed on.
SEEN = 1 << 17


def needed(na: Column, nb: Column) -> Column:
    """The least overlap of two sets of these sizes that link."""
    return F.ceil((na + nb) * PERCENT / (100 + PERCENT))


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - -(-n * PERCENT // 100) + 1


def _sets(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row chunks with their shingles, the shingles' rows, each row's set size and its node."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(text_at))
        for i, j in row_chunks(offsets, CHUNK):
            hashes, row = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], K)
            sizes = np.bincount(row, minlength=j - i)
            node = np.zeros(j - i, np.uint64)
            if len(hashes):
                begin = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                node[row[begin]] = mix(np.add.reduceat(mix(hashes ^ U(0x2545F4914F6CDD1D)), begin) + sizes[row[begin]].astype(np.uint64))
            yield batch.slice(i, j - i), hashes, row, sizes, node.view(np.int64)


def describe(docs: DataFrame) -> DataFrame:
    """(key, node, check, n, b0 ...) of the texts of (key, text). A node is a hash of the whole set, `check` another one.

    b0 ... are parities: two sets differ in as many shingles at least as their parities do in bits.
    """
    kind = docs.schema["key"].dataType.simpleString()

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, hashes, row, sizes, node in _sets(batches, 1):
            check = np.zeros(len(sizes), np.uint64)
            if len(hashes):
                begin = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                check[row[begin]] = np.bitwise_xor.reduceat(mix(hashes * U(3) + U(1)), begin)
            bit = ((hashes >> U(20)) % U(64 * WORDS)).astype(np.int64)
            words = np.zeros((len(sizes), WORDS), np.int64)
            for low in range(0, len(sizes), COUNT_ROWS):
                a, b = np.searchsorted(row, (low, low + COUNT_ROWS))
                some = words[low : low + COUNT_ROWS]
                odd = np.bincount((row[a:b] - low) * 64 * WORDS + bit[a:b], minlength=some.size * 64).astype(np.uint8) & 1
                some[:] = np.packbits(odd).view(np.int64).reshape(some.shape)
            yield pa.record_batch([rows.column(0), pa.array(node), pa.array(check.view(np.int64)), pa.array(sizes), *(pa.array(w) for w in words.T.copy())], names)

    names = ["key", "node", "check", "n", *PARITIES]
    return docs.mapInArrow(per_batch, f"key {kind}, node long, check long, n long, {', '.join(f'{b} long' for b in PARITIES)}")


class Unmet:
    """Which sets a task has not passed on yet, as far as it remembers."""

    def __init__(self) -> None:
        self.seen: set[int] = set()

    def among(self, node: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        new = np.zeros(len(node), bool)
        for i, one in enumerate(node.tolist()):
            if sizes[i] and one not in self.seen:
                new[i] = True
                self.seen.add(one)
        if len(self.seen) > SEEN:
            self.seen.clear()
        return new


def frequencies(docs: DataFrame) -> dict[str, np.ndarray]:
    """The most frequent shingles (h, sorted) and in how many documents about they are (n): FREQUENT at most."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        unmet, size = Unmet(), 0

        def counted() -> pa.RecordBatch:
            h, seen = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            held.clear()
            keep = (h < COUNTED) | (seen >= LEAST_SEEN)
            return pa.record_batch([pa.array(h[keep].view(np.int64)), pa.array(seen[keep].astype(np.int32))], ["h", "seen"])

        for _, hashes, row, sizes, node in _sets(batches, 0):
            held.append(hashes[unmet.among(node, sizes)[row]])
            size += len(held[-1])
            if size >= BUFFER:
                yield counted()
                size = 0
        yield counted()

    sums = docs.select("text").mapInArrow(per_batch, "h long, seen int").groupBy("h").agg(F.sum("seen").alias("n")).where(F.col("n") >= LEAST)
    sums = materialize(sums)
    # the least count of which no more than FREQUENT are left, from a few bins
    step = F.floor(F.log2("n") * 8).cast("int")
    bins = sums.groupBy(step.alias("bin")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("low")).orderBy(F.desc("bin")).collect()
    least, taken = None, 0
    for b in bins:
        taken += b.k
        if taken > FREQUENT:
            break
        least = b.low
    rows = sorted((r.h % (1 << 64), r.n) for r in sums.where(F.col("n") >= least).collect()) if least else []
    forget(sums)
    return {"h": np.array([h for h, _ in rows], np.uint64), "n": np.array([n for _, n in rows], np.int64)}


def columns(docs: DataFrame, frequent: dict[str, np.ndarray]) -> DataFrame:
    """(h, part, node, n, pull, at): the first columns of each set in the common order: rare shingles, then those
    that weren't counted, then frequent ones; `pull` is the share of frequent ones in the whole set, `at` the place
    in the order, from 0.

    A set that a task has passed on already is left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = shared.value["h"], shared.value["n"]
        unmet = Unmet()
        for _, hashes, row, sizes, node in _sets(batches, 0):
            rank = (hashes >= COUNTED).astype(np.int64)
            pull = np.zeros(len(sizes), np.int32)
            if len(common) and len(hashes):
                near = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
                often = common[near] == hashes
                rank = np.where(often, counts[near], rank)
                pull = (np.bincount(row, often, len(sizes)) * 1000 / np.maximum(sizes, 1)).astype(np.int32)
                if often.any():
                    order = np.lexsort((hashes, rank, row))
                    hashes, rank, row = hashes[order], rank[order], row[order]
            new = unmet.among(node, sizes)
            begin = np.concatenate(([0], np.cumsum(sizes)))[:-1]
            at = np.arange(len(hashes)) - begin[row]
            take = (at < prefix_length(sizes)[row]) & new[row]
            own = row[take]
            # parts from 1 of columns that are split, 0 of all others
            parts = np.maximum(1, -(-rank[take] // PART))
            part = np.where(parts > 1, 1 + node[own] % parts, 0)
            arrays = (hashes[take].view(np.int64), part.astype(np.int32), node[own], sizes[own].astype(np.int32), pull[own], at[take].astype(np.int32))
            yield pa.record_batch([pa.array(x) for x in arrays], ["h", "part", "node", "n", "pull", "at"])

    return docs.select("text").mapInArrow(per_batch, "h long, part int, node long, n int, pull int, at int")


def whole_sets(docs: DataFrame, keys: DataFrame, lone: DataFrame) -> DataFrame:
    """(node, shingles) of the texts under `keys`, and of the nodes of `lone` among those without a key."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unmet = Unmet()
        for _, hashes, row, sizes, node in _sets(batches, 0):
            new = np.flatnonzero(unmet.among(node, sizes))
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.view(np.int64)))
            yield pa.record_batch([pa.array(node[new]), lists.take(pa.array(new, pa.int64()))], ["node", "shingles"])

    def sets(some: DataFrame) -> DataFrame:
        return some.select("text").mapInArrow(per_batch, "node long, shingles array<long>")

    found = sets(keep_keys(docs, keys, "key"))
    # no join finds null keys: of all texts under them, the sets asked for stay
    if not lone.isEmpty():
        found = found.union(keep_keys(sets(docs.where("key is null")), lone, "node"))
    return found.dropDuplicates(["node"])


def linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, counted over the whole sets, written. `b` may be in very many pairs:
    these are dealt to parts, and its set to each of them."""
    asked = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes.select("node", "key"), "node"))
    keys, lone = materialize(asked.where("key is not null").select("key").distinct()), materialize(asked.where("key is null").select("node"))
    sets = whole_sets(docs, keys, lone)
    hot = materialize(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).select("b", F.ceil(F.col("n") / PAIRS).cast("int").alias("parts")))
    # of pairs in one part there are PAIRS times those in several at most, so `many` is small beside them
    many = hot.where("parts > 1")
    dealt = pairs.join(few_bytes(many, 24), "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    right = sets.withColumnsRenamed({"node": "b", "shingles": "sb"}).join(hot, "b")
    right = right.select("b", "sb", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    left = dealt.join(sets.withColumnsRenamed({"node": "a", "shingles": "sa"}), "a")
    both = left.join(right, ["b", "part"])
    shared = F.size(F.array_intersect("sa", "sb"))
    out = materialize(both.where(shared * 100 >= (F.size("sa") + F.size("sb") - shared) * PERCENT).select("a", "b"))
    forget(asked, keys, lone, hot)
    return out


def similar_sizes(na: str, nb: str) -> Column:
    return F.least(na, nb) * 100 >= F.greatest(na, nb) * PERCENT


def remaining() -> Column:
    """How many shingles the set has from a shared column on, of which fewer are left. Sets that link share a column
    where these are as many as they need, as the first one they share is such a column."""
    return F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))


def like_parities() -> Column:
    """Sets that link differ in (100 - PERCENT) / (100 + PERCENT) of both sizes' sum at most."""
    apart = sum((F.bit_count(F.col(f"{b}_a").bitwiseXOR(F.col(f"{b}_b"))) for b in PARITIES), F.lit(0))
    return apart * (100 + PERCENT) <= (F.col("n_a") + F.col("n_b")) * (100 - PERCENT)


def tiles(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the pairs within the columns of `members` (h, node, n, ...): with equal (h, size, ta, tb)
    each pair of like sizes meets once. Sides of one class of sizes (`up` is false) meet both ways round.

    A column of TILE sets or fewer is one tile. Larger ones go by class of sizes, each set as left with
    its own class and the next, and by tiles of hashed parts, of about TILE sets a side.
    """
    sizes = materialize(members.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > TILE).select("h"))
    one = [F.lit(0).alias(c) for c in ("size", "ta", "tb")]
    few = keep_keys(members, sizes, "h", "left_anti").select("*", *one, F.lit(False).alias("up"))
    large = keep_keys(members, sizes, "h").withColumn("size", F.floor(F.log("n") / CLASS).cast("int") + 1)
    left = large.select(*members.columns, F.explode(F.array(F.struct("size", F.lit(False).alias("up")), F.struct((F.col("size") + 1).alias("size"), F.lit(True).alias("up")))).alias("x")).select(*members.columns, "x.size", "x.up")
    cut = materialize(left.groupBy("h", "size").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("g")))
    own, every = F.pmod(F.xxhash64("node"), F.col("g")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    cut = few_bytes(cut, 32)
    left = left.join(cut, ["h", "size"]).select(*members.columns, "size", own.alias("ta"), every.alias("tb"), "up")
    right = large.join(cut, ["h", "size"]).select(*members.columns, "size", every.alias("ta"), own.alias("tb"), F.lit(False).alias("up"))
    return few.unionByName(left), few.unionByName(right)


def met(members: DataFrame) -> DataFrame:
    """The pairs of sets of different components that may link, a row for each column of `members` (h, node, n, at, comp,
    b0 ...) where they meet: all those that both have among the first n - needed + 1."""
    left, right = (d.withColumnsRenamed({c: f"{c}_{s}" for c in ("node", "n", "at", "comp", "up", *PARITIES)}) for d, s in zip(tiles(members), "ab", strict=True))
    both = left.join(right, ["h", "size", "ta", "tb"]).where((F.col("comp_a") != F.col("comp_b")) & (F.col("up_a") | (F.col("node_a") < F.col("node_b"))) & similar_sizes("n_a", "n_b"))
    return both.where((remaining() >= needed(F.col("n_a"), F.col("n_b"))) & like_parities())


def join(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id) of every row of `docs`: the component is the smallest key
    that links reach.

    Null and empty texts have no shingles and are linked with nothing, so they are their own
    component; very long texts are taken whole; repeated rows are equal sets and linked, and of equal
    keys each row has its own set; two sets of exactly PERCENT link; null keys are never a component's
    id, unless it has no other; other columns are left out; an empty table gives an empty table. `docs`
    is read several times and has to give the same rows each time (a table does).
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = materialize(describe(docs))
    classes = materialize(rows.where("n > 0").groupBy("node").agg(F.min("key").alias("key"), F.min("check").alias("low"), F.max("check").alias("high"), *(F.first(b).alias(b) for b in PARITIES)))
    if not classes.where("low <> high").isEmpty():
        raise RuntimeError("two sets of shingles have one 64-bit hash")

    by = W.partitionBy("h", "part")
    own = F.struct("pull", "node", "n")
    laid = columns(docs, frequencies(docs)).withColumn("pivot", F.max(own).over(by)).withColumn("other", F.min("node").over(by)).withColumn("last", F.max("node").over(by))
    laid = materialize(laid.where("part > 0 or other <> last").select("h", "part", "node", "n", "at", F.col("pivot.node").alias("pivot"), F.col("pivot.n").alias("pivot_n"), F.col("pivot.pull").alias("pull")))
    # the pivots of a frequent column's parts are linked to one of them
    pivots = laid.where("part > 0").select("h", F.col("pivot").alias("node"), F.col("pivot_n").alias("n"), "pull").distinct()
    heads = pivots.groupBy("h").agg(F.max(own).alias("first"))
    stars = laid.select("node", "n", "pivot", "pivot_n", "pull").union(pivots.join(heads, "h").select("node", "n", "first.node", "first.n", "first.pull"))
    stars = stars.where((F.col("node") != F.col("pivot")) & similar_sizes("n", "pivot_n")).groupBy(F.col("node").alias("a"), F.col("pivot").alias("b")).agg(F.count(F.lit(1)).alias("shared"), F.first("pull").alias("pull"))
    # each document's best pivots by what is shared and by pull: the others are for the second turn, if it needs them
    best = stars.groupBy("a").agg(F.max(F.struct("shared", "b")).alias("x"), F.max(F.struct("pull", "b")).alias("y"))
    pairs = materialize(best.select("a", F.explode(F.array_distinct(F.array("x.b", "y.b"))).alias("b")))
    edges = linked(pairs, docs, classes)
    comps = connected(edges)
    # what shares a column and isn't connected yet
    tagged = laid.select("h", "node", "n", "at").distinct().join(comps, "node", "left").select("h", "node", "n", "at", F.coalesce("comp", "node").alias("comp"))
    spread = tagged.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("h")
    members = materialize(tagged.join(spread, "h").join(classes.select("node", *PARITIES), "node"))
    forget(laid)
    more = met(members)
    # behind the last column that a pair shares there, it shares no more than the shorter rest of its sets
    more = more.groupBy(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).agg(
        (F.count(F.lit(1)) + F.min(remaining()) - 1).alias("most"), F.first(needed(F.col("n_a"), F.col("n_b"))).alias("needed"))
    seen = pairs.union(pairs.select("b", "a"))
    more = materialize(more.where("most >= needed").select("a", "b").join(seen, ["a", "b"], "left_anti"))
    forget(members, pairs)
    if not more.isEmpty():
        new = linked(more, docs, classes)
        if not new.isEmpty():
            forget(comps)
            comps = connected(edges.union(new))
        forget(new)
    forget(edges, more)
    least = classes.join(comps, "node", "left").select("node", "key", F.coalesce("comp", "node").alias("comp"))
    ids = least.groupBy("comp").agg(F.min("key").alias("component_id"))
    named = materialize(least.join(ids, "comp").select("node", "component_id"))
    forget(classes, comps)
    out = rows.select("key", "node", "n").join(named, "node", "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"))
