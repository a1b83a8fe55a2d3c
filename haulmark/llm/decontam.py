"""Benchmark decontamination: a BM25 inverted index of test items, searched with block-max WAND.

Every training passage (windows of `PASSAGE` words, half overlapping) is a query. An item is
retrieved when the passage's BM25 score reaches a share of the item's own score; items longer than
half a passage are indexed in parts. A document is contaminated when a retrieved item is verified
beside the passage: three quarters of the five-word shingles of its question are there, and half of
those of its answer, if it has one.

The index covers at most `SLICE` items and about `SLICE_BYTES` of text at once; more items are
searched slice by slice, so the broadcast has a bound and nothing is dropped. Document frequencies
and the mean length are those of all items, so that slices change no result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shared, materialize, numbered, row_chunks, small_batches, text_bytes

WORD = re.compile(r"[^\W_]+")
PASSAGE = 128
STEP = PASSAGE // 2
SHINGLE = 5
SLICE, SLICE_BYTES = 20_000, 1 << 24
#: Items in a block of a posting list.
BLOCK = 16
#: BM25's constants, the share of an item's own score that retrieves it, and what must overlap of question and answer.
K1, B, RETRIEVE, OVERLAP, ANSWERED = 1.2, 0.75, 0.5, 0.75, 0.5
#: Share of the threshold that an item's commonest terms may make up without being looked at first.
LATER = 0.6
CHUNK = 1 << 19


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def shingles(words: list[str], k: int = SHINGLE) -> set[tuple[str, ...]]:
    """Distinct runs of k words; fewer words are one run."""
    k = min(k, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The answer is the last line; of a text of one line, the last sentence."""
    lines = [x for x in text.strip().split("\n") if words_of(x)]
    if len(lines) < 2:
        lines = [x for x in re.split(r"(?<=[.?!])\s+", text.strip()) if words_of(x)]
    if len(lines) < 2:
        return words_of(text), []
    return words_of(" ".join(lines[:-1])), words_of(lines[-1])


def parts_of(words: list[str]) -> list[list[str]]:
    """The parts under which an item is indexed: STEP words each, the last one drawn back if it is short."""
    return [words[i : i + STEP] if i == 0 or len(words) - i >= STEP // 2 else words[-STEP:] for i in range(0, len(words), STEP)]


@dataclass
class Item:
    item_id: int
    text: str
    n_words: int

    def overlaps(self, words: list[str]) -> tuple[bool, float, float]:
        """Whether these words hold the item, and the shares of question and answer that they hold."""
        question, answer = question_and_answer(self.text)
        asked, answered = _share(shingles(question), words), _share(shingles(answer), words)
        return asked >= OVERLAP and (not answer or answered >= ANSWERED), asked, answered


def _share(part: set[tuple[str, ...]], words: list[str]) -> float:
    if not part:
        return 0.0
    k = len(next(iter(part)))
    held = shingles(words, k) if len(words) >= k else set()
    return len(part & held) / len(part)


@dataclass
class Statistics:
    """Of all items together: parts, their mean words, and in how many parts each term is (of the terms that matter here)."""

    n: int
    mean: float
    df: dict[str, int]


class Terms(dict):
    """Numbers of terms; -1 for all others."""

    def __missing__(self, word: str) -> int:
        return -1


class Index:
    """Postings by term: entries (parts of items) with their BM25 impact over the entry's threshold.

    With impacts so scaled, a passage retrieves an entry when its impacts add up to 1.
    """

    def __init__(self, items: list[tuple[int, str]], known: Statistics | None = None) -> None:
        self.items, parts, self.owner = [], [], []
        for item_id, text in items:
            every = words_of(text)
            if not every:
                continue
            self.items.append(Item(item_id, text, len(every)))
            for part in parts_of(every):
                parts.append(part)
                self.owner.append(len(self.items) - 1)
        self.terms = Terms()
        rows: list[tuple[int, int, int]] = []
        for e, part in enumerate(parts):
            for word in dict.fromkeys(part):
                rows.append((self.terms.setdefault(word, len(self.terms)), e, part.count(word)))
        self.n = len(parts)
        term, entry, tf = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
        size = np.array([len(p) for p in parts], float)
        if known is None:
            df, total, mean = np.bincount(term, minlength=len(self.terms)), self.n, size.mean() if parts else 1.0
        else:
            df, total, mean = np.array([known.df[t] for t in self.terms], np.int64), known.n, known.mean
        idf = np.log1p((total - df + 0.5) / (df + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[entry] / max(mean, 1))) if rows else np.zeros(0)
        own = np.bincount(entry, impact, minlength=self.n)
        impact = impact / (RETRIEVE * own[entry])
        # first looked at: all but the commonest terms of each entry that stay under LATER
        order = np.lexsort((impact, -df[term], entry))
        term, entry, impact = term[order], entry[order], impact[order]
        run = np.cumsum(impact)
        begin = np.searchsorted(entry, np.arange(self.n))
        first = run - (run[begin] - impact[begin])[entry] > LATER if rows else np.zeros(0, bool)
        self.need = 1 - np.bincount(entry[~first], impact[~first], minlength=self.n)
        order = np.lexsort((entry, term))
        self.start, self.entry, self.impact = self._postings(term[order], entry[order], impact[order])
        keep = order[first[order]]
        self.lists: dict[int, tuple] = {}
        self.first_start, self.first_entry, self.first_impact = self._postings(term[keep], entry[keep], impact[keep])

    def _postings(self, term: np.ndarray, entry: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.searchsorted(term, np.arange(len(self.terms) + 1)), entry, impact

    def likely(self, terms: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Windows in which some entry's first terms reach what its other terms can't make up.

        terms and windows: the term and first window of each position; repeated terms count again,
        so that this is an upper bound.
        """
        lens = self.first_start[terms + 1] - self.first_start[terms]
        hit = np.flatnonzero(lens)
        if not len(hit):
            return hit
        lens = lens[hit]
        at = np.repeat(self.first_start[terms[hit]] - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(lens.sum())
        key = np.repeat(windows[hit], lens) * self.n + self.first_entry[at]
        keys, where = np.unique(key, return_inverse=True)
        sums = np.bincount(where, self.first_impact[at])
        # a window is two steps: this step's sum and the next one's
        after = np.searchsorted(keys, keys + self.n)
        after[after == len(keys)] = 0
        both = sums + np.where(keys[after] == keys + self.n, sums[after], 0)
        need = self.need[keys % self.n] - 1e-9
        own, back = keys[both >= need] // self.n, keys[sums >= need] // self.n - 1
        return np.unique(np.concatenate((own, back[back >= 0])))

    def postings(self, t: int) -> tuple[list[int], list[float], float, list[float]]:
        """Entries, impacts, the largest impact and that of each block."""
        found = self.lists.get(t)
        if found is None:
            a, b = int(self.start[t]), int(self.start[t + 1])
            impact = self.impact[a:b].tolist()
            found = self.lists[t] = (self.entry[a:b].tolist(), impact, max(impact), [max(impact[i : i + BLOCK]) for i in range(0, b - a, BLOCK)])
        return found

    def wand(self, terms: list[int]) -> list[tuple[int, float]]:
        """All entries whose impacts over the distinct terms reach 1: block-max WAND."""
        # a cursor: its entry, its place, and the term's postings
        cursors = [[found[0][0], 0, *found] for found in map(self.postings, terms)]
        out = []
        cursors.sort(key=itemgetter(0))
        while True:
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += c[4]
                if bound >= 1 - 1e-9:
                    pivot = i
                    break
            if pivot < 0:
                return out
            entry = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == entry:
                pivot += 1
            some = cursors[: pivot + 1]
            # the blocks that the pivot entry lies in bound its score, up to the first block's end
            blocks = 0.0
            until = cursors[pivot + 1][0] if pivot + 1 < len(cursors) else self.n
            for c in some:
                at = c[1] if c[0] == entry else bisect_left(c[2], entry, c[1])
                if at < len(c[2]):
                    blocks += c[5][at // BLOCK]
                    until = min(until, c[2][min(len(c[2]), (at // BLOCK + 1) * BLOCK) - 1] + 1)
            if blocks < 1 - 1e-9:
                target = max(entry + 1, until)
            elif some[0][0] == entry:
                score = sum(c[3][c[1]] for c in some)
                if score >= 1 - 1e-9:
                    out.append((entry, score))
                target = entry + 1
            else:
                target = entry
            done = False
            for c in some:
                if c[0] < target:
                    c[1] = bisect_left(c[2], target, c[1])
                    c[0] = c[2][c[1]] if c[1] < len(c[2]) else self.n
                    done |= c[0] == self.n
            cursors.sort(key=itemgetter(0))
            if done:
                while cursors and cursors[-1][0] == self.n:
                    cursors.pop()


KIND = pa.struct([("n_passages", pa.int64()), ("n_retrieved", pa.int64()), ("contaminated", pa.bool_()), ("item_id", pa.int64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("bm25_share", pa.float64())])
RESULT = "n_passages long, n_retrieved long, contaminated boolean, item_id long, question_overlap double, answer_overlap double, bm25_share double"
#: What makes one found item better than another, best last.
BETTER = ("contaminated", "question_overlap", "answer_overlap", "bm25_share")


def _searched(index: Index, texts: list[str | None]) -> list[dict]:
    """The result of each text."""
    number = index.terms.__getitem__
    every, first_window, step_of, terms_of, out = [], [], [], [], []
    base = 0
    for text in texts:
        words = words_of(text)
        every.append(words)
        ids = np.array(list(map(number, words)), np.int64)
        known = np.flatnonzero(ids >= 0)
        step_of.append(base + known // STEP)
        terms_of.append(ids[known])
        first_window.append(base)
        base += len(words) // STEP + 2  # a step between texts stays empty
        passages = max(1, -(-(len(words) - STEP) // STEP)) if words else 0
        out.append({"n_passages": passages, "n_retrieved": 0, "contaminated": False, "item_id": None, "question_overlap": 0.0, "answer_overlap": 0.0, "bm25_share": 0.0})
    if not index.n or not terms_of:
        return out
    firsts = np.array(first_window)
    for window in index.likely(np.concatenate(terms_of), np.concatenate(step_of)).tolist():
        doc = int(np.searchsorted(firsts, window, "right")) - 1
        words, step = every[doc], window - first_window[doc]
        if step >= out[doc]["n_passages"]:
            continue  # the passage before it has all its words
        at = step * STEP
        found = index.wand(sorted({t for w in words[at : at + PASSAGE] if (t := number(w)) >= 0}))
        row = out[doc]
        for entry, score in found:
            item = index.items[index.owner[entry]]
            row["n_retrieved"] += 1
            # the item may begin or end as far outside the passage as it is long
            reach = max(PASSAGE, item.n_words)
            hit, question, answer = item.overlaps(words[max(0, at - reach) : at + PASSAGE + reach])
            new = {"contaminated": hit, "item_id": item.item_id, "question_overlap": question, "answer_overlap": answer, "bm25_share": score * RETRIEVE}
            if row["item_id"] is None or (*(new[k] for k in BETTER), -item.item_id) > (*(row[k] for k in BETTER), -row["item_id"]):
                row |= new
    return out


def sliced(items: DataFrame) -> tuple[DataFrame, int]:
    """Distinct items (k, t) with `slice`, and the number of slices: none has more than SLICE items and
    twice SLICE_BYTES of text, or one item. Slices are hashes; their number grows until all fit."""
    items = items.where(F.col("k").isNotNull()).distinct()
    bytes_, n = items.agg(F.sum(F.octet_length("t")), F.count(F.lit(1))).first()
    parts = max(1, -(-n // SLICE), -(-(bytes_ or 0) // SLICE_BYTES))
    while True:
        out = items.withColumn("slice", F.pmod(F.xxhash64("k", "t"), F.lit(parts)))
        sizes = out.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("t")).alias("b"))
        if sizes.where((F.col("n") > 1) & ((F.col("n") > SLICE) | (F.col("b") > 2 * SLICE_BYTES))).isEmpty():
            return materialize(out), parts
        parts *= 2


def indexes(items: DataFrame) -> Iterator[Index]:
    """The index of each slice of (k, t), with the statistics of all slices."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(s, p) for s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for p in parts_of(words_of(t))]
            yield pa.record_batch([pa.array([s for s, _ in found], pa.int64()), pa.array([p for _, p in found], pa.list_(pa.string()))], ["slice", "words"])

    items, slices = sliced(items)
    parts = materialize(items.select("slice", "t").mapInArrow(split, "slice long, words array<string>"))
    n, words = parts.agg(F.count(F.lit(1)), F.sum(F.size("words"))).first()
    terms = parts.select("slice", F.explode(F.array_distinct("words")).alias("term"))
    df = materialize(terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    for part in range(slices):
        own = items.where(F.col("slice") == part)
        counts = df.join(terms.where(F.col("slice") == part).select("term").distinct(), "term")
        known = Statistics(n, (words or 0) / max(n, 1), {r.term: r.df for r in counts.collect()})
        yield Index(sorted((r.k, r.t or "") for r in own.collect()), known)


def _searcher(spark: SparkSession, index: Index) -> Callable[[Column], Column]:
    shared = Shared(spark, index)

    def leaks(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for column in columns:
            _, offsets = text_bytes(column)
            found = [pa.array(_searched(own, column.slice(i, j - i).to_pylist()), KIND) for i, j in row_chunks(offsets, CHUNK)]
            yield pa.concat_arrays(found) if found else pa.array([], KIND)

    return F.arrow_udf(leaks, RESULT, F.ArrowUDFType.SCALAR_ITER)


def search(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """`docs` with `leak`: a struct of passages, retrieved pairs (of passage and item part), contaminated,
    and the best item with its overlaps and its share of BM25.

    Null and empty texts have no passages; null or wordless items are never found; of items that are
    alike the smaller id wins, and then the first in order; repeated items count once, repeated rows
    are searched each; very long texts are searched passage by passage to their end; a column named
    `leak` is replaced, all others stay as they are; without items nothing is contaminated. Items of
    several slices are searched one slice after another over rows that are numbered once.
    """
    spark, docs = docs.sparkSession, docs.drop("leak")
    small_batches(spark)
    items = items.select(F.col(item_key).cast("long").alias("k"), F.col(item_text).cast("string").alias("t"))
    every = indexes(items)
    index = next(every)
    following = next(every, None)
    if following is None:
        return docs.withColumn("leak", _searcher(spark, index)(F.col(text)))
    rows = numbered(docs.select(F.struct("*").alias("row"), F.col(text).alias("text")), "rid")
    hits = []
    while index is not None:
        found = rows.select("rid", _searcher(spark, index)(F.col("text")).alias("leak"))
        hits.append(materialize(found.where(F.col("leak.n_retrieved") > 0)))
        index, following = following, next(every, None)
    one = hits[0]
    for more in hits[1:]:
        one = one.unionByName(more)
    order = F.struct(*(F.col(f"leak.{k}") for k in BETTER), (-F.col("leak.item_id")).alias("id"))
    best = one.groupBy("rid").agg(F.sum("leak.n_retrieved").alias("n"), F.max_by("leak", order).alias("best"))
    none = _searcher(spark, Index([]))(F.col("text"))
    whole = rows.join(best, "rid", "left").withColumn("leak", F.when(F.col("best").isNull(), none).otherwise(F.col("best").withField("n_retrieved", F.col("n"))))
    return whole.select(*(F.col("row").getField(c).alias(c) for c in docs.columns), "leak")
