"""Toxic passages: maximum-scoring segments of token log-odds, judged by extreme-value statistics.

Scores are log-odds of words and word beginnings between toxic and clean labelled documents, with
an informative Dirichlet prior, of either sign; a word whose log-odds can't be told from chance
scores what such words say together, a little below zero. A linear scan finds all maximal-scoring
segments of a text (Ruzzo and Tompa); Karlin-Altschul statistics turn a segment's score into the
number of segments as good that chance would give in a clean text of that length; a logistic curve
turns that evidence into a probability.

The model is fitted on at most `LABELLED_ROWS` labelled documents, which bounds its features: each
has to be in LEAST_DOCS of them. Near copies among them count once, as they would make any of their
words look telling.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shared, forget, materialize, row_chunks, small_batches, text_bytes, unused
from .shingles import PLACE, mix, shingle_sets

LABELLED_ROWS = 1 << 15
#: Shares of the background counts that the Dirichlet prior weighs.
PRIOR = 0.1
#: Log-odds count if they are as far from zero, by a z-score as far from zero, and in as many documents.
LEAST_ODDS, LEAST_Z, LEAST_DOCS = 1.0, 3.0, 4
#: Least hashes by which near copies among the labelled texts are told.
HASHES = 8
#: A word's beginnings are features besides the word: of as many letters, and each a half longer than the one before.
LEAST_BEGINNING = 4
#: Segments that chance gives so often or less in a clean text of the same length are significant.
SIGNIFICANT = 0.05
WORD = re.compile(r"[^\W\d_]+")
#: Distinct features after which a task passes on its counts.
FLUSH = 1 << 16
#: Words whose weights each task remembers.
CACHE_WORDS = 1 << 17


def lowered(text: str) -> str:
    """Lower case of the same length: characters that would become several stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def beginnings(word: str) -> Iterator[str]:
    """Features of a word: itself and its beginnings (marked with '^'), longer by one letter and then by halves."""
    yield word
    k = LEAST_BEGINNING
    while k <= len(word):
        yield "^" + word[:k]
        k += max(1, k // 8)


def maximal_segments(scores: Iterable[tuple[int, float]], gap: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) in linear time.

    `scores` has the positions with scores of their own, in order; each position between two of them
    scores -gap. A segment's score is the sum of its positions' scores.
    """
    found: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum with
    total, at = 0.0, -1
    for i, s in scores:
        total -= gap * (i - at - 1)
        at = i
        first, left = i, total
        total += s
        right = total
        if s <= 0:
            continue
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j -= 1
            if j < 0 or found[j][3] >= right:
                found.append((first, i, left, right))
                break
            first, left = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, r - lo) for a, b, lo, r in found]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    gap: float = 0.01
    rate: float = 1.0  # lambda of the extreme-value distribution
    size: float = 1.0  # its K
    slope: float = 1.0
    offset: float = 0.0
    none: float = 0.01  # probability of a text without a positive word

    def __post_init__(self) -> None:
        self.seen: dict[str, float] = {}

    def weight(self, word: str) -> float:
        """The log-odds of the word's feature that is furthest from zero, or 0."""
        w = self.seen.get(word)
        if w is None:
            w = max((self.weights.get(x, 0.0) for x in beginnings(word)), key=abs)
            if len(self.seen) >= CACHE_WORDS:
                self.seen.clear()
            self.seen[word] = w
        return w

    def scored(self, text: str | None) -> tuple[int, list[tuple[int, float]]]:
        """The number of words, and the positions and log-odds of those that have some."""
        words = WORD.findall(lowered(text)) if text else []
        weight = self.weight
        known = {word: w for word in set(words) if (w := weight(word))}
        if not known or max(known.values()) <= 0:
            return len(words), []  # without a positive word there is no segment
        return len(words), [(i, known[word]) for i, word in enumerate(words) if word in known]

    def expected(self, length: int, score: float) -> float:
        """How many segments of this score or more chance gives in a clean text."""
        return self.size * max(length, 1) * math.exp(-self.rate * score)

    def probability(self, length: int, segments: list[tuple[int, int, float]]) -> float:
        if not segments:
            return self.none
        x = self.offset + self.slope * evidence(self, length, segments)
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def flat(x: float) -> float:
    """Grows as the logarithm where evidence is large, so that no value has to be cut."""
    return math.asinh(x)


def evidence(model: Model, length: int, segments: list[tuple[int, int, float]]) -> float:
    """Minus the log of the expected number, for all segments that chance doesn't explain, or the best, flattened."""
    each = [-math.log(model.size * max(length, 1)) + model.rate * s for _, _, s in segments]
    least = -math.log(SIGNIFICANT)
    return flat(sum(x for x in each if x > least) or max(each))


def feature_counts(docs: DataFrame) -> DataFrame:
    """(feature, toxic, clean): in how many documents of (text, toxic) each feature occurs."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def flushed() -> pa.RecordBatch:
            names = [*(counts[0].keys() | counts[1].keys())]
            out = pa.record_batch([pa.array(names, pa.string()), *(pa.array([counts[k][x] for x in names], pa.int64()) for k in (1, 0))], ["feature", "toxic", "clean"])
            for count in counts:
                count.clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = set(WORD.findall(lowered(text.as_py()))) if text.is_valid else ()
                counts[toxic].update({x for w in words for x in beginnings(w)})
                if len(counts[0]) + len(counts[1]) > FLUSH:
                    yield flushed()
        yield flushed()

    rows = docs.select("text", "toxic").mapInArrow(per_batch, "feature string, toxic long, clean long")
    return rows.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def log_odds(counts: DataFrame) -> DataFrame:
    """(feature, weight): the log-odds that can be told from chance, of either sign."""
    totals = counts.agg(F.sum("toxic").alias("n1"), F.sum("clean").alias("n0")).first()
    n1, n0 = totals.n1 or 0, totals.n0 or 0
    a0 = PRIOR * (n1 + n0)
    y1, y0 = F.col("toxic"), F.col("clean")
    a = (y1 + y0) * PRIOR
    odds = F.log((y1 + a) / (n1 + a0 - y1 - a)) - F.log((y0 + a) / (n0 + a0 - y0 - a))
    z = odds / F.sqrt(1 / (y1 + a) + 1 / (y0 + a))
    return counts.where(y1 + y0 >= LEAST_DOCS).select("feature", odds.alias("weight"), z.alias("z")).where((F.abs("z") >= LEAST_Z) & (F.abs("weight") >= LEAST_ODDS)).select("feature", "weight")


def labelled(docs: DataFrame, labels: DataFrame, train: Column, key: str = "doc_id") -> DataFrame:
    """(text, toxic 0/1) of at most LABELLED_ROWS training documents, chosen by a hash of their keys.

    Rows without a label or with other labels than 0 and 1 teach nothing; a document with both
    counts as toxic. The chosen keys are few by that bound, so they are broadcast.
    """
    chosen = labels.where(F.col("toxic").isin(0, 1) & train).groupBy(key).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64(key), key).limit(LABELLED_ROWS)
    return docs.select(key, "text").join(F.broadcast(chosen), key).select("text", "toxic")


def unlike(sample: DataFrame) -> DataFrame:
    """Of (text, toxic) rows one of each group of near copies with one label.

    A text has HASHES least hashes of its shingles, and near copies share most of them; each text goes
    with the one that most texts have, and of these the text of the least hash stays.
    """

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for i, j in row_chunks(offsets, 1 << 18):
                hashes, row = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], 5)
                begin = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else row
                found = np.stack([np.minimum.reduceat(mix(hashes ^ s), begin) for s in PLACE[:HASHES]], 1) if len(row) else np.zeros((0, HASHES), np.uint64)
                at = pa.array(np.repeat(row[begin] + i, HASHES))
                yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(found.ravel().view(np.int64))], ["row", "toxic", "hash"])

    texts = materialize(sample.dropDuplicates(["text", "toxic"]).select(F.xxhash64("text").alias("row"), "toxic", "text"))
    each = materialize(texts.mapInArrow(least, "row long, toxic int, hash long"))
    often = each.groupBy("hash", "toxic").agg(F.count(F.lit(1)).alias("n"))
    best = each.join(often, ["hash", "toxic"]).groupBy("row", "toxic").agg(F.max(F.struct("n", "hash")).alias("b"))
    kept = best.groupBy("b.hash", "toxic").agg(F.min("row").alias("row")).select("row", "toxic")
    wordless = each.select("row").distinct()
    out = materialize(texts.join(kept, ["row", "toxic"], "left_semi").union(texts.join(wordless, "row", "left_anti")).select("toxic", "text"))
    forget(texts, each)
    return out


def fit(sample: DataFrame) -> Model:
    """The model of (text, toxic) rows; `sample` has a bounded number of rows.

    Texts are scored in tasks. The driver gets the counts of rounded weights, and then two numbers for
    each row of the sample.
    """
    small_batches(sample.sparkSession)
    sample = unlike(sample.select(F.col("toxic").cast("int").alias("toxic"), "text"))
    model = Model({r.feature: r.weight for r in log_odds(feature_counts(sample)).collect()})
    hits, tokens, by_weight = _chances(sample, model)
    q1, q0 = ((hits[k] + 1) / (tokens[k] + 2) for k in (1, 0))
    model.gap = max(1e-3, math.log1p(-min(q0, 0.5)) - math.log1p(-min(q1, 0.9)))
    model.rate = _rate(by_weight if max(by_weight, default=0) > 0 else {1.0: 1}, tokens[0] + 2, model.gap)
    best = _by_text(sample, model, lambda m, n, seg: max((s for _, _, s in seg), default=None))
    found = [x for _, _, x in best if x is not None]
    level = float(np.median(found)) if found else 1.0
    over = sum(not toxic and x is not None and x >= level for toxic, _, x in best)
    model.size = min(1.0, (over + 1) / (tokens[0] + 1) * math.exp(min(700.0, model.rate * level)))
    rows = _by_text(sample, model, lambda m, n, seg: evidence(m, n, seg) if seg else None)
    rest = [toxic for toxic, _, x in rows if x is None]
    model.none = min(0.5, (sum(rest) + 0.5) / (len(rest) + 10))
    model.slope, model.offset = _logistic(np.array([x for *_, x in rows if x is not None]), np.array([toxic for toxic, _, x in rows if x is not None], float))
    forget(sample)
    return model


def _chances(sample: DataFrame, model: Model) -> tuple[list[int], list[int], dict[float, int]]:
    """By label how many words have positive log-odds and how many there are; of clean texts how often each rounded score."""
    shared = Shared(sample.sparkSession, model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts = shared.value, Counter()
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = Counter(WORD.findall(lowered(text))) if text else {}
                for word, n in words.items():
                    counts[toxic, round(own.weight(word), 1)] += n
        yield pa.record_batch([pa.array([k[0] for k in counts], pa.int32()), pa.array([k[1] for k in counts], pa.float64()), pa.array(counts.values(), pa.int64())], ["toxic", "w", "n"])

    rows = sample.mapInArrow(scan, "toxic int, w double, n long").groupBy("toxic", "w").agg(F.sum("n").alias("n")).collect()
    hits, tokens = ([sum(r.n for r in rows if r.toxic == k and r.w > low) for k in (0, 1)] for low in (0, -math.inf))
    return hits, tokens, {r.w: r.n for r in rows if not r.toxic and r.w}


def _by_text(sample: DataFrame, model: Model, measure: Callable[[Model, int, list], float | None]) -> list[tuple[int, int, float | None]]:
    """(toxic, words, what `measure` makes of the segments) of each text of the bounded sample."""
    shared = Shared(sample.sparkSession, model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.scored(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([measure(own, n, maximal_segments(p, own.gap)) for n, p in found], pa.float64())], ["toxic", "n", "x"])

    return [tuple(r) for r in sample.mapInArrow(scan, "toxic int, n long, x double").collect()]


def _rate(counts: dict[float, int], tokens: int, gap: float) -> float:
    """The positive root of E[exp(rate * score)] = 1 over the tokens of clean texts, by bisection.

    Scores are positive with some counts; where the mean isn't negative there is no root over the
    least rate looked at, which is then given.
    """
    hit = sum(counts.values())

    def over(rate: float) -> bool:
        return sum(c / tokens * math.exp(min(600.0, rate * w)) for w, c in counts.items()) + (1 - hit / tokens) * math.exp(-rate * gap) > 1

    low, high = 1e-3, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if over(mid) else (mid, high)
    return low


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset of a ridge logistic regression, by Newton's method."""
    b = np.array([0.1, 0.0])
    if not len(x):
        return 0.1, 0.0
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        gradient = design.T @ (y - p) - 0.01 * b
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        b = b + np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    return max(float(b[0]), 0.0), float(b[1])


PASSAGE = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())])


def judged(model: Model, text: str | None, threshold: float) -> tuple[float, int, list[dict]]:
    """Score, prediction and significant passages of one text."""
    n, own = model.scored(text)
    segments = maximal_segments(own, model.gap)
    p = model.probability(n, segments)
    some = [(a, b, s, e) for a, b, s in segments if (e := model.expected(n, s)) <= SIGNIFICANT]
    spans = [m.span() for m in WORD.finditer(lowered(text))] if some else []
    return p, int(p >= threshold), [{"first": spans[a][0], "end": spans[b][1], "score": s, "expected": e} for a, b, s, e in some]


def score(docs: DataFrame, model: Model, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """`docs` with score, predicted and passages (array of first and end character, score, expected).

    Null and empty texts have no words and get the score of texts without a positive word; very long
    texts are scored whole; a text with the threshold's very score is predicted toxic; repeated rows
    get equal scores; columns of these names are replaced, all others stay; an empty table gives an
    empty table.
    """
    small_batches(docs.sparkSession)
    shared = Shared(docs.sparkSession, model)
    names = ["score", "predicted", "passages"]
    docs = docs.drop(*names)
    verdict, = unused(docs.columns, "verdict")

    def judge(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for column in columns:
            rows = [judged(own, text.as_py(), threshold) for text in column]
            score, predicted, passages = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(score, pa.float64()), pa.array(predicted, pa.int32()), pa.array(passages, pa.list_(PASSAGE))], names)

    kind = "score double, predicted int, passages array<struct<first:long,end:long,score:double,expected:double>>"
    found = docs.withColumn(verdict, F.arrow_udf(judge, kind, F.ArrowUDFType.SCALAR_ITER)(F.col(text)))
    return found.select(*(F.col(f"`{c}`") for c in docs.columns), *(F.col(verdict)[n].alias(n) for n in names))
