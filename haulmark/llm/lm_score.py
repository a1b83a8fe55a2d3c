"""Language-model scores from a subword lattice over an existing piece vocabulary.

A word is the sum over all its segmentations into pieces; a forward recursion in log space gives
that marginal. The vocabulary and its scores exist already: the scores start the piece weights,
which one expectation-maximisation pass over the training words then fits. A word starts with a
start piece (marked) and goes on with inner pieces until it stops, so that the lattice is a
distribution over words. Words seen in training have, beside the lattice, one arc for the whole
word: P(w) = (c + V * lattice(w)) / (N + V + 1), the Witten-Bell mixture; the end token has (c + 1) / (N + V + 1).
Without training V counts as 1, so that the probabilities of words and end still sum to 1.

What is gathered from the corpus is a table of all distinct words, kept by Spark. Only words that
make up at least one part in `HEAVY` of the training tokens are sent to the tasks, and so at most
`HEAVY` words whatever the size of the corpus; all others meet their documents in a join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, lower_words, materialize, small_batches

HEAVY = 1 << 17
MARK = "▁"
#: Distinct words after which a task passes on its counts.
FLUSH = 1 << 18
#: Added to each piece's expected count.
SMOOTH = 0.1


class Lattice:
    """Piece weights; `start` and `inner` hold log weights, or None where a text only begins a piece."""

    def __init__(self, start: dict[str, float], inner: dict[str, float], stop: float) -> None:
        self.start_bytes = [start[f"<0x{b:02X}>"] for b in range(256)]
        self.inner_bytes = [inner[f"<0x{b:02X}>"] for b in range(256)]
        self.go, self.end = math.log1p(-stop), math.log(stop) - math.log1p(-stop)
        self.start, self.inner = self._prefixes(start), self._prefixes(inner)

    def _prefixes(self, pieces: dict[str, float]) -> dict[str, float | None]:
        """Each arc costs the weight of going on; `end` puts stopping in the place of the last."""
        out: dict[str, float | None] = {}
        for piece, weight in pieces.items():
            if not piece.startswith("<0x"):
                out[piece] = weight + self.go
                for k in range(1, len(piece)):
                    out.setdefault(piece[:k], None)
        return out

    def arcs(self, word: str) -> Iterator[tuple[int, int, str, float]]:
        """(from, to, piece, log weight), by start; positions are characters after the mark."""
        marked, n = MARK + word, len(word) + 1
        for i in range(n):
            table, one = self.inner if i else self.start, False
            for j in range(i + 1, n + 1):
                piece = marked[i:j]
                if piece not in table:
                    break
                if (weight := table[piece]) is not None:
                    one |= j == i + 1
                    yield i, j, piece, weight
            if i and not one:  # a character without a piece: its bytes
                raw = marked[i].encode("utf-8", "surrogatepass")
                yield i, i + 1, "", sum(self.inner_bytes[b] + self.go for b in raw)

    def log_marginal(self, word: str) -> float:
        n = len(word) + 1
        alpha: list[float | None] = [None] * (n + 1)
        alpha[0] = 0.0
        log1p, exp = math.log1p, math.exp
        for i, j, _, weight in self.arcs(word):
            a = alpha[i]
            if a is None:
                continue
            a += weight
            b = alpha[j]
            if b is None:
                alpha[j] = a
            elif a > b:
                alpha[j] = a + log1p(exp(b - a))
            else:
                alpha[j] = b + log1p(exp(a - b))
        return alpha[n] + self.end

    def expect(self, word: str, into: dict[tuple[bool, str], float]) -> None:
        """Add the expected number of uses of each piece in this word."""
        n = len(word) + 1
        alpha: list[float | None] = [None] * (n + 1)
        alpha[0] = 0.0
        used = []
        log1p, exp = math.log1p, math.exp
        for arc in self.arcs(word):
            i, j, _, weight = arc
            a = alpha[i]
            if a is None:
                continue
            used.append(arc)
            a += weight
            b = alpha[j]
            alpha[j] = a if b is None else a + log1p(exp(b - a)) if a > b else b + log1p(exp(a - b))
        beta: list[float] = [-math.inf] * (n + 1)
        beta[n] = 0.0
        whole = alpha[n]
        for i, j, piece, weight in reversed(used):
            b = beta[j]
            if b == -math.inf:
                continue
            b += weight
            a = beta[i]
            beta[i] = b if a == -math.inf else a + log1p(exp(b - a)) if a > b else b + log1p(exp(a - b))
            share = exp(alpha[i] + b - whole)
            if piece:
                key = (i == 0, piece)
                into[key] = into.get(key, 0.0) + share
            else:
                for x in word[i - 1].encode("utf-8", "surrogatepass"):
                    key = (False, f"<0x{x:02X}>")
                    into[key] = into.get(key, 0.0) + share


def load_pieces(path: str) -> dict[str, float]:
    """Pieces of a sentencepiece model with the scores they come with, but for control pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {model.id_to_piece(i): model.get_score(i) for i in range(model.vocab_size()) if not model.is_control(i) and not model.is_unknown(i)}


def normalised(weights: dict[tuple[bool, str], float], pieces: dict[str, float]) -> Lattice:
    """The lattice of these (expected) counts, smoothed, over all pieces."""
    starts = {p: weights.get((True, p), 0.0) + SMOOTH for p in pieces if p.startswith(MARK) or p.startswith("<0x")}
    starts.setdefault(MARK, SMOOTH)
    inner = {p: weights.get((False, p), 0.0) + SMOOTH for p in pieces if not p.startswith(MARK)}
    inner |= {f"<0x{b:02X}>": inner.get(f"<0x{b:02X}>", SMOOTH) for b in range(256)}
    starts |= {f"<0x{b:02X}>": SMOOTH for b in range(256)}
    log_s, log_i = math.log(sum(starts.values())), math.log(sum(inner.values()))
    words, going = sum(w for (first, _), w in weights.items() if first), sum(w for (first, _), w in weights.items() if not first)
    stop = (words + 1) / (words + going + 2)
    return Lattice({p: math.log(w) - log_s for p, w in starts.items()}, {p: math.log(w) - log_i for p, w in inner.items()}, stop)


def first_lattice(pieces: dict[str, float]) -> Lattice:
    """Weights from the scores that the vocabulary has: scores are minus ranks, weights Zipf's."""
    return normalised({(p.startswith(MARK), p): 1e6 / (10 - s) for p, s in pieces.items() if s > -1e8}, pieces)


def _text(word: bytes) -> str:
    return word.decode("utf-8", "surrogatepass")


def word_counts(docs: DataFrame, train: F.Column, text: str = "text") -> DataFrame:
    """(word, c): all distinct words of `docs`, counted in the rows of `train`."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        other: set[bytes] = set()

        def flushed() -> pa.RecordBatch:
            for word in other:
                seen.setdefault(word, 0)
            out = pa.record_batch([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "c"])
            seen.clear()
            other.clear()
            return out

        for batch in batches:
            for own, learn in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = lower_words(own.as_py())
                seen.update(words) if learn else other.update(words)
                if len(seen) + len(other) > FLUSH:
                    yield flushed()
        yield flushed()

    rows = docs.select(F.col(text), train.alias("learn")).mapInArrow(per_batch, "word binary, c long")
    return rows.groupBy("word").agg(F.sum("c").alias("c"))


def fit(words: DataFrame, pieces: dict[str, float], before: Lattice) -> Lattice:
    """One pass of expectation-maximisation over the distinct training words, each counted once as
    the lattice serves words that were not seen. What meets at the driver is a number for each piece."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into: dict[tuple[bool, str], float] = {}
        for batch in batches:
            for word in batch.column(0).to_pylist():
                before.expect(_text(word), into)
        yield pa.record_batch([pa.array([k[0] for k in into], pa.bool_()), pa.array([k[1] for k in into], pa.string()), pa.array(into.values(), pa.float64())], ["first", "piece", "n"])

    rows = words.where("c > 0").select("word").mapInArrow(per_batch, "first boolean, piece string, n double")
    return normalised({(r.first, r.piece): r.n for r in rows.groupBy("first", "piece").agg(F.sum("n").alias("n")).collect()}, pieces)


def score(docs: DataFrame, held_out: F.Column, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of `docs`.

    `held_out` says which rows the model doesn't learn from. Null and empty texts are the end token
    alone; repeated rows are scored each; an empty table gives an empty table; without any training
    row N and V are 0, every token is unknown and words are scored by the lattice. Very long texts and
    words are scored whole; words that occur equally often tie in `base_score`; other columns are left
    out. `docs` is read several times and has to give the same rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    pieces = load_pieces(vocabulary)
    words = materialize(word_counts(docs, ~F.col("held")))
    n_words, v_words = words.agg(F.sum("c"), F.sum(F.when(F.col("c") > 0, 1))).first()
    ends = docs.where(~F.col("held")).count()
    n, v = (n_words or 0) + ends, (v_words or 0) + (ends > 0)
    lattice = Shared(spark, fit(words, pieces, first_lattice(pieces)))
    share = max(v, 1)  # of the lattice
    denominator, mixed = math.log10(n + (v + 1)), math.log10(n + share + 1)

    def marginals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice.value
        for batch in batches:
            found = pa.array([model.log_marginal(_text(w)) for w in batch.column(0).to_pylist()], pa.float64())
            yield pa.record_batch([batch.column(0), batch.column(1), found], ["word", "c", "lm"])

    floor = F.lit(math.log(share))
    # log10 of (c + v * exp(lm)) / (n + v), also where exp(lm) is 0 in a double
    mixture = F.when(F.col("c") > 0, F.log10(F.col("c") + F.exp(floor + F.col("lm")))).otherwise((floor + F.col("lm")) / math.log(10)) - mixed
    scored = words.mapInArrow(marginals, "word binary, c long, lm double").select(
        "word", "c", (F.log10(F.col("c") + 1.0) - denominator).alias("base"), mixture.alias("score"))
    scored = materialize(scored)
    least = max(2, -(-n // HEAVY))
    heavy = spark.sparkContext.broadcast({bytes(r.word): (r.base, r.score) for r in scored.where(F.col("c") >= least).toLocalIterator()})
    end_base = math.log10(ends + 1) - denominator
    end_score = math.log10((ends + 1) / (n + share + 1))

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = heavy.value
        for batch in batches:
            rids, keys, held = batch.column(2).to_pylist(), batch.column(0), batch.column(3)
            at: list[int] = []
            out_word: list[bytes] = []
            out_n: list[int] = []
            head: list[tuple] = []
            for rid, own in zip(rids, batch.column(1), strict=True):
                words = lower_words(own.as_py())
                base, total, known = end_base, end_score, int(ends > 0)
                for word, times in Counter(words).items():
                    hit = common.get(word)
                    if hit:
                        base += times * hit[0]
                        total += times * hit[1]
                        known += times
                    else:
                        at.append(rid)
                        out_word.append(word)
                        out_n.append(times)
                head.append((len(words) + 1, known, base, total))
            # a row of its own for each text, under a key that no word has
            lone = [b" " + rid.to_bytes(8, "big") for rid in rids]
            own = [pa.array([h[i] for h in head], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
            yield pa.record_batch([pa.array(rids, pa.int64()), pa.array(lone, pa.binary()), pa.nulls(len(rids), pa.int64()), keys, held, *own], names)
            for i in range(0, len(at), 1 << 16):
                some = slice(i, i + (1 << 16))
                size = len(at[some])
                nulls = [pa.nulls(size, t) for t in (keys.type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.record_batch([pa.array(at[some], pa.int64()), pa.array(out_word[some], pa.binary()), pa.array(out_n[some], pa.int64()), *nulls], names)

    names = ["rid", "word", "n", "key", "held", "tokens", "known", "base0", "score0"]
    kind = docs.schema["key"].dataType.simpleString()
    schema = f"rid long, word binary, n long, key {kind}, held boolean, tokens long, known long, base0 double, score0 double"
    rows = docs.select("key", "text", F.monotonically_increasing_id().alias("rid"), "held").mapInArrow(per_batch, schema)
    joined = rows.join(scored.where(F.col("c") < least), "word", "left")
    sums = joined.groupBy("rid").agg(
        F.max("key").alias(key),
        F.max("held").alias("held_out"),
        F.sum("tokens").alias("n_tokens"),
        F.sum(F.coalesce(F.col("known"), F.when(F.col("c") > 0, F.col("n")), F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        F.sum(F.coalesce(F.col("base0"), F.col("n") * F.col("base"))).alias("base_score"),
        F.sum(F.coalesce(F.col("score0"), F.col("n") * F.col("score"))).alias("score"),
    )
    return sums.drop("rid")
