"""Spelling variants: words one edit apart, found by automata over their halves.

Of two words one edit apart, each has a half that stands unedited in the other: the first half at its
start or the second half at its end. Automaton shards (Aho-Corasick) hold both halves of every word;
a word is scanned by the shards that can hold such halves of words a code point shorter, as long, or
longer. A match counts at its offset (start or end) for owners of a compatible length, and then the
distance is verified. Shards are dealt by hashes of halves and each holds about `SHARD` of them.

A half that more than `HOT` words own would be looked at with the square of their number. Such words
go by what is left of them instead: equal rests but for one place, or a rest that is another's with
one code point deleted, share a hashed key, which names near words only, so nothing is looked at in
vain; the distance is verified there too. As letters are few, a word has few near words, hot or not.
"""

from __future__ import annotations

import string
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize, small_batches
from .shingles import BYTE, PLACE, POWERS, U, mix

#: Words have so many code points at least, and occur so often.
LENGTH, LEAST = 7, 2
#: A form occurs so many times as often as its variant at least.
RATIO = 10
#: One run in so many, by its hash, is read without one of its code points.
SLIPS = 31
#: Halves of a shard, and owners of a half beyond which their rests are compared by keys.
SHARD, HOT = 1 << 13, 2048
#: A shard looks at owners of a half one by one if they are few, or their rests are not short.
FEW, SHORT = 4, 64
LETTERS = f"[A-Za-zÀ-ÿ]{{{LENGTH},}}"


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of the words of (key, text)."""
    run = F.translate("run", string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select(F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"), F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("run")).select("key", run.alias("run"))
    hashed = runs.select("run", F.crc32(F.concat_ws(":", "key", "run").cast("binary")).alias("h"))
    at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = hashed.select(F.when(F.col("h") % SLIPS == 0, slipped).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST)


def _head(length: Column) -> Column:
    """Code points of the first half of a word of this length."""
    return F.floor(length / 2).cast("int")


def halves(words: DataFrame) -> DataFrame:
    """(side, half, word, n) of both halves of each word."""
    size = F.char_length("word")
    both = F.array(F.struct(F.lit(0).alias("side"), F.left("word", _head(size)).alias("half")), F.struct(F.lit(1).alias("side"), F.right("word", size - _head(size)).alias("half")))
    return words.select("word", "n", F.explode(both).alias("x")).select("x.side", "x.half", "word", "n")


def places(words: DataFrame) -> DataFrame:
    """(side, half, word): what halves of words of like lengths would be at a word's start and end."""
    words = words.select(F.col("word").alias("word"))  # joined with `halves` of the same words
    size = F.char_length("word")
    lengths = [size - 1, size, size + 1]
    heads = F.transform(F.array_distinct(F.array(*map(_head, lengths))), lambda k: F.struct(F.lit(0).alias("side"), F.left(F.col("word"), k).alias("half")))
    tails = F.transform(F.array_distinct(F.array(*(k - _head(k) for k in lengths))), lambda k: F.struct(F.lit(1).alias("side"), F.right(F.col("word"), k).alias("half")))
    return words.select("word", F.explode(F.concat(heads, tails)).alias("x")).select("x.side", "x.half", "word")


def same_start(a: str, b: str) -> int:
    """How many code points a and b begin with alike."""
    low, high = 0, min(len(a), len(b))
    if high < 32:
        for x, y in zip(a, b, strict=False):
            if x != y:
                return low
            low += 1
        return low
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one code point is inserted, deleted or replaced between a and b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = same_start(a, b)
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def lacks(rest: str) -> set[str]:
    """`rest` without the code point of one place or another."""
    return {rest[:i] + rest[i + 1 :] for i in range(len(rest))}


def holes(rest: str) -> list[str]:
    """`rest` with a hole at each place."""
    return [f"{rest[:i]} {rest[i + 1 :]}" for i in range(len(rest))]


class Owners:
    """Words of one length that own a half, as (rest, word, n); many of them are kept by what is one edit from their rests."""

    def __init__(self, owners: list[tuple[str, str, int]]) -> None:
        self.owners, self.at = owners, None
        if len(owners) > FEW and len(owners[0][0]) <= SHORT:
            self.at = defaultdict(list)
            for x in owners:
                for form in (x[0], *holes(x[0]), *(f"-{r}" for r in lacks(x[0]))):
                    self.at[form].append(x)

    def near(self, rest: str, more: int) -> Iterator[tuple[str, str, int]]:
        """Those one edit from `rest`, which are `more` (-1 to 1) code points longer."""
        if self.at is None:
            return (x for x in self.owners if one_edit(rest, x[0]))
        forms = holes(rest) if not more else [f"-{rest}"] if more > 0 else lacks(rest)
        return (x for form in forms for x in self.at.get(form, ()) if more or x[0] != rest)


class Automaton:
    """The halves of a shard, with who owns them by side and length."""

    def __init__(self, sides: list[int], halves: list[str], words: list[str], counts: list[int]) -> None:
        owners: dict[tuple[str, int, int], list] = defaultdict(list)
        for side, half, word, n in zip(sides, halves, words, counts, strict=True):
            owners[half, side, len(word)].append((word[: len(word) - len(half)] if side else word[len(half) :], word, n))
        self.owners = {k: Owners(v) for k, v in owners.items()}
        self.found = ahocorasick.Automaton()
        for half in {k[0] for k in owners}:
            self.found.add_word(half, half)
        if owners:
            self.found.make_automaton()

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """Owners one edit from `word` with their counts, each once over all shards."""
        size = len(word)
        for end, half in self.found.iter(word):
            for side, rest in ((0, end + 1 == len(half) and word[end + 1 :]), (1, end + 1 == size and word[: size - len(half)])):
                for more in (-1, 0, 1) if rest is not False else ():
                    if held := self.owners.get((half, side, size + more)):
                        for _, other, n in held.near(rest, more):
                            # what also begins with the other's first half is found by that
                            if not (side and word.startswith(other[: len(other) // 2])):
                                yield other, n


def _scan(owned: pa.Table, scanned: pa.Table) -> pa.Table:
    """(word, near, near_n) of one shard."""
    out: list[tuple[str, str, int]] = []
    if len(owned) and len(scanned):
        automaton = Automaton(*(owned.column(c).to_pylist() for c in ("side", "half", "word", "n")))
        for word in scanned.column("scan").to_pylist():
            out += ((word, other, n) for other, n in automaton.near(word))
    words, near, counts = zip(*out, strict=True) if out else ((), (), ())
    return pa.table({"word": pa.array(words, pa.string()), "near": pa.array(near, pa.string()), "near_n": pa.array(counts, pa.int64())})


def rest_keys(rest: bytes) -> tuple[np.ndarray, int, np.ndarray]:
    """Hashes of a rest without the code point of each place, with that place; of the whole; and without any place."""
    n = len(rest)
    up, down = POWERS.upto(n + 2)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_OF[np.frombuffer(rest, np.uint8)] * up[:n], out=total[1:])
    less = total[:n] + (total[n] - total[1:]) * down[1]
    place = np.arange(n, dtype=np.uint64)
    return mix(less + mix(place * PLACE[5] + U(n))), int(total[n]), np.unique(less)


#: A number for each letter; those of shingles are alike for A-Z and a-z.
BYTE_OF = mix(BYTE + np.arange(256, dtype=np.uint64))


def _keyed(rows: DataFrame, owner: bool) -> DataFrame:
    """(key, word, ...) of (side, half, word, ...): keys that two words with this half share if their rests are one edit apart."""
    names = ["key", *rows.columns]

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, row = [], []
            for i, (side, half, word) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                rest = word[len(half) :] if side == 0 else word[: len(word) - len(half)]
                replaced, whole, deleted = rest_keys(rest.encode("latin-1"))
                # an owner's whole rest meets what a scanned word is without one place, and the other way round
                own = np.concatenate((replaced, mix(np.array([whole], np.uint64) ^ PLACE[6 + owner]), mix(deleted ^ PLACE[7 - owner])))
                keys.append(mix(own + U(half_hash(side, half))))
                row += [i] * len(own)
            columns = [pa.array(np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)), *(c.take(pa.array(row, pa.int64())) for c in batch.columns)]
            yield pa.record_batch(columns, names)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(per_batch, f"key long, {kinds}")


def half_hash(side: int, half: str) -> int:
    """64 bits of a half on a side."""
    codes = np.frombuffer(half.encode("latin-1"), np.uint8)
    return int(mix((BYTE_OF[codes] * POWERS.upto(len(codes))[0]).sum(dtype=np.uint64, keepdims=True) + U(2 * len(codes) + side))[0])


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): each word beside every word one edit from it, of written (word, n)."""
    owned, scanned = halves(words), places(words)
    hot = materialize(owned.groupBy("side", "half").agg(F.count(F.lit(1)).alias("owners")).where(F.col("owners") > HOT).select("side", "half"))
    shards = max(1, -(-2 * words.count() // SHARD))
    shard = F.pmod(F.xxhash64("side", "half"), F.lit(shards)).cast("int").alias("shard")
    on = ["side", "half"]
    left = owned.join(hot, on, "left_anti").select(shard, "side", "half", "word", "n")
    right = scanned.join(hot, on, "left_anti").select(shard, F.col("word").alias("scan")).distinct()
    found = left.groupBy("shard").cogroup(right.groupBy("shard")).applyInArrow(_scan, "word string, near string, near_n long")
    if hot.isEmpty():
        return found
    mine = _keyed(owned.join(hot, on, "left_semi").select("side", "half", "word", "n"), True).select("key", "side", "half", F.col("word").alias("near"), F.col("n").alias("near_n"))
    theirs = _keyed(scanned.join(hot, on, "left_semi").select("side", "half", "word"), False)
    pairs = theirs.join(mine, ["key", "side", "half"]).where((F.levenshtein("word", "near", 1) == 1))
    twice = (F.col("side") == 1) & F.startswith("word", F.left("near", _head(F.char_length("near"))))
    return found.union(pairs.where(~twice).select("word", "near", "near_n").distinct())


def roots(links: DataFrame, most: int) -> DataFrame:
    """(word, root): the last form that (word, form) leads to. A form is RATIO times as frequent as its word, and
    no word is more frequent than `most`, so chains are short; each round doubles what is followed."""
    now, steps = materialize(links.select("word", F.col("form").alias("root"))), 1
    while RATIO**steps <= most:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = materialize(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
        forget(now)
        now, steps = after, 2 * steps
    return now


def variants(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of all texts.

    A null or empty text has no words, and a null key counts as an empty one; very long texts and
    runs are taken whole; of forms equally frequent the smallest in code-point order wins; repeated
    rows count again; other columns are left out; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    words = materialize(word_counts(docs.select(F.col(key).alias("key"), F.col(text).alias("text"))))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.less") >= F.col("n") * RATIO, F.struct(F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("f"))
    named = materialize(joined.select("word", "n", "n_near", "f.form", "f.form_n"))
    most = named.agg(F.max("n")).first()[0] or 0
    ends = roots(named.where("form is not null"), most)
    forget(words)
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
