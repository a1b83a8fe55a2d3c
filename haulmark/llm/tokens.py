"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are made."""

from __future__ import annotations

import heapq
import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Fixed value: the pre-tokenizing pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose counts each Python worker remembers.
CACHE_WORDS = 1 << 18


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if printable, else the next from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class MergeCounter:
    """Counts the tokens of texts under one byte-level BPE vocabulary."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(pairs)}
        self.letters = byte_letters()
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.words = regex.compile(PATTERN)
        self.seen: dict[str, int] = {}

    def merged(self, word: str) -> int:
        """Symbols left of one pre-token: initial symbols minus merges."""
        symbols = [self.letters[b] for b in word.encode("utf-8", "surrogatepass")]
        n = left = len(symbols)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        rank = self.ranks.get
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue  # one of the two was merged meanwhile
            symbols[i], symbols[j] = a + b, ""
            left -= 1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
            if (h := before[i]) >= 0 and (r := rank((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
        return left

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total, parts = 0, [text]
        if self.special:
            parts = self.special.split(text)
            total = len(parts) - 1  # each special string is one token
        for part in parts:
            for word, times in Counter(self.words.findall(part)).items():
                n = self.seen.get(word)
                if n is None:
                    n = self.merged(word)
                    if len(self.seen) >= CACHE_WORDS:
                        self.seen.clear()
                    if len(word) <= 64:
                        self.seen[word] = n
                total += n * times
        return total


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_tokens) of every row of `docs`.

    Null and empty texts have 0 bytes and 0 tokens; very long texts and words are counted whole; of
    pairs of one rank the first is merged first; a null key stays null; repeated rows are counted
    each; other columns are left out; an empty table gives an empty table. `vocabulary`
    is the path of a byte-level BPE file that every executor can read.
    """

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = MergeCounter(vocabulary)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(map(counter.count, texts), pa.int64())], ["key", "n_bytes", "n_tokens"])

    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text))
    return rows.mapInArrow(per_batch, f"key {kind}, n_bytes long, n_tokens long").withColumnRenamed("key", key)
