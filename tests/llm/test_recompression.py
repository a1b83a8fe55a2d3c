"""Repeated word windows against brute force, and the symbols that they stand on."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
from conftest import DATA

from haulmark.llm import queries, recompression, repeats
from haulmark.llm.common import table

SF = str(DATA / "sf0.001")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def removed(rows: list[tuple], length: int = 35) -> Counter:
    words = [(k, WORD.findall((t or "").encode())) for k, t in rows]
    seen = Counter(tuple(w[i : i + length]) for _, w in words for i in range(len(w) - length + 1))
    out = []
    for k, w in words:
        stay = [True] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                stay[i : i + length] = [False] * length
        out.append((k, len(w), len(w) - sum(stay), hashlib.sha256(b" ".join(x for x, s in zip(w, stay, strict=True) if s)).hexdigest()))
    return Counter(out)


def found(frame, names=("doc_id", "n_words")) -> Counter:
    return Counter((r[names[0]], r[names[1]], r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in frame.collect())


def texts(rng: random.Random) -> list[tuple]:
    letters = "abcdefghij"[: rng.choice([1, 2, 3, 10])]
    base = [rng.choice(letters) for _ in range(300)]
    rows = []
    for i in range(40):
        at, kind = rng.randint(0, 200), rng.random()
        if kind < 0.3:
            words = [rng.choice(letters)] * rng.randint(0, 120)
        elif kind < 0.6:
            words = base[at : at + rng.randint(20, 90)] + [rng.choice(letters + "xyz") for _ in range(rng.randint(0, 50))]
        elif kind < 0.8:
            words = [rng.choice(letters), rng.choice(letters + "q")] * rng.randint(0, 60)
        else:
            words = [rng.choice(letters + "pqrstuv") for _ in range(rng.randint(0, 150))] + base[at : at + 36]
        rows.append((i if i % 9 else None, rng.choice([" ", "\n", " \t "]).join(words)))
    return [*rows, rows[0], (1, None), (2, ""), (3, " \t\n "), (4, "\u00a0é " * 80), (4, "É " * 36)]


def test_periodic_short_and_shared_texts(spark):
    rng = random.Random(5)
    for _ in range(3):
        rows = texts(rng)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert found(recompression.dedup(docs)) == removed(rows)
        in_pieces = repeats.without_repeats(docs, recompression.WordCutter(16), "text", "doc_id")
        assert found(in_pieces, ("key", "size")) == removed(rows)


def test_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in queries.op11_repeated_words(spark, SF).collect())
    assert got == removed(rows) and sum(n for (_, _, x, _), n in got.items() if x)


def test_window_that_a_third_of_all_rows_share(spark, monkeypatch):
    rng = random.Random(6)
    shared = " ".join(f"w{i}" for i in range(50))
    rows = [(i, " ".join(f"{rng.random()}" for _ in range(40)) + (f" {shared}" if i % 3 == 0 else "")) for i in range(90)]
    monkeypatch.setattr(repeats, "PART", 2)
    assert found(recompression.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(20))) == removed(rows)


def test_clashing_names_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 1, "x")], "n_words long, text string, rid long, kept string")
    got = recompression.dedup(docs, key="n_words")
    assert got.columns == ["n_words", "_n_words", "n_removed", "spans", "kept"] and got.first()[:2] == (1, 2)
    assert recompression.dedup(docs.limit(0), key="rid").count() == 0


def symbols(words: list[int], extra: tuple[list[int], list[int]] = ([], [])) -> set[tuple]:
    """(level, name, start, low, high) of the symbols whose reach is inside `words`, as they are among the extra ones."""
    row = np.array([*extra[0], *words, *extra[1]], np.uint64)
    shift, places = len(extra[0]), np.arange(len(row))
    level = recompression.Level(recompression.mix(row), np.zeros(len(row), np.int64), places, places, places + 1)
    out = set()
    for number in range(recompression.ROUNDS + 1):
        inside = (level.low >= shift) & (level.high <= shift + len(words))
        out |= {(number, *(int(x[i]) for x in (level.name,)), *(int(x[i]) - shift for x in (level.start, level.low, level.high))) for i in np.flatnonzero(inside)}
        level = level.runs().pairs(number)
    return out


def test_equal_substrings_have_the_same_interior_symbols():
    rng = random.Random(7)
    for _ in range(200):
        letters = rng.choice([1, 2, 5, 1000])
        some = lambda n: [rng.randrange(letters) for _ in range(n)]  # noqa: B023, E731
        words = some(35)
        one, other = (symbols(words, (some(rng.randint(0, 30)), some(rng.randint(0, 30)))) for _ in range(2))
        assert one == other and len(one) >= 35
