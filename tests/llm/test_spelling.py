"""Spelling variants against brute force over deletions."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from haulmark.llm import queries, spelling
from haulmark.llm.common import table

SF = str(DATA / "sf0.001")


def near(a: str, b: str) -> bool:
    """By the table of edit distances."""
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1] == 1


def expected(rows: list[tuple]) -> dict:
    count: Counter = Counter()
    for k, t in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                count[run] += 1
    count = Counter({w: n for w, n in count.items() if n >= 2})
    lacking = defaultdict(set)
    for w in count:
        for x in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            lacking[x].add(w)
    beside = {w: {v for x in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for v in lacking[x] if near(w, v)} for w in count}
    best = {w: min(b, key=lambda v: (-count[v], v)) for w, b in beside.items() if b}
    form = {w: v for w, v in best.items() if count[v] >= 10 * count[w]}
    out = {}
    for w, n in count.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(beside[w]), count.get(form.get(w)))
    return out


def found(frame) -> dict:
    rows = frame.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def typos(rng: random.Random, letters: str) -> list[tuple]:
    """Words that share starts and ends, edited at all places, rare beside frequent ones, in chains."""
    words = []
    for _ in range(12):
        base = "".join(rng.choice(letters) for _ in range(rng.randint(7, 12)))
        words += [base] * 250
        for _ in range(25):
            i, w = rng.randint(0, len(base)), base
            w = rng.choice([w[:i] + rng.choice(letters) + w[i:], w[: max(0, i - 1)] + w[i:], w[: max(0, i - 1)] + rng.choice(letters) + w[i:]])
            words += [w] * rng.choice([2, 3, 22])
            words += [w[:-1] + rng.choice(letters)] * 2
    rng.shuffle(words)
    return [(i if i % 5 else None, rng.choice([" ", "-", "1", "\u2019"]).join(words[i::40])) for i in range(40)]


@pytest.mark.parametrize("hot", [2, 2048])
def test_variants_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(spelling, "HOT", hot)  # 2: nearly all halves go by their rests
    monkeypatch.setattr(spelling, "SHARD", 64)
    rng = random.Random(11)
    for letters in ("ab", "abcdefgh\u00e9\u00dfZ"):
        rows = typos(rng, letters) + [(1, None), (2, ""), (3, "short words"), (4, "A" * 5000 + " " + "a" * 5001 + " " + "a" * 5000)]
        rows += rows[:2]
        want = expected(rows[:-6] + [(4, "A" * 5000 + " " + "a" * 5001 + " " + "a" * 5000)] + rows[:2])
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("w"), "n": F.lit(1), "form": F.lit("f")})
        got = found(spelling.variants(docs.repartition(6)))
        assert got == want
        assert any(r[0] is not None for r in got.values())


def test_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    assert found(queries.op13_spelling_variants(spark, SF)) == expected(rows)


def test_chains_of_forms_end_at_the_root(spark):
    chain = {"aaaaaaaa": 2, "aaaaaaab": 20, "aaaaaabb": 200, "aaaaabbb": 2000}
    links = spark.createDataFrame([("aaaaaaaa", "aaaaaaab"), ("aaaaaaab", "aaaaaabb"), ("aaaaaabb", "aaaaabbb")], "word string, form string")
    assert dict(map(tuple, spelling.roots(links, max(chain.values())).collect())) == dict.fromkeys(list(chain)[:3], "aaaaabbb")


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(docs).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "a b c")], "doc_id long, text string")).count() == 0


def test_one_edit():
    rng = random.Random(2)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(2))
        b = rng.choice([b, a, a[:3] + a[4:], a[:5] + "b" + a[5:], a[:6] + "a" + a[7:]])
        assert spelling.one_edit(a, b) == near(a, b)
