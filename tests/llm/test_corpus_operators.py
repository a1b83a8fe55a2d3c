"""Joins, deduplication, sharding, mixing and decontamination against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from conftest import DATA, database, rows_of, sql_rows
from pyspark.sql import functions as F

from haulmark.llm import components, decontam, mixing, ngram_join, oracles, queries, repeats, sharding, suffix_dedup
from haulmark.llm.common import table

SF = str(DATA / "sf0.001")
SCHEMA = "doc_id long, text string, h long, part int, node string, rid long, comp long, shard string, leak string, epoch string"
EXTRA = (1, 2, "n", 3, 4, "s", "l", "e")


def documents(spark, rows: list[tuple]):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


# n-gram Jaccard join
def shingle_set(text: str | None) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def linked_groups(rows: list[tuple]) -> dict:
    sets = [(k, shingle_set(t)) for k, t in rows]
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    held = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        counts = Counter(j for x in s for j in held[x])
        for j, n in counts.items():
            if 100 * n >= 75 * len(s | sets[j][1]):
                parent[root(i)] = root(j)
        for x in s:
            held[x].append(i)
    least = defaultdict(list)
    for i, (k, s) in enumerate(sets):
        if s:
            least[root(i)].append(k)
    name = {r: min((k for k in ks if k is not None), default=None) for r, ks in least.items()}
    return Counter((k, len(s), name[root(i)] if s else k) for i, (k, s) in enumerate(sets))


def near_copies(seed: int, bases: int, copies: int) -> list[tuple]:
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for _ in range(bases):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 150))]
        base += passage if rng.random() < 0.6 else []
        for _ in range(rng.randint(1, copies)):
            own = [rng.choice(vocabulary) if rng.random() < 0.02 else w for w in base]
            rows.append((len(rows), " ".join(own)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_all_pairs(spark, seed):
    rows = [*near_copies(seed, 40, 8), (9000, None), (9001, ""), (9002, " \t"), (9003, "One two"), (9004, "one  TWO"), (None, "one two"), (9005, "lone"), (9005, "lone"), (9006, "long " * 20000)]
    got = ngram_join.join(documents(spark, rows)).collect()
    assert Counter(map(tuple, got)) == linked_groups(rows)


def test_components_of_the_table_equal_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    assert Counter(map(tuple, queries.op4_shingle_components(spark, SF).collect())) == linked_groups(rows)


def test_small_parts_change_no_component(spark, monkeypatch):
    for name, value in (("PART", 3), ("LEAST", 2), ("PAIRS", 2), ("TILE", 2), ("COUNT_ROWS", 3)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = near_copies(5, 12, 14)
    assert Counter(map(tuple, ngram_join.join(documents(spark, rows)).collect())) == linked_groups(rows)


def test_sets_meet_only_where_they_may_link(spark):
    size = 300  # sets of 100 shingles that need 86 in common: one beyond place 14 can't be the first that they share
    rows = [(h, node, 100, at, node, 0, 0, 0, 0) for h, at in ((1, 14), (2, 15), (3, 20)) for node in range(size)]
    members = spark.createDataFrame(rows, "h long, node long, n int, at int, comp long, b0 long, b1 long, b2 long, b3 long")
    assert {r.h: r["count"] for r in ngram_join.met(members).groupBy("h").count().collect()} == {1: size * (size - 1) // 2}


def test_heavily_edited_copies_equal_all_pairs(spark):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(120), rng.randint(0, 6)):
            words[at] = f"x{i}_{at}"
        rows.append((i, " ".join(words[rng.randint(0, 8) :])))
    assert Counter(map(tuple, ngram_join.join(documents(spark, rows)).collect())) == linked_groups(rows)


def test_near_copies_without_a_key_are_linked(spark):
    words = [f"n{i}" for i in range(200)]
    changed = lambda *at: " ".join("x" if i in at else w for i, w in enumerate(words))
    # 1 and 2 are joined only through the row without a key; the second text has a near copy without one
    rows = [(1, changed(10, 30, 50)), (None, changed(50, 100)), (2, changed(100, 130, 170)), (None, None)]
    rows += [(5, " ".join(f"m{i}" for i in range(100))), (None, " ".join(f"m{i}" for i in range(99)))]
    want = linked_groups(rows)
    assert want[1, 196, 1] == want[2, 196, 1] == want[None, 196, 1] == 1
    assert Counter(map(tuple, ngram_join.join(documents(spark, rows)).collect())) == want


def test_empty_tables_join_to_nothing(spark):
    assert ngram_join.join(documents(spark, [])).count() == 0
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chains_and_stars_settle(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    found = dict(map(tuple, components.connected(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


# repeated byte strings
def removed(rows: list[tuple], length: int) -> list[tuple]:
    starts = Counter(b[i : i + length] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - length + 1))
    out = []
    for k, t in rows:
        b = (t or "").encode()
        cut = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if starts[b[i : i + length]] > 1:
                cut[i : i + length] = b"\1" * length
        runs = len(re.findall(rb"\x01+", bytes(cut)))
        kept = bytes(x for x, c in zip(b, cut, strict=True) if not c)
        out.append((k, len(b), sum(cut), runs, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def deduplicated(frame) -> Counter:
    return Counter(map(tuple, frame.select("doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("long"), F.sha2("kept", 256)).collect()))


def test_removed_bytes_equal_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    letters = "abcdefgh é"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared, more = text(450), text(205)
    rows = [(i, text(rng.randint(0, 300)) + (shared if i % 2 else more) + text(rng.randint(0, 300))) for i in range(12)]
    rows += [(20, shared[5:300] + "x" + shared[100:]), (21, "a" * 1000), (22, None), (23, ""), (24, "ab" * 100), (25, text(199)), (None, text(50)), (26, text(3000)), (26, text(10)), (27, rows[0][1]), (27, rows[0][1])]
    assert deduplicated(suffix_dedup.dedup(documents(spark, rows))) == removed(rows, 200)
    monkeypatch.setattr(repeats, "PART", 2)
    in_pieces = repeats.without_repeats(documents(spark, rows), suffix_dedup.ByteCutter(700), "text", "doc_id")
    assert deduplicated(in_pieces.withColumnsRenamed({"key": "doc_id", "size": "n_bytes"})) == removed(rows, 200)
    assert suffix_dedup.dedup(documents(spark, [])).count() == 0


def test_row_numbers_stay_when_splits_change(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    shared = text(300)
    rows = [(i, text(150) + (shared if i % 5 == 0 else "") + text(150)) for i in range(60)]
    path = f"file://{tmp_path}/docs"
    spark.createDataFrame(rows, "doc_id long, text string").repartition(12).write.parquet(path)
    stretches = repeats.stretches

    def later(places, length):
        found = stretches(places, length).localCheckpoint()
        spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # as after a change of executors: one file in a split
        return found

    monkeypatch.setattr(repeats, "stretches", later)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        assert deduplicated(suffix_dedup.dedup(spark.read.parquet(path))) == removed(rows, 200)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_removed_bytes_of_the_table_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    assert Counter(map(tuple, queries.op9_repeated_bytes(spark, SF).collect())) == removed(rows, 200)


# sharding, mixing and secrets by SQL
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_rows_equal_those_of_sql(spark, name):
    want, _ = sql_rows(database(DATA / "sf0.001"), queries.ORACLES[name])
    assert rows_of(queries.QUERIES[name](spark, SF)) == want


def test_shards_fit_and_hot_keys_are_parted(spark):
    rows = [(i, "x" * (i % 50)) for i in range(300)] + [(7, "y" * 40)] * 60 + [(None, None), (5000, ""), (5001, "z" * 900)]
    found = sharding.shard(documents(spark, rows), 400).collect()
    assert len(found) == len(rows)
    sizes = defaultdict(int)
    for r in found:
        sizes[r.shard, r.shard_part] += r.n_bytes
    assert all(n <= 400 for k, n in sizes.items() if not any(r.n_bytes > 400 for r in found if (r.shard, r.shard_part) == k))
    names = {r.shard for r in found}
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    assert sharding.shard(documents(spark, []), 400).count() == 0
    assert {r.shard for r in sharding.shard(documents(spark, rows[:5]), 10**6).collect()} == {""}


def brute_shards(rows: list[tuple], limit: int) -> Counter:
    """Splits a bucket over the limit in two, again and again."""
    at = lambda k: int(hashlib.md5(("" if k is None else str(k)).encode()).hexdigest()[:15], 16)
    out, todo = Counter(), [("", [(at(k), k, len((t or "").encode())) for k, t in rows])]
    while todo:
        name, own = todo.pop()
        total = sum(n for *_, n in own)
        if total <= limit or len(name) == 60:
            out.update((k, n, name, total) for _, k, n in own)
        else:
            for bit in "01":
                todo.append((name + bit, [r for r in own if f"{r[0]:060b}"[len(name)] == bit]))
    return out


@pytest.mark.parametrize("limit", [1, 90, 400, 10**7])
def test_shards_equal_brute_force(spark, limit):
    rows = [(i, "x" * (i % 50)) for i in range(200)] + [(7, "é" * 40)] * 30 + [(None, None), (None, "n" * 50), (5000, ""), (5001, "z" * 900), (5002, "long " * 30000)]
    found = sharding.shard(documents(spark, rows), limit)
    assert found.columns == [c for c in documents(spark, rows).columns if c not in sharding.ADDED] + sharding.ADDED
    got = found.collect()
    assert Counter((r.doc_id, r.n_bytes, r.shard, r.shard_bytes) for r in got) == brute_shards(rows, limit)
    parts = defaultdict(list)
    for r in got:
        parts[r.shard, r.shard_part].append(r.n_bytes)
    alone = Counter()
    for k, t in rows:
        alone[k] += len((t or "").encode())
    assert all(sum(p) <= limit or len([n for n in p if n]) == 1 for p in parts.values())
    assert all(r.shard_part == 0 for r in got if alone[r.doc_id] <= limit)


INNER = "at cell leaf open uid task step before group epochs cut source tokens key parent bucket level bytes most parted".split()


def test_names_inside_may_be_those_of_columns(spark):
    rows = [(i % 40, f"w {i} " * 30, f"s{i % 3}") for i in range(90)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, origin string")
    extra = [F.lit(f"mine {n}").alias(n) for n in INNER] + [F.lit(f"mine {n}").alias(f"_{n}") for n in INNER]
    clash = plain.select("*", *extra)
    for make in (lambda d: sharding.shard(d, 700), lambda d: mixing.mix(d, 0.9, 2.0, 1.5, source="origin")):
        found = make(clash)
        assert found.columns[: len(clash.columns)] == clash.columns
        assert all(r[n] == f"mine {n.lstrip('_')}" for r in found.collect() for n in [*INNER, *(f"_{n}" for n in INNER)])
        added = [c for c in found.columns if c not in clash.columns]
        assert rows_of(found.select("doc_id", *added)) == rows_of(make(plain).select("doc_id", *added))


@pytest.mark.parametrize(("share", "repeats", "budget"), [(0.9, 4.0, 1.0), (0.95, 1.2, 1.0), (0.99, 3.0, 2.5), (0.5, 1.0, 0.4)])
def test_mixture_of_skewed_sources_equals_sql(spark, tmp_path, share, repeats, budget):
    rng = random.Random(12)
    rows = [(i, "w " * rng.randint(0, 30), "hot" if i % 2 else f"src{rng.randint(0, 9) ** 2}") for i in range(500)]
    rows += [(1000, "one", "tiny"), (1001, None, "hot"), (1002, "", "empty"), (1003, "a b", None), (None, "c d e", "hot"), (7, "w " * 9, "hot"), (1004, "long " * 900, "src1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = mixing.mix(docs, share, repeats, budget)
    found = found.select("doc_id", "source", "n_tokens", F.round("weight", 9).alias("weight"), "copies", "epoch", "block")
    want, _ = sql_rows(db, oracles.mixture(share, repeats, budget))
    assert rows_of(found) == want
    taken = Counter()
    for r in found.where("n_tokens > 0").collect():
        taken[r.source] += r.copies * r.n_tokens
    all_ = Counter()
    for _, t, s in rows:
        all_[s] += len((t or "").split())
    assert all(taken[s] <= repeats * n + 1e-6 for s, n in all_.items()) and taken.total() <= budget * all_.total()


def test_a_tiny_source_does_not_shrink_the_mixture(spark):
    rows = [(i, "w " * 50, "hot" if i % 3 == 0 else f"src{i % 19}") for i in range(900)] + [(1000, "one", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs, queries.ENTROPY_SHARE, queries.MAX_REPEATS, queries.BUDGET)
    kept = found.agg(F.sum(F.col("n_tokens") * F.col("copies"))).first()[0] / found.agg(F.sum("n_tokens")).first()[0]
    assert kept > 0.95


def test_very_many_sources_are_mixed(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', int(1 + 3000 / (1 + id)))").alias("text"), F.concat(F.lit("s"), F.col("id")).alias("source"))
    found = mixing.mix(docs, 0.97, 2.0, 1.0)
    w = [r.weight for r in found.select("weight").collect()]
    assert sum(w) == pytest.approx(1, abs=1e-9) and found.count() == 3000
    assert -sum(x * math.log(x) for x in w) >= 0.97 * math.log(3000) - 1e-9 or max(r.copies for r in found.collect()) <= 2


def test_mixture_meets_its_limits(spark):
    docs = documents(spark, [(i, "w " * (1 + i % 9)) for i in range(400)] + [(900, None), (None, "a b")]).withColumn("source", F.when(F.col("doc_id") % 10 > 0, "big").otherwise("small"))
    found = mixing.mix(docs, 0.97, 1.0)
    assert found.count() == 402
    sums = {r.source: r for r in found.groupBy("source").agg(F.sum("n_tokens").alias("all"), F.sum(F.col("n_tokens") * F.col("copies")).alias("taken"), F.max("copies").alias("most"), F.max("weight").alias("w")).collect()}
    assert max(r.most for r in sums.values()) == 1 and sums["small"]["taken"] == sums["small"]["all"]
    assert sum(r.w for r in sums.values()) == pytest.approx(1, abs=1e-6)
    twice = mixing.mix(docs, 0.97, 3.0, budget=1.5).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("taken"), F.sum("n_tokens").alias("all"), F.max("weight").alias("w")).collect()
    for r in twice:
        quota = r.w * 1.5 * sum(x["all"] for x in twice)
        assert quota - 10 <= r.taken <= quota + 1e-3 and r.taken <= 3 * r["all"] + 1e-3
    assert mixing.mix(docs.limit(0)).count() == 0


# decontamination
def test_wand_finds_what_an_exhaustive_search_finds():
    rng = random.Random(9)
    vocabulary = [f"t{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 40)))) for i in range(50)]
    index = decontam.Index(items)
    for _ in range(200):
        query = sorted({index.terms[w] for w in rng.sample(vocabulary, 25)} - {-1})
        score = defaultdict(float)
        for t in query:
            for e, s in zip(*index.postings(t)[:2], strict=True):
                score[e] += s
        want = {e for e, s in score.items() if s >= 1 - 1e-9}
        assert {e for e, _ in index.wand(query)} == want


def test_planted_items_are_found_and_clean_documents_kept(spark):
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(500)]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, f"{some(30)}?\n{some(6)}") for i in range(20)] + [(50, None), (51, "...")]
    docs = [(i, f"{some(300)} {items[i][1]} {some(200)}") for i in range(20)] + [(100 + i, some(400)) for i in range(20)] + [(200, None), (201, ""), (202, items[3][1].upper()), (202, items[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.search(documents(spark, docs), bench).collect()
    assert len(found) == len(docs)
    for r in found:
        planted = r.doc_id < 20 or r.doc_id == 202
        assert r.leak.contaminated == planted and (not planted or r.leak.item_id == (r.doc_id if r.doc_id < 20 else 3))
    assert decontam.search(documents(spark, []), bench).count() == 0
    assert not any(r.leak.contaminated for r in decontam.search(documents(spark, docs), bench.limit(0)).collect())


def brute_leaks(docs: list[tuple], items: list[tuple]) -> Counter:
    """Every passage against every part of every item, by BM25 as its formula says."""
    items = sorted({(k, t or "") for k, t in items if k is not None})
    entries = [(k, t, part) for k, t in items for part in decontam.parts_of(decontam.words_of(t))]
    df = Counter(w for *_, part in entries for w in set(part))
    mean = sum(len(p) for *_, p in entries) / len(entries)

    def bm25(query: set[str], part: list[str]) -> float:
        tf = Counter(part)
        idf = lambda w: math.log1p((len(entries) - df[w] + 0.5) / (df[w] + 0.5))
        return sum(idf(w) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(part) / mean)) for w, n in tf.items() if w in query)

    own = [bm25(set(part), part) for *_, part in entries]
    out = Counter()
    for doc_id, text in docs:
        words = decontam.words_of(text)
        starts = range(0, max(1, len(words) - 64), 64) if words else ()
        best, retrieved = None, 0
        for at in starts:
            query = set(words[at : at + 128])
            for (k, t, part), most in zip(entries, own, strict=True):
                share = bm25(query, part) / most
                if share < 0.5 - 1e-9:
                    continue
                retrieved += 1
                question, answer = map(decontam.shingles, decontam.question_and_answer(t))
                reach = max(128, len(decontam.words_of(t)))
                near = words[max(0, at - reach) : at + 128 + reach]
                held = lambda s: len(s & decontam.shingles(near, len(next(iter(s))))) / len(s) if s and len(near) >= len(next(iter(s))) else 0.0  # noqa: B023, E731
                q, a = held(question), held(answer)
                found = (q >= 0.75 and (not answer or a >= 0.5), q, a, share, -k)
                best = max(best or found, found)
        hit, q, a, share, k = best or (False, 0.0, 0.0, 0.0, None)
        out[doc_id, len(starts), retrieved, hit, None if k is None else -k, round(q, 6), round(a, 6), round(share, 6)] += 1
    return out


def leaks_of(found) -> Counter:
    return Counter((r.doc_id, r.leak.n_passages, r.leak.n_retrieved, r.leak.contaminated, r.leak.item_id, round(r.leak.question_overlap, 6), round(r.leak.answer_overlap, 6), round(r.leak.bm25_share, 6)) for r in found.collect())


def test_leaks_equal_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(90)]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, f"{some(rng.randint(3, 40))}?\n{some(rng.randint(1, 8))}") for i in range(30)] + [(40, some(25)), (41, some(400)), (41, some(10)), (42, None), (None, some(9)), (3, "again " * 90)]
    cut = lambda t, a, b: " ".join(t.split()[a:b])
    docs = [(i, f"{some(rng.randint(0, 300))} {cut(t or '', rng.randint(0, 3), rng.randint(3, 60))} {some(rng.randint(0, 90))}") for i, (_, t) in enumerate(items)]
    # a long item retrieved beside a short one whose question stands far away
    docs += [(100, f"{items[31][1]} {some(500)} {items[0][1].split(chr(10))[0]} {some(500)} {items[0][1].split(chr(10))[1]}"), (101, None), (102, ""), (102, ""), (None, items[5][1]), (103, f"{some(6000)} {items[7][1]} {some(6000)}")]
    bench = spark.createDataFrame([*items, items[2]], "item_id long, text string")
    want = brute_leaks(docs, items)
    assert leaks_of(decontam.search(documents(spark, docs), bench)) == want
    assert sum(n for r, n in want.items() if r[3]) >= 5
    monkeypatch.setattr(decontam, "SLICE", 5)
    found = decontam.search(documents(spark, docs).withColumnsRenamed({"h": "row", "part": "best"}), bench)
    assert leaks_of(found) == want and "row" in found.columns


def test_slices_of_the_index_find_the_same(spark, monkeypatch):
    whole = rows_of(queries.op2_benchmark_leaks(spark, SF))
    monkeypatch.setattr(decontam, "SLICE", 9)
    assert rows_of(queries.op2_benchmark_leaks(spark, SF)) == whole
    assert any(r[3] for r in whole)


def test_a_question_without_its_answer_is_no_leak(spark):
    words = [f"q{i}" for i in range(60)]
    question, answer = " ".join(words[:40]), " ".join(words[40:])
    bench = spark.createDataFrame([(1, f"{question}?\n{answer}"), (2, " ".join(f"z{i}" for i in range(20)))], "item_id long, text string")
    docs = documents(spark, [(1, f"{question}? {answer}"), (2, question), (3, answer), (4, " ".join(f"z{i}" for i in range(20)))])
    assert {r.doc_id: r.leak.contaminated for r in decontam.search(docs, bench).collect()} == {1: True, 2: False, 3: False, 4: True}
