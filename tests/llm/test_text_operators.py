"""Secrets, token counts, media, toxicity and language-model scores against plain Python."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter

import public_tokenizers
import pytest
from conftest import DATA
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from haulmark.llm import lm_score, media, queries, secrets, tokens, toxicity
from haulmark.llm.common import table

SF = str(DATA / "sf0.001")
SCHEMA = "doc_id long, text string, source string, lang string, hash string, rid long, word string, n long, spans string, kept string"
EXTRA = ("h", 1, "w", 2, "s", "k")
LONG = "Straße 中文 word, " * 4000


def documents(spark, texts: list):
    """Documents with nulls, repeated rows, and columns whose names clash with those inside."""
    return spark.createDataFrame([(*row, "src", "en", *EXTRA) if len(row) == 2 else row for row in texts], SCHEMA)


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "plain words only"), (4, "plain words only"), (None, "no key"), (5, LONG), (6, "\U0001f600 café <|endoftext|> x")]


# secrets
BASE = [
    (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    (re.compile(r"[0-9a-f]+"), 0, 24),
]


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    found = [(m.start(), k, m.end()) for k, (p, g, least) in enumerate(BASE) for m in p.finditer(text or "") if len(m.group(g)) >= least]
    return sorted(found)


def test_base_spans_equal_plain_regular_expressions(spark):
    got = queries.op1_secret_ownership(spark, SF).collect()
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    assert len(got) == len(texts)
    for r in got:
        want = base_spans(texts[r.doc_id])
        said = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in want) for i in range(3))
        assert set(said.split(",")) <= set(r.spans.split(",")) or not said


def test_secrets_count_owners(spark):
    copied, own = "password = hunter2hunter", "Zx81Qw92Er73Ty64Ui55"
    rows = [(i, f"é {copied} end", f"owner{i}", "en", *EXTRA) for i in range(4)] + [(10, f"key {own} x", "me", "en", *EXTRA), (10, f"key {own} x", "me", "en", *EXTRA), (11, None, None, None, *EXTRA)]
    found = {r.doc_id: r.spans for r in secrets.scan(documents(spark, rows), repo="lang", owner="source").collect()}
    assert [(s.start, s.end, s.kind, s.n_owners, s.live) for s in found[0]] == [(2, 2 + len(copied), 0, 4, False)]
    assert [(s.start, s.end, s.kind, s.n_owners, s.live) for s in found[10]] == [(4, 4 + len(own), 3, 1, True)]
    assert found[11] == [] and secrets.scan(documents(spark, []), repo="lang", owner="source").count() == 0


def test_secrets_of_many_repositories_are_copied(spark):
    own = "Zx81Qw92Er73Ty64Ui55"
    repos = [(f"s{i}", None) if i % 2 else (None, f"s{i}") for i in range(5)]
    rows = [(i, f"key {own} {own} x", s, lang, *EXTRA) for i, (s, lang) in enumerate(repos[:4])]

    def found(some: list, **names) -> list:
        docs = documents(spark, some).withColumn("repo", F.struct("source", "lang")).withColumn("mine", F.lit("one"))
        return secrets.scan(docs, owner="mine").collect()

    spans = [s for r in found(rows) for s in r.spans]
    assert len(spans) == 8 and all((s.n_docs, s.n_repos, s.n_owners, s.live) == (4, 4, 1, True) for s in spans)
    assert not any(r.spans for r in found([*rows, (9, own, *repos[4], *EXTRA)]))  # a fifth repository
    docs = spark.createDataFrame([(1, "x" * 30, None, "en"), (2, "y", "en", None)], "doc_id long, text string, source string, lang string")
    assert docs.select(F.struct("source", "lang").alias("r")).distinct().count() == 2


def test_texts_of_very_many_matches_take_no_square_time(spark):
    text = " ".join(f"{i:024x} token={i:08d}" for i in range(6000))
    rows = [(1, text), (2, text[:5000])]
    got = {r.doc_id: r.spans for r in secrets.scan(documents(spark, rows), repo="lang", owner="source").collect()}
    for k, t in rows:
        assert [(s.start, s.kind, s.end) for s in got[k] if s.kind < 3] == base_spans(t)


def test_wide_values_are_counted_alike(spark, monkeypatch):
    rows = [(i, f"token = example{i % 3}value", f"o{i % 7}", "en", *EXTRA) for i in range(40)]
    scanned = lambda: sorted(map(str, secrets.scan(documents(spark, rows), repo="lang", owner="source").collect()))
    whole = scanned()
    monkeypatch.setattr(secrets, "WIDE", 2)
    assert scanned() == whole


# tokens
def test_token_counts_equal_the_library(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = documents(spark, ODD)
    got = Counter(map(tuple, tokens.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()))
    assert got == Counter((k, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for k, t in ODD)
    whole = table(spark, SF, "documents").collect()
    counts = {r.doc_id: (r.n_tokens, r.over_limit) for r in queries.op6_token_counts(spark, SF).collect()}
    for r, e in zip(whole, library.encode_batch([r.text or "" for r in whole], add_special_tokens=False), strict=True):
        assert counts[r.doc_id] == (len(e.ids), len(e.ids) > 512)
    assert tokens.count_tokens(documents(spark, []), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


# media
def test_media_give_the_payload_back(spark):
    docs = documents(spark, [*ODD, (7, "x" * 64), (8, "y" * 65)])
    stored = media.encode_column(docs)
    files = {(r.doc_id, r.n_bytes): bytes(r.media) for r in stored.collect()}
    for r in media.read_column(stored).collect():
        text = next((t or "") for k, t in [*ODD, (7, "x" * 64), (8, "y" * 65)] if k == r.doc_id and len((t or "").encode()) == r.n_bytes)
        body = text.encode()
        payload = body + bytes(-len(body) % 64 or (64 if not body else 0))
        file = files[r.doc_id, r.n_bytes]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest()) and file[:2] == b"\xff\xd8" and file[-2:] == b"\xff\xd9"
    assert media.read_column(media.encode_column(documents(spark, []))).count() == 0


def test_media_of_random_bytes_and_broken_files():
    rng = random.Random(3)
    payloads = [rng.randbytes(64 * n) for n in (1, 2, 9, 700)]
    for payload, thumbs in zip(payloads, media.decode_many(media.encode_payloads(payloads)), strict=True):
        assert b"".join(t.luma.tobytes() for t in thumbs) == payload
    for broken in (b"no", b"\xff\xd8\xff\xd9"[:3], media.encode_payloads([bytes(64)])[0][:-9]):
        with pytest.raises(ValueError, match=r"JPEG|scan|restart|code"):
            media.decode_many([broken])


def foreign_jpeg(width: int, height: int, parts: list[tuple[int, int, list]], quantiser: int, wide: bool, restart: int) -> bytes:
    """A baseline file by its own writer: parts (h, v, blocks in MCU order of DC and AC runs), one Huffman table
    of 8-bit codes for DC sizes and AC symbols alike."""
    symbols = [*range(12), *(r << 4 | s for r in range(3) for s in range(1, 5)), 0xF0]
    symbols = list(dict.fromkeys(symbols))
    code = {s: f"{i:08b}" for i, s in enumerate(symbols)}

    def number(v: int) -> tuple[int, str]:
        size = abs(v).bit_length()
        return size, f"{v if v > 0 else v + (1 << size) - 1:0{size}b}" if size else ""

    table = lambda kind: struct.pack(">HB", 19 + len(symbols), kind) + bytes([0] * 7 + [len(symbols)] + [0] * 8) + bytes(symbols)
    segments = [b"\xff\xd8", b"\xff\xe0" + struct.pack(">H", 7) + b"other", b"\xff\xdb" + (struct.pack(">HB", 131, 16) + struct.pack(">64H", *[quantiser] * 64) if wide else struct.pack(">HB", 67, 0) + bytes([quantiser] * 64))]
    segments.append(b"\xff\xc0" + struct.pack(">HBHHB", 8 + 3 * len(parts), 8, height, width, len(parts)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v, _) in enumerate(parts)))
    segments += [b"\xff\xc4" + table(0), b"\xff\xc4" + table(16)]
    if restart:
        segments.append(b"\xff\xdd" + struct.pack(">HH", 4, restart))
    segments.append(b"\xff\xda" + struct.pack(">HB", 6 + 2 * len(parts), len(parts)) + b"".join(bytes([i + 1, 0]) for i in range(len(parts))) + b"\x00\x3f\x00")
    per = [h * v if len(parts) > 1 else 1 for h, v, _ in parts]
    mcus, scan, bits, last = len(parts[0][2]) // per[0], b"", "", [0] * len(parts)

    def flushed() -> bytes:
        raw = bits + "1" * (-len(bits) % 8)
        return int(raw, 2).to_bytes(len(raw) // 8, "big").replace(b"\xff", b"\xff\x00") if raw else b""

    for m in range(mcus):
        if restart and m and m % restart == 0:
            scan += flushed() + bytes([0xFF, 0xD0 + (m // restart - 1) % 8])
            bits, last = "", [0] * len(parts)
        for k, (_, _, blocks) in enumerate(parts):
            for dc, ac in blocks[m * per[k] : (m + 1) * per[k]]:
                size, raw = number(dc - last[k])
                bits, last[k] = bits + code[size] + raw, dc
                for run, value in ac:
                    for _ in range(run // 16):
                        bits += code[0xF0]
                    size, raw = number(value)
                    bits += code[(run % 16) << 4 | size] + raw
                bits += code[0]
    return b"".join(segments) + scan + flushed() + b"\xff\xd9"


@pytest.mark.parametrize(("h", "v", "wide", "restart"), [(1, 1, False, 0), (2, 1, False, 2), (2, 2, True, 0), (1, 2, False, 1)])
def test_files_of_other_writers_are_read(h, v, wide, restart):
    rng = random.Random(h * 7 + v)
    across, down = 3, 2  # MCUs
    width, height = across * 8 * h - 3, down * 8 * v - 5
    ac = lambda: [(rng.choice([0, 1, 2, 16, 18]), rng.choice([1, -1, 3, -9])) for _ in range(rng.randint(0, 3))]
    plane = [[rng.randint(-60, 60) for _ in range(across * h)] for _ in range(down * v)]
    luma = [(plane[y * v + j][x * h + i], ac()) for y in range(down) for x in range(across) for j in range(v) for i in range(h)]
    chroma = [[(rng.randint(-40, 40), ac()) for _ in range(across * down)] for _ in range(2)]
    file = foreign_jpeg(width, height, [(h, v, luma), (1, 1, chroma[0]), (1, 1, chroma[1])], 16, wide, restart)
    (thumb,), = media.decode_many([file])
    want = [[max(0, min(255, x * 16 // 8 + 128)) for x in row[: -(-width // 8)]] for row in plane[: -(-height // 8)]]
    assert (thumb.width, thumb.height, thumb.luma.tolist()) == (width, height, want)
    grey = [(x, ac()) for row in plane for x in row]
    (thumb,), = media.decode_many([foreign_jpeg(across * h * 8, down * v * 8, [(1, 1, grey)], 8, wide, restart)])
    assert thumb.luma.tolist() == [[x + 128 for x in row] for row in plane]


def test_features_are_those_of_plain_python(spark):
    texts = [(1, "x" * 64), (2, "the quick brown fox " * 40), (3, ""), (4, "é" * 3000)]
    got = {r.doc_id: r.feature for r in media.read_column(media.encode_column(documents(spark, texts))).collect()}
    for k, t in texts:
        payload = t.encode() + bytes(-len(t.encode()) % 64 or (0 if t else 64))
        rows = [payload[i : i + 64] for i in range(0, len(payload), 64)]
        cells = [[rows[j * len(rows) // 8][i * 64 // 9] for i in range(9)] for j in range(8)]
        bits = "".join(str(int(b > a)) for row in cells for a, b in itertools.pairwise(row))
        assert got[k] == f"512x{8 * len(rows)}:{int(bits, 2):016x}"


# toxicity
def brute_best(scores: dict[int, float], n: int, gap: float) -> float:
    x = [scores.get(i, -gap) for i in range(n)]
    return max((sum(x[a:b]) for a, b in itertools.combinations(range(n + 1), 2)), default=0.0)


def test_maximal_segments_match_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 12)
        scores = {i: rng.choice([0.5, 1.0, 2.0, -0.4, -1.5]) for i in range(n) if rng.random() < 0.5}
        found = toxicity.maximal_segments(sorted(scores.items()), 0.7)
        assert bool(found) == any(s > 0 for s in scores.values())
        if found:
            assert max(s for _, _, s in found) == pytest.approx(brute_best(scores, n, 0.7))
            assert sorted((a, b) for a, b, _ in found) == sorted(brute_maximal([scores.get(i, -0.7) for i in range(n)]))
            for a, b, s in found:
                assert s == pytest.approx(sum(scores.get(i, -0.7) for i in range(a, b + 1)))


def brute_maximal(x: list[float]) -> list[tuple[int, int]]:
    """All maximal segments by their definition: the best one (the shortest of equals), and so on to either side of it."""
    n, best = len(x), None
    for a in range(n):
        for b in range(a, n):
            key = (round(sum(x[a : b + 1]), 9), a - b)
            if key[0] > 0 and (best is None or key > best[0]):
                best = (key, a, b)
    if best is None:
        return []
    _, a, b = best
    return brute_maximal(x[:a]) + [(a, b)] + [(c + b + 1, d + b + 1) for c, d in brute_maximal(x[b + 1 :])]


def test_toxic_scores_equal_brute_force(spark):
    """The whole fit and every score again in plain Python."""
    sf = str(DATA / "sf0.01")
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").where("toxic is not null").collect()}
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    learn = [(labels[k], t) for k, t in rows if k in labels and zlib.crc32(str(k).encode()) % 3 != 1]
    learn = [tuple(r) for r in toxicity.unlike(spark.createDataFrame(learn, "toxic int, text string")).collect()]
    features = [Counter(x for y, t in learn if y == k for x in {f for w in set(toxicity.WORD.findall(toxicity.lowered(t or ""))) for f in toxicity.beginnings(w)}) for k in (0, 1)]
    n0, n1 = (f.total() for f in features)
    weights = {}
    for x in features[0] | features[1]:
        y0, y1 = features[0][x], features[1][x]
        a, a0 = 0.1 * (y0 + y1), 0.1 * (n0 + n1)
        odds = math.log((y1 + a) / (n1 + a0 - y1 - a)) - math.log((y0 + a) / (n0 + a0 - y0 - a))
        if y0 + y1 >= 4 and abs(odds) >= 1 and abs(odds / math.sqrt(1 / (y1 + a) + 1 / (y0 + a))) >= 3:
            weights[x] = odds
    assert max(weights.values()) > 0
    docs = table(spark, sf, "documents")
    model = queries.toxicity_model(spark, sf, docs)
    assert model.weights == pytest.approx(weights)

    def segments(text: str) -> tuple[int, list[float]]:
        words = toxicity.WORD.findall(toxicity.lowered(text or ""))
        x = [max((weights.get(f, 0.0) for f in toxicity.beginnings(w)), key=abs) or -model.gap for w in words]
        return len(words), [s for _, _, s in toxicity.maximal_segments(enumerate(x), 0.0)]

    def evidence(n: int, found: list[float]) -> float:
        each = [model.rate * s - math.log(model.size * max(n, 1)) for s in found]
        return math.asinh(sum(e for e in each if e > -math.log(0.05)) or max(each))

    got = {r.doc_id: r for r in queries.op8_toxic_segments(spark, sf).collect()}
    assert len(got) == len(rows)
    for k, t in rows:
        n, found = segments(t)
        want = 1 / (1 + math.exp(-model.offset - model.slope * evidence(n, found))) if found else model.none
        r = got[k]
        assert (r.score, r.predicted, r.held_out) == (pytest.approx(want), int(want >= 0.7), zlib.crc32(str(k).encode()) % 3 == 1)


def test_near_copies_teach_once(spark):
    rng = random.Random(3)
    some = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    base = some(200)
    near = [" ".join(w if rng.random() > 0.01 else "x" for w in base) for _ in range(60)]
    lone = [" ".join(some(100)) for _ in range(40)]
    rows = [(t, 1) for t in near] + [(t, 0) for t in lone] + [(lone[0], 0), (lone[1], 1), (None, 0), ("", 1), (None, 0)]
    kept = Counter((r.text, r.toxic) for r in toxicity.unlike(spark.createDataFrame(rows, "text string, toxic int")).collect())
    assert set(kept.values()) == {1} and {(t, 0) for t in lone} | {(lone[1], 1), (None, 0), ("", 1)} <= set(kept)
    assert sum((t, 1) in kept for t in near) <= 3
    assert toxicity.unlike(spark.createDataFrame([], "text string, toxic int")).count() == 0


def test_held_out_toxic_documents_are_told_apart(spark):
    sf = str(DATA / "sf0.1")
    rows = queries.op8_toxic_segments(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").select("toxic", "predicted", "score").collect()
    right = Counter((r.toxic, r.predicted) for r in rows)
    assert right[1, 1] >= 0.85 * (right[1, 1] + right[1, 0]) and right[0, 1] <= 0.02 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_toxicity_of_odd_rows(spark):
    bad, good = "you vile scum trash", "the calm river flows"
    own = lambda text, i: " ".join(f"{w} {i}{k}" for k, w in enumerate(text.split()))  # noqa: E731  no two are near copies
    sample = spark.createDataFrame([(own(good, i), 0) for i in range(30)] + [(own(f"{good} {bad}", i), 1) for i in range(30)], "text string, toxic int")
    model = toxicity.fit(sample)
    rows = [*ODD, (7, f"{good} {bad} {bad} {good}")]
    docs = documents(spark, rows).withColumn("score", F.lit("clash"))
    found = toxicity.score(docs, model)
    assert found.columns[:10] == docs.columns[:10] and found.count() == len(rows)
    by = {(r.doc_id, r.text): r for r in found.collect()}
    assert by[1, None].score == by[2, ""].score < 0.5
    hit = by[7, rows[-1][1]]
    assert hit.predicted == 1 and bad in hit.text[hit.passages[0].first : hit.passages[0].end]
    assert toxicity.score(documents(spark, []), model).count() == 0
    assert toxicity.fit(sample.limit(0)).probability(0, []) < 0.7  # nothing to learn from
    mild = toxicity.fit(spark.createDataFrame([(own("the calm river", i), 0) for i in range(40)] + [(own("the vile river", i), 1) for i in range(40)], "text string, toxic int"))
    assert mild.weight("calm") < 0 < mild.weight("vile") and mild.weight("river") == 0


# language model
def test_base_scores_equal_plain_counts(spark):
    held = F.col("doc_id") % 3 == 0
    rows = [*ODD, (9, "Plain WORDS again again"), (12, "words of its own")]
    got = lm_score.score(documents(spark, rows), held, public_tokenizers.path("piece_bpe_32k.model")).collect()
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    learn = [words(t) for k, t in rows if k is None or k % 3]
    c = Counter(w for ws in learn for w in ws)
    n, v, ends = c.total() + len(learn), len(c) + 1, len(learn)
    point = lambda count: math.log10((count + 1) / (n + v + 1))
    want = Counter()
    for k, t in rows:
        ws = words(t)
        want[k, bool(k is not None and k % 3 == 0), len(ws) + 1, sum(w in c for w in ws) + 1, n, round(sum(point(c[w]) for w in ws) + point(ends), 6)] += 1
    plain = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert plain == want
    assert all(r.score <= 0 and math.isfinite(r.score) for r in got)
    assert lm_score.score(documents(spark, []), held, public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_scores_equal_brute_force(spark):
    """Every score again from the words, the fitted lattice and the formula of the mixture."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    rows += [(10**6, None), (10**6 + 1, "zqxj zqxj \u4e2d\u6587"), (10**6 + 1, "zqxj zqxj \u4e2d\u6587"), (10**6 + 2, "w" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for held in (F.col("doc_id") % 5 == 2, F.lit(True)):
        learn = [lm_score.lower_words(t) for k, t in rows if k % 5 != 2] if "doc_id" in str(held) else []
        c, ends = Counter(w for ws in learn for w in ws), len(learn)
        n, v = c.total() + ends, len(c) + (ends > 0)
        pieces = lm_score.load_pieces(path)
        before, into = lm_score.first_lattice(pieces), {}
        for word in c:
            before.expect(word.decode(), into)
        lattice = lm_score.normalised(into, pieces)

        def point(word: bytes) -> float:
            lattice_share = math.log(max(v, 1)) + lattice.log_marginal(word.decode())
            return (math.log10(c[word] + math.exp(lattice_share)) if c[word] else lattice_share / math.log(10)) - math.log10(n + max(v, 1) + 1)

        end = math.log10((ends + 1) / (n + max(v, 1) + 1))
        got = Counter((r.doc_id, r.n_tokens, r.train_tokens, round(r.score, 5)) for r in lm_score.score(docs, held, path).collect())
        want = Counter((k, len(lm_score.lower_words(t)) + 1, n, round(sum(map(point, lm_score.lower_words(t))) + end, 5)) for k, t in rows)
        assert {(k, t, m): s for k, t, m, s in got} == pytest.approx({(k, t, m): s for k, t, m, s in want}, abs=2e-5)
        assert sum(got.values()) == len(rows)
        # words and end: what is known, the lattice's share of the rest, and the end
        assert (c.total() + max(v, 1) + ends + 1) / (n + max(v, 1) + 1) == pytest.approx(1)


def test_marginals_sum_over_all_segmentations():
    pieces = {"▁a": -1.0, "▁ab": -2.0, "b": -1.5, "c": -1.0, "bc": -3.0, "▁": -4.0, "a": -2.5} | {f"<0x{i:02X}>": -9.0 for i in range(256)}
    lattice = lm_score.first_lattice(pieces)

    def total(word: str) -> float:
        arcs = list(lattice.arcs(word))
        paths = {0: 1.0}
        for at in range(len(word) + 1):
            for i, j, _, w in arcs:
                if i == at and i in paths:
                    paths[j] = paths.get(j, 0.0) + paths[i] * math.exp(w)
        return math.log(paths[len(word) + 1]) + lattice.end

    for word in ("abc", "a", "cab", "zz", "é"):
        assert lattice.log_marginal(word) == pytest.approx(total(word))


def test_learning_makes_held_out_text_likelier(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    untrained = lm_score.first_lattice(lm_score.load_pieces(path))
    got = {r.doc_id: r.score for r in queries.op10_lattice_scores(spark, SF).where("held_out").collect()}
    before = 0.0
    for r in table(spark, SF, "documents").collect():
        if r.doc_id in got:
            before += sum(untrained.log_marginal(w.decode()) for w in lm_score.lower_words(r.text)) / math.log(10)
    assert sum(got.values()) > 0.8 * before
