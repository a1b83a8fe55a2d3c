"""Matchings, their witnesses and sources, regions and partitions against brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

from conftest import DATA
from pyspark.sql import functions as F

from haulmark import plans
from haulmark.operators import allocation, matching, regions

SF = str(DATA / "sf0.001")


def largest(options: set[tuple]) -> int:
    near = defaultdict(list)
    for a, b in options:
        near[a].append(b)
    of: dict = {}

    def placed(a: object, seen: set) -> bool:
        for b in near[a]:
            if b not in seen:
                seen.add(b)
                if b not in of or placed(of[b], seen):
                    of[b] = a
                    return True
        return False

    return sum(placed(a, set()) for a in list(near))


def by_group(rows: list[tuple]) -> dict[object, set]:
    out = defaultdict(set)
    for g, *rest in rows:
        out[g].add(tuple(rest))
    return out


def test_matchings_are_largest_and_witnessed(spark):
    rng = random.Random(3)
    rows = [(g, rng.randrange(n), rng.randrange(100, 100 + m)) for g, n, m, k in ((1, 9, 8, 14), (2, 20, 12, 40), (3, 6, 20, 12), (4, 30, 30, 45)) for _ in range(k)]
    # a chain that proposals in the wrong order leave open, a group with a third of all rows, and rows that say nothing
    rows += [(5, i, 100 + i + j) for i in range(12) for j in (0, 1)] + [(6, rng.randrange(60), rng.randrange(100, 150)) for _ in range(150)]
    rows += rows[:10] + [(7, None, 100), (7, 1, None)]
    options = spark.createDataFrame(rows, "group long, left long, right long").repartition(5)
    pairs, witness = matching.matched(options)
    real = by_group([r for r in rows if r[1] is not None and r[2] is not None])
    got = by_group([tuple(r) for r in pairs.collect()])
    sides = by_group([tuple(r) for r in witness.collect()])
    for g, own in real.items():
        assert got[g] <= own and len({a for a, _ in got[g]}) == len({b for _, b in got[g]}) == len(got[g]) == largest(own)
        lefts, rights = ({m for s, m in sides[g] if s == side} for side in ("left", "right"))
        assert {b for a, b in own if a in lefts} == rights
        assert len(lefts) - len(rights) == len({a for a, _ in own}) - len(got[g])
        assert bool(lefts) == (len(got[g]) < len({a for a, _ in own}))
    assert 7 not in got
    pairs, witness = matching.matched(options.limit(0))
    assert pairs.count() == witness.count() == 0


def test_small_groups_take_no_rounds_and_tell_the_same(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(g, a, rng.randrange(5 + g % 3)) for g in range(40) for a in range(rng.randint(1, 8)) for _ in range(rng.randint(1, 3))]
    options = spark.createDataFrame([*rows, *rows[:9], (1, None, 2), (1, 2, None)], "group long, left long, right long").repartition(3)
    told = {}
    for few in (0, 12, 1024):  # all by rounds, some, none
        monkeypatch.setattr(matching, "FEW", few)
        pairs, witness = (sorted(map(tuple, d.collect())) for d in matching.matched(options))
        for column in (1, 2):
            assert len({(p[0], p[column]) for p in pairs}) == len(pairs)
        assert set(pairs) <= set(rows)
        told[few] = (Counter(p[0] for p in pairs), witness)
    assert told[0] == told[12] == told[1024] and {g: n for g, n in told[0][0].items()} == {g: largest(own) for g, own in by_group(rows).items()}
    monkeypatch.setattr(matching, "_in_rounds", None)
    assert matching.matched(options)[0].count() == sum(told[0][0].values())
    assert sum(x for x in Counter(w[0] for w in told[0][1]).values()) > 0


def test_sources_are_tried_in_order(spark):
    rng = random.Random(8)
    options, wanted = set(), set()
    for g in range(12):
        lefts = range(rng.randint(2, 6))
        wanted |= {(g, a) for a in lefts}
        for rank in range(3):
            options |= {(g, rank, a, rng.randrange(7)) for a in lefts for _ in range(rng.randint(0, 2 + rank))}
    pairs, attempts = matching.by_sources(spark.createDataFrame(list(wanted), "group long, left long"), spark.createDataFrame(list(options), "group long, rank int, left long, right long"), 3)
    told = {(r.group, r["rank"]): r for r in attempts.collect()}
    served = by_group([(r.group, r["rank"], r.left, r.right) for r in pairs.collect()])
    for g in range(12):
        asked = {a for h, a in wanted if h == g}
        for rank in range(3):
            size = largest({(a, b) for h, r, a, b in options if (h, r) == (g, rank)})
            r = told[g, rank]
            assert (r.wanted, r.matched, r.accepted) == (len(asked), size, size == len(asked))
            assert r.stuck_left - r.stuck_right == len(asked) - size
            if r.accepted:
                assert {x[0] for x in served[g]} == {rank} and {x[1] for x in served[g]} == asked and len({x[2] for x in served[g]}) == len(asked)
                assert (g, rank + 1) not in told
                break
        else:
            assert g not in served


def test_matchings_of_the_table(spark):
    rows = [(r.group, r.left, r.right) for r in plans.allocations._options(spark, SF).where("l_quantity >= 10").collect()]
    got = by_group([tuple(r) for r in plans.QUERIES["bipartite_match"](spark, SF).collect()])
    assert {g: len(p) for g, p in got.items()} == {g: largest(own) for g, own in by_group(rows).items()}
    told = plans.QUERIES["order_sources"](spark, SF).collect()
    assert len({r.family for r in told if r.accepted}) == sum(r.accepted for r in told) and {r["rank"] for r in told} == {0, 1, 2}


# regions
def met(members: dict, cells: list[tuple], quotas: list[tuple]) -> dict:
    room = Counter({(g, c, d): n for g, c, d, n in cells})
    return {(g, r, d): max(0, q - sum(room[g, c, d] for c, _ in members.get((g, r), ()))) for g, r, d, q in quotas}


def check_regions(spark, cells: list[tuple], edges: list[tuple], quotas: list[tuple]) -> dict:
    frames = (spark.createDataFrame(cells, "group long, id long, decile int, capacity long"), spark.createDataFrame(edges, "group long, u long, v long, w double"), spark.createDataFrame(quotas, "group long, region long, decile int, quota long"))
    found, lacks = regions.graph_regions(*frames)
    rows = found.collect()
    members = defaultdict(set)
    for r in rows:
        members[r.group, r.region].add((r.id, r.step))
    assert sum(map(len, members.values())) == len(rows) == len({(r.group, r.region, r.id) for r in rows})
    short = {(r.group, r.region, r.decile): r.deficit for r in lacks.collect()}
    assert short == {k: n for k, n in met(members, cells, quotas).items() if n}
    starts = [(g, c) for (g, r), own in members.items() for c, step in own if step == 0]
    assert len(starts) == len(set(starts)) == len(members)
    near = defaultdict(set)
    for g, u, v, _ in edges:
        near[g, u].add(v)
        near[g, v].add(u)
    for (g, r), own in members.items():
        steps = dict(own)
        seed, = (c for c, step in own if step == 0)
        reached, queue = {seed}, [seed]
        for c in queue:
            queue += (more := [v for v in near[g, c] if v in steps and v not in reached])
            reached |= set(more)
        assert reached == set(steps)  # a region hangs together
        if any((g, r, d) in short for d in range(10)):  # it has taken all that it can reach
            assert all(v in steps for c in steps for v in near[g, c] if any(x[:2] == (g, v) for x in cells) or v in steps)
    return short


def test_regions_meet_quotas_or_tell_what_lacks(spark):
    line = [(1, i, i + 1, 1.0) for i in range(1, 5)]
    cells = [(1, 1, 0, 5), (1, 2, 0, 1), (1, 2, 3, 2), (1, 3, 3, 1), (1, 4, 3, 4), (1, 5, 0, 3)]
    quotas = [(1, 7, 0, 6), (1, 7, 3, 2), (1, 8, 3, 5), (1, 9, 9, 1)]
    short = check_regions(spark, cells, line, quotas)
    assert short == {(1, 9, 9): 1}
    rng = random.Random(6)
    for n in (8, 25):
        cells = [(g, c, d, rng.randint(1, 6)) for g in (1, 2) for c in range(n) for d in range(4) if rng.random() < 0.5]
        edges = [(g, rng.randrange(n), rng.randrange(n), rng.random()) for g in (1, 2) for _ in range(3 * n)]
        quotas = [(g, r, d, rng.randint(0, 2 * n // 4)) for g in (1, 2) for r in range(3) for d in range(4)]
        check_regions(spark, cells, edges, quotas)


def test_regions_without_communities_lack_everything(spark):
    short = check_regions(spark, [(1, 1, 0, 5)], [(1, 1, 1, 0.0)], [(1, 7, 0, 2), (1, 8, 0, 1), (2, 1, 0, 3)])
    assert short == {(1, 8, 0): 1, (2, 1, 0): 3}


def test_regions_of_the_table(spark):
    rows = plans.QUERIES["graph_regions"](spark, SF).collect()
    first = [r for r in rows if r.step == 0]
    assert len({(r.kind, r.id) for r in first}) == len(first) == len({(r.kind, r.region) for r in rows})
    assert len({(r.kind, r.region, r.id) for r in rows}) == len(rows) and any(r.deficit == 0 for r in rows)


def test_nested_partitions_share_every_cell_at_every_level(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.choice("abc"), rng.choice([0, 0, 0, 1, 2])) for g, n in ((1, 1000), (2, 37), (3, 3)) for i in range(1000 * g, 1000 * g + n)]
    docs = spark.createDataFrame(rows, "city long, id long, kind string, decile int").repartition(6)
    got = allocation.nested_partition(docs, ["city"], ["kind", "decile"], "id", [2, 5, 2], "t").collect()
    assert len(got) == len(rows)
    parent = lambda r, level: (r.city, *([0] if level == 0 else [r[f"level_{level}"]]))
    for level, n in enumerate((2, 5, 2)):
        size, cell = Counter(parent(r, level) for r in got), Counter((parent(r, level), r.kind, r.decile) for r in got)
        child, part = Counter((parent(r, level), parent(r, level + 1)) for r in got), Counter((parent(r, level), parent(r, level + 1), r.kind, r.decile) for r in got)
        assert all(r[f"level_{level + 1}"] // n == (0 if level == 0 else r[f"level_{level}"]) for r in got)  # children never cross
        for (above, _), k in child.items():
            assert abs(k - size[above] / n) < 1
        for (above, _, kind, decile), k in part.items():
            assert abs(k - cell[above, kind, decile] / n) < 1
    assert set(Counter(r.level_3 for r in got if r.city == 1).values()) == {50}


def test_splits_are_near_the_share_and_even(spark):
    rng = random.Random(2)
    groups = [(g, rng.randint(1, 30), rng.randint(0, 9), rng.randint(0, 3)) for g in range(60)]
    docs = spark.createDataFrame(groups, "g long, size long, a long, b long")
    got = allocation.best_split(docs, 0.2, 64, ["a", "b"], 0.002, 0.0005).collect()
    assert {r.g for r in got} == set(range(60)) and len({(r.restart, r.count_error) for r in got}) == 1
    held = [g for g in groups if any(r.g == g[0] and r.held_out for r in got)]
    total = [sum(x) for x in zip(*groups, strict=True)]
    assert abs(abs(sum(g[1] for g in held) - total[1] * 0.2) / total[1] - got[0].count_error) < 1e-9
    error = sum(abs(sum(g[i] for g in held) - total[i] * 0.2) / max(total[i] * 0.2, 1) for i in (2, 3)) / 2
    assert abs(error - got[0].feature_error) < 1e-9 and docs.select(F.sum("size")).first()[0] == total[1]
