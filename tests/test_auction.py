"""Auctions against brute force, and regions that compete for residents."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from haulmark.operators import auction

UNIT = 0.5


def cheapest(options: dict[tuple, float], quotas: dict[object, int]) -> tuple[int, float]:
    """The most ids that can be placed, and the least cost of the slots given, by Bellman-Ford augmentation."""
    held: dict = {}
    total = 0.0
    while True:
        load = Counter(held.values())
        near = {c: 0.0 for c in quotas if load[c] < quotas[c]}
        back: dict = {}
        ends: dict = {}
        for _ in range(len(quotas) + 1):
            for (c, i), w in options.items():
                if c not in near or held.get(i) == c:
                    continue
                if (h := held.get(i)) is None:
                    if near[c] + w < ends.get(i, (1e18,))[0] - 1e-9:
                        ends[i] = (near[c] + w, c)
                elif near[c] + w - options[h, i] < near.get(h, 1e18) - 1e-9:
                    near[h], back[h] = near[c] + w - options[h, i], (c, i)
        if not ends:
            return len(held), total
        i, (w, c) = min(ends.items(), key=lambda x: x[1])
        total += w
        while True:
            held[i] = c
            if c not in back or Counter(held.values())[c] <= quotas[c]:
                break
            c, i = back[c]


def run(spark, rows: list[tuple], quotas: list[tuple], unit: float = UNIT):
    pairs, lacks = auction.auctioned(spark.createDataFrame(rows, "group long, cell long, id long, cost double").repartition(5), spark.createDataFrame(quotas, "group long, cell long, quota long"), unit)
    return pairs.collect(), {(r.group, r.cell): r.deficit for r in lacks.collect()}


def test_assignments_are_full_and_within_the_units_of_the_cheapest(spark):
    rng = random.Random(5)
    # a loose group, a tight one with a cell that has no alternative, one with too few ids, and one with a third of all rows
    rows = [(g, c, i, round(rng.uniform(-2, 8), 3)) for g, cells, ids, p in ((1, 3, 12, 0.7), (2, 4, 9, 0.6), (3, 4, 6, 0.6), (4, 5, 30, 0.5)) for c in range(cells) for i in range(ids) if rng.random() < p]
    rows += [(2, 9, 100, 1.0), (2, 0, 100, 0.0)]
    quotas = [(1, c, 2) for c in range(3)] + [(2, c, 2) for c in range(4)] + [(2, 9, 1)] + [(3, c, 2) for c in range(4)] + [(4, c, 3) for c in range(5)]
    # repeated, null and useless rows
    more = rows[:3] + [(1, 0, None, 1.0), (1, 0, 5, None), (1, 77, 1, 0.0), (5, 1, 1, 0.0)]
    got, lacks = run(spark, rows + more + [(g, c, i, w + 1) for g, c, i, w in rows[:4]], [*quotas, (1, 88, 0), (6, 1, 2)])
    assert lacks.pop((6, 1)) == 2
    cost = {(g, c, i): w for g, c, i, w in rows}
    for g in (1, 2, 3, 4):
        own = [r for r in got if r.group == g]
        assert len({r.id for r in own}) == len(own) and all(cost[g, r.cell, r.id] == r.cost for r in own)
        load, room = Counter(r.cell for r in own), {c: q for h, c, q in quotas if h == g}
        assert {(g, c): q - load[c] for c, q in room.items() if load[c] < q} == {k: n for k, n in lacks.items() if k[0] == g}
        options = {(c, i): w for (h, c, i), w in cost.items() if h == g}
        assert len(own) == cheapest(options, room)[0]
        n, least = cheapest(options, dict(load))
        assert n == len(own) and sum(r.cost for r in own) <= least + 2 * UNIT * n
    assert (sum(lacks.values()) > 0) and not [r for r in got if r.group in (5, 6)]


def test_fine_units_give_the_cheapest(spark):
    rows = [(1, 0, 0, 1.0), (1, 0, 1, 2.0), (1, 1, 0, 1.0), (1, 1, 2, 7.0), (1, 2, 1, 3.0), (1, 2, 3, 9.0)]
    got, lacks = run(spark, rows, [(1, 0, 1), (1, 1, 1), (1, 2, 1)], 0.1)
    assert not lacks and abs(sum(r.cost for r in got) - 11.0) < 1e-9


def test_empty_tables_place_nothing(spark):
    got, lacks = run(spark, [], [(1, 1, 3)])
    assert got == [] and lacks == {(1, 1): 3}
    assert run(spark, [(1, 1, 1, 0.0)], []) == ([], {})


def fits(pairs: list, members: list, residents: list[tuple], quotas: list[tuple], lacks: dict) -> None:
    homes = {(g, who): (c, d) for g, c, d, who in residents}
    areas = defaultdict(set)
    for m in members:
        areas[m.group, m.region].add(m.id)
    assert len({(r.group, r.who) for r in pairs}) == len(pairs)
    for r in pairs:
        home, decile = homes[r.group, r.who]
        assert decile == r.decile and home in areas[r.group, r.region]
    load = Counter((r.group, r.region, r.decile) for r in pairs)
    assert {(g, r, d): q - load[g, r, d] for g, r, d, q in quotas if load[g, r, d] < q} == lacks


def contest(spark, residents: list[tuple], members: list[tuple], links: list[tuple], quotas: list[tuple]) -> tuple[list, list, dict]:
    both = links + [(g, v, u, w) for g, u, v, w in links]
    frames = (spark.createDataFrame(residents, "group long, id long, decile int, who long"), spark.createDataFrame(members, "group long, region long, id long"), spark.createDataFrame(both, "group long, u long, v long, w double"), spark.createDataFrame(quotas, "group long, region long, decile int, quota long"))
    pairs, areas, lacks = auction.contested(*frames, F.pmod(F.col("who") * 7 + F.col("region"), F.lit(11)) / 2, UNIT)
    return pairs.collect(), areas.collect(), {(r.group, r.region, r.decile): r.deficit for r in lacks.collect()}


def test_regions_that_lose_take_in_neighbours(spark):
    # both regions want all of community 1; only region 2 could go elsewhere, two links away, past one without residents
    residents = [(1, 1, 0, w) for w in range(4)] + [(1, 3, 0, w) for w in range(10, 14)] + [(1, 9, 0, 50)]
    quotas = [(1, 1, 0, 4), (1, 2, 0, 3)]
    pairs, areas, lacks = contest(spark, residents, [(1, 1, 1), (1, 2, 1)], [(1, 1, 2, 1.0), (1, 2, 3, 1.0)], quotas)
    assert lacks == {}
    fits(pairs, areas, residents, quotas, lacks)
    assert max(a.step for a in areas) == 2
    # more than all that can be reached is told, not raised
    quotas = [(1, 1, 0, 6), (1, 2, 0, 5)]
    pairs, areas, lacks = contest(spark, residents, [(1, 1, 1), (1, 2, 1)], [(1, 1, 2, 1.0), (1, 2, 3, 1.0)], quotas)
    fits(pairs, areas, residents, quotas, lacks)
    assert sum(lacks.values()) == 3 and {a.id for a in areas} == {1, 2, 3}


def test_regions_without_competition_stay(spark):
    residents = [(1, c, d, 10 * c + d + 100 * k) for c in (1, 2) for d in (0, 1) for k in range(3)]
    quotas = [(1, 1, 0, 2), (1, 1, 1, 3), (1, 2, 1, 1)]
    pairs, areas, lacks = contest(spark, residents, [(1, 1, 1), (1, 2, 2)], [(1, 1, 2, 1.0)], quotas)
    assert lacks == {} and {a.step for a in areas} == {0}
    fits(pairs, areas, residents, quotas, lacks)


def test_few_profiles_take_no_rounds_and_rounds_give_the_same(spark, monkeypatch):
    rng = random.Random(7)
    residents = [(g, c, d, 10_000 * g + 1000 * c + 100 * d + k) for g in (1, 2) for c in range(6) for d in (0, 1) for k in range(rng.randint(0, 4))]
    quotas, links = [(g, r, d, 6) for g in (1, 2) for r in (1, 2) for d in (0, 1)], [(g, c, c + 1, 1.0 + c) for g in (1, 2) for c in range(5)]
    members = [(g, r, 2) for g in (1, 2) for r in (1, 2)]

    def none(*_):
        raise AssertionError("a round of bids")

    with monkeypatch.context() as m:
        m.setattr(auction, "_round", none)
        pairs, areas, lacks = contest(spark, residents, members, links, quotas)
    fits(pairs, areas, residents, quotas, lacks)
    monkeypatch.setattr(auction, "TOWN", 0)
    monkeypatch.setattr(auction, "ENTRIES", 0)
    by_rounds, same, short = contest(spark, residents, members, links, quotas)
    fits(by_rounds, same, residents, quotas, short)
    assert sorted(map(tuple, same)) == sorted(map(tuple, areas)) and sum(short.values()) == sum(lacks.values()) and len(by_rounds) == len(pairs)
