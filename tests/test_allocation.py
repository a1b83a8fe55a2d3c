"""Allocation, graphs and shapes against brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from haulmark import plans
from haulmark.functions import geo, hashing
from haulmark.operators import allocation, graphs, joins, windows
from haulmark.plans import allocations
from haulmark.sources import tables

SF = str(DATA / "sf0.001")


def test_labels_of_very_many_components(spark):
    members = spark.range(10_005).select(F.col("id").alias("node"), F.col("id").alias("component"))
    labels = {r.node: r.label for r in graphs.ranked(members, "W").collect()}
    assert labels == {i: f"W{i + 1:04d}" for i in range(10_005)}


def test_positions_need_no_second_run(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 1000).alias("v"), F.col("id"), F.lit("x" * 50).alias("wide"))
    got = sorted((r.v, r.id, r.position) for r in windows.global_position(rows, [F.desc("v"), "id"]).collect())
    want = sorted(((i * 7919 % 1000, i) for i in range(5000)), key=lambda r: (-r[0], r[1]))
    assert got == sorted((v, i, n) for n, (v, i) in enumerate(want))


def test_far_neighbours_are_found(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 1e9, 5.0), (3, None, 1.0)], "id int, x double, y double")
    right = spark.createDataFrame([(7, 1e9, 0.0), (8, 1e9, 0.0), (9, 1e9, 4.0)], "id int, x double, y double")
    assert {r.id: (r.other, r.distance) for r in joins.nearest_join(left, right, 1.0).collect()} == {1: (7, 1e9), 2: (9, 1.0)}
    assert {r.id: r.other for r in joins.nearest_join(left, right).collect()} == {1: 7, 2: 9}
    assert joins.nearest_join(left, right.limit(0)).count() == 0


def test_rounding_has_the_least_distance():
    rng = random.Random(5)
    for _ in range(60):
        rows, columns = rng.randint(1, 3), rng.randint(1, 3)
        whole = np.array([[rng.randint(0, 3) for _ in range(columns)] for _ in range(rows)], float)
        cells = whole.copy()
        for _ in range(4):  # moves along rectangles keep the margins whole
            a, b, c, d = rng.randrange(rows), rng.randrange(rows), rng.randrange(columns), rng.randrange(columns)
            step = min(rng.random(), cells[a, d], cells[b, c])
            if a != b and c != d:
                cells[[a, b], [c, d]] += step
                cells[[a, b], [d, c]] -= step
        up, across = whole.sum(1), whole.sum(0)
        found = allocation.rounded_margins(cells, up, across)
        assert (found.sum(1) == up).all() and (found.sum(0) == across).all()
        floor = np.floor(cells + 1e-9)
        best = min(
            np.abs(floor + np.array(bits).reshape(cells.shape) - cells).sum()
            for bits in itertools.product((0, 1), repeat=cells.size)
            if ((floor + np.array(bits).reshape(cells.shape)).sum(1) == up).all() and ((floor + np.array(bits).reshape(cells.shape)).sum(0) == across).all()
        )
        assert np.abs(found - cells).sum() == pytest.approx(best)


def test_rounded_tables_and_quotas_have_their_margins(spark):
    rows = plans.QUERIES["controlled_rounding"](spark, SF).collect()
    cities = defaultdict(list)
    for r in rows:
        cities[r.city_id].append(r)
    for own in cities.values():
        assert sum(r["count"] for r in own) == round(sum(r.share for r in own))
        for key in ("kind", "decile"):
            sums, shares = Counter(), Counter()
            for r in own:
                sums[r[key]] += r["count"]
                shares[r[key]] += r.share
            assert all(abs(sums[k] - shares[k]) < 1 + 1e-6 for k in shares)
    have = Counter((r.city_id, r.kind, r.units % 10) for r in tables.locations(spark, SF).collect())
    want = {(r.city_id, r.kind, r.decile): r["count"] for r in rows}
    for r in plans.QUERIES["quota_matrix"](spark, SF).collect():
        key = (r.city_id, r.kind, r.decile)
        assert (r.quota, r.deficit) == (min(want[key], have[key]), max(0, want[key] - have[key]))


def stable(*parts: object) -> int:
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def test_seeds_are_those_of_farthest_first(spark):
    points = defaultdict(list)
    for r in tables.points(spark, SF).collect():
        points[r.kind].append((r.point_id, r.x, r.y))
    want = set()
    for kind, own in points.items():
        chosen = [min(own, key=lambda p: (stable(p[0]), p[0]))]
        while len(chosen) < min(5, len(own)):
            rest = [p for p in own if p not in chosen]
            chosen.append(max(rest, key=lambda p: (min(math.hypot(p[1] - c[1], p[2] - c[2]) for c in chosen), -p[0])))
        want |= {(kind, rank, p[0]) for rank, p in enumerate(chosen, 1)}
    assert {(r.kind, r.rank, r.id) for r in plans.QUERIES["maxmin_seeds"](spark, SF).collect()} == want


def test_coverage_is_greedy(spark):
    groups = defaultdict(list)
    for r in allocations._communities(spark, SF).collect():
        groups[r.kind].append((r.id, r.x, r.y, r["size"]))
    got = {(r.kind, r.rank): (r.id, r.score) for r in plans.QUERIES["greedy_coverage"](spark, SF).collect()}
    for kind, own in groups.items():
        own.sort()
        near = [math.inf] * len(own)
        for rank in range(1, min(4, len(own)) + 1):
            tried = []
            for p in own:
                d = np.array([min(n, math.hypot(q[1] - p[1], q[2] - p[2])) for n, q in zip(near, own, strict=True)])
                tried.append((np.average(d, weights=[q[3] for q in own]) + 0.25 * np.quantile(d, 0.9) + 0.1 * d.max(), p[0], d))
            score, _, near = min(tried, key=lambda t: (round(t[0], 9), t[1]))
            assert got[kind, rank][1] == pytest.approx(score)


def test_blake2b_of_keys(spark):
    orders = {r.o_orderkey: r.o_orderpriority for r in tables.table(spark, SF, "orders").collect()}
    rows = plans.QUERIES["fn_blake2b_exact"](spark, SF).collect()
    assert {r.o_orderkey: r.hash for r in rows} == {k: hashlib.blake2b(f"{k}|{p}".encode(), digest_size=8).hexdigest() for k, p in orders.items()}


def test_sampled_orders_follow_their_seeds():
    rng = np.random.default_rng(4)
    seeds, units = rng.integers(0, 1 << 60, 3000), rng.integers(1, 61, 3000)
    whole = allocations.drawn_orders(seeds, units)
    part = allocations.drawn_orders(seeds[1000:1003], units[1000:1003])
    assert all(np.array_equal(whole[k][1000:1003], part[k], equal_nan=True) for k in whole)  # alone or beside others
    assert whole["packages"].min() >= 1 and whole["packages"].max() <= 72
    # a binomial given one success at least has the mean n p / (1 - q^n)
    assert whole["packages"].mean() == pytest.approx((units * 0.3 / (1 - 0.7**units) * 1.5).mean(), rel=0.04)
    one = allocations.drawn_orders(seeds, np.full(3000, 2))["packages"]
    assert one.mean() == pytest.approx(2 * 0.3 / (1 - 0.49) * 1.5, rel=0.05)
    assert np.isnan(whole["tw_start_s"]).mean() == pytest.approx(0.7, abs=0.03)
    u = allocations.uniforms(seeds, 0, 50)
    assert 0 < u.min() and u.max() < 1 and u.mean() == pytest.approx(0.5, abs=0.01)


def random_graph(seed: int, nodes: int, edges: int) -> list[tuple]:
    rng = random.Random(seed)
    return [(rng.randrange(nodes), rng.randrange(nodes), float(rng.randint(0, 9))) for _ in range(edges)]


def test_paths_and_strong_components_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(graphs, "LOGGED", 2)
    for seed, n, m in ((1, 25, 45), (2, 30, 36)):
        rows = random_graph(seed, n, m)
        cost = {(a, b): 0.0 if a == b else math.inf for a in range(n) for b in range(n)}
        for u, v, w in rows:
            cost[u, v] = min(cost[u, v], w)
        for k, i, j in itertools.product(range(n), repeat=3):
            cost[i, j] = min(cost[i, j], cost[i, k] + cost[k, j])
        edges = spark.createDataFrame(rows, "u long, v long, w double")
        starts = spark.createDataFrame([(s, s, 0.0) for s in (0, 3, 7)], "source long, node long, cost double")
        got = {(r.source, r.node): r.cost for r in graphs.shortest(edges, starts).collect()}
        assert got == {(a, b): c for (a, b), c in cost.items() if a in (0, 3, 7) and c < math.inf}
        nodes = spark.range(n).withColumnRenamed("id", "node")
        found = {r.node: r.component for r in graphs.strong_components(edges.select("u", "v"), nodes).collect()}
        assert found == {a: min(b for b in range(n) if cost[a, b] < math.inf and cost[b, a] < math.inf) for a in range(n)}


def test_rings_are_clipped(spark):
    f = F.lit
    triangle = geo.ring((f(0), f(0)), (f(4), f(0)), (f(0), f(4)))
    square = geo.ring((f(1), f(1)), (f(5), f(1)), (f(5), f(5)), (f(1), f(5)))
    away = geo.ring((f(10), f(10)), (f(11), f(10)), (f(11), f(11)), (f(10), f(11)))
    row = spark.range(1).select(*(geo.ring_area(x) for x in (triangle, geo.clipped(triangle, square), geo.clipped(square, triangle), geo.clipped(triangle, away), geo.clipped(square, square)))).first()
    assert list(row) == pytest.approx([8, 2, 2, 0, 16])


def test_stable_hashes_are_those_of_plain_python(spark):
    assert spark.range(1).select(hashing.stable_long(F.lit("a"), F.lit(7))).first()[0] == stable("a", 7)
