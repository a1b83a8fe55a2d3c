"""Paths, their trees and the ways between terminals against brute force."""

from __future__ import annotations

import heapq
import random
from collections import defaultdict

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from haulmark import plans
from haulmark.operators import graphs, routing
from haulmark.sources import tables

SF = str(DATA / "sf0.001")


def labels(edges: list[tuple], source: int) -> dict:
    """(cost, second, hops) of every node, by Dijkstra's order on the labels."""
    out = defaultdict(list)
    for u, v, w, t in edges:
        out[u].append((v, w, t))
    done, heap = {}, [((0, 0, 0), source)]
    while heap:
        label, u = heapq.heappop(heap)
        if u not in done:
            done[u] = label
            for v, w, t in out[u]:
                heapq.heappush(heap, ((label[0] + w, label[1] + t, label[2] + 1), v))
    return done


def graph(seed: int, n: int, m: int) -> list[tuple]:
    """Edges of few different costs, some of none, so that many ways are equally cheap."""
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n), rng.randint(0, 2), rng.randint(0, 2)) for _ in range(m)]


def test_trees_and_their_paths(spark, monkeypatch):
    monkeypatch.setattr(routing, "LOGGED", 2)
    for seed in (1, 2):
        rows = graph(seed, 30, 110)
        edges = spark.createDataFrame(rows, "u long, v long, w long, t long")
        starts = spark.createDataFrame([(s, s, 0, 0) for s in (0, 5, 9)], "source long, node long, cost long, second long")
        tree = routing.shortest_tree(edges, starts)
        got = {(r.source, r.node): r for r in tree.collect()}
        want = {(s, v): label for s in (0, 5, 9) for v, label in labels(rows, s).items()}
        assert {k: (r.cost, r.second, r.hops) for k, r in got.items()} == want
        for (s, v), r in got.items():
            leads = [u for u, x, w, t in rows if x == v and (s, u) in want and (want[s, u][0] + w, want[s, u][1] + t, want[s, u][2] + 1) == want[s, v]]
            assert r.previous == (min(leads) if r.hops else None)
        cheapest = defaultdict(lambda: (9, 9))
        for u, v, w, t in rows:
            cheapest[u, v] = min(cheapest[u, v], (w, t))
        for r in routing.paths(tree).collect():
            steps = [cheapest[a, b] for a, b in zip(r.path, r.path[1:], strict=False)]
            assert r.path[0] == r.source and r.path[-1] == r.node
            assert (sum(w for w, _ in steps), sum(t for _, t in steps), len(steps)) == want[r.source, r.node]


def test_empty_graphs_have_only_sources(spark):
    edges = spark.createDataFrame([], "u long, v long, w long, t long")
    starts = spark.createDataFrame([(1, 1, 0, 0)], "source long, node long, cost long, second long")
    assert [tuple(r) for r in routing.shortest_tree(edges, starts).collect()] == [(1, 1, 0, 0, 0, None)]
    assert routing.paths(routing.shortest_tree(edges, starts.limit(0))).count() == 0


def ways(edges: dict, turns: list[tuple], options: list[tuple]) -> dict:
    """The least (time, length, option, option) of each pair of a family, edge by edge."""
    onto = [(a, b, p + edges[b][0], edges[b][1]) for a, b, p in turns]
    best: dict = {}
    for f, i, oi, ei, ai, ti, li in options:
        tree = labels(onto, ei)
        for g, j, oj, ej, aj, tj, lj in options:
            if f != g:
                continue
            if i == j:
                best[f, i, j] = (0, 0, min(o[2] for o in options if o[:2] == (f, i)), min(o[2] for o in options if o[:2] == (f, i)))
                continue
            found = [(ti + (1 - ai) * edges[ei][0] + tree[a][0] + p + aj * edges[ej][0] + tj, li + (1 - ai) * edges[ei][1] + tree[a][1] + aj * edges[ej][1] + lj, oi, oj) for a, b, p in turns if b == ej and a in tree]
            if ei == ej and ai <= aj:
                found.append((ti + (aj - ai) * edges[ei][0] + tj, li + (aj - ai) * edges[ei][1] + lj, oi, oj))
            for x in found:
                best[f, i, j] = min(best.get((f, i, j), x), x)
    return best


def test_ways_between_terminals(spark):
    rng = random.Random(4)
    # a ring of one-way roads both ways round, with a dead end (9 -> 10) and quarters as places, so that sums are exact
    edges = {e: (4 * rng.randint(1, 3), 4 * rng.randint(1, 3)) for e in range(12)}
    ends = {e: (e, (e + 1) % 6) for e in range(6)} | {6 + e: ((e + 1) % 6, e) for e in range(3)} | {9: (2, 8), 10: (2, 4), 11: (4, 2)}
    turns = [(a, b, rng.choice([0, 0, 1])) for a in edges for b in edges if ends[a][1] == ends[b][0]]
    options = [(f, 10 * f + i, o, rng.randrange(12), rng.choice([0.0, 0.25, 0.5, 1.0]), rng.randint(0, 2), rng.randint(0, 2)) for f in range(2) for i in range(5) for o in range(2)]
    options.append((0, 5, 0, 3, 0.25, 0, 0))
    options.append((0, 6, 0, 3, 0.75, 0, 0))
    options.append((0, 7, 0, 9, 0.5, 0, 0))
    got = routing.access_matrix(
        spark.createDataFrame([(e, *x) for e, x in edges.items()], "edge long, time long, length long"), spark.createDataFrame(turns, "a long, b long, penalty long"),
        spark.createDataFrame(options, "family long, terminal long, option int, edge long, at double, link_time long, link_length long"))
    found = {(r.family, r.i, r.j): (r.time, r.length, r.option_i, r.option_j) for r in got.collect()}
    want = ways(edges, turns, options)
    assert found == want and found[0, 5, 6][0] == edges[3][0] / 2  # straight along one edge
    assert len(want) < sum(1 for a in {o[:2] for o in options} for b in {o[:2] for o in options} if a[0] == b[0])  # the dead end leads nowhere


def test_paths_of_the_table_cost_what_they_say(spark):
    edges = {(r.u, r.v): r.w for r in tables.timed_trade(spark, SF).collect()}
    rows = plans.QUERIES["route_paths"](spark, SF).collect()
    assert rows and max(r.hops for r in rows) > 1
    for r in rows:
        nodes = list(map(int, r.path.split(">")))
        assert len(nodes) == r.hops + 1 and sum(edges[a, b] for a, b in zip(nodes, nodes[1:], strict=False)) == r.cost


@pytest.mark.parametrize("name", ["sssp_tree", "access_matrix"])
def test_results_have_one_row_for_each_pair(spark, name):
    rows = plans.QUERIES[name](spark, SF)
    key = ["source", "node"] if name == "sssp_tree" else ["i", "j"]
    assert rows.groupBy(*key).count().where(F.col("count") > 1).isEmpty()


def test_dense_graphs_settle_over_their_cheapest_edges_first(spark, monkeypatch):
    monkeypatch.setattr(graphs, "DENSE", 0)
    monkeypatch.setattr(graphs, "LIGHT", 2)
    rng = random.Random(3)
    # some nodes are reached by no edge, some by dear ones only, and some by ways of dear and cheap ones
    rows = [(rng.randrange(40), rng.randrange(36), rng.choice([0, 1, 2, 3, 9, 20, 21, 50]), rng.randint(0, 2)) for _ in range(500)]
    rows = [r for r in rows if r[1] % 9 or r[2] > 3]
    edges = spark.createDataFrame(rows, "u long, v long, w long, t long").coalesce(1)
    starts = spark.createDataFrame([(s, s, 0, 0) for s in (0, 39)], "source long, node long, cost long, second long").coalesce(1)
    want = {(s, v): label for s in (0, 39) for v, label in labels(rows, s).items()}
    used, least_costs = [], graphs.least_costs
    monkeypatch.setattr(graphs, "least_costs", lambda *a: used.append(least_costs(*a)) or used[-1])
    got = {(r.source, r.node): (r.cost, r.second, r.hops) for r in routing.shortest_tree(edges, starts).collect()}
    assert got == want
    assert {(r.source, r.node): r.cost for r in used[0][0].collect()} == {k: label[0] for k, label in want.items()}
    assert used[0][1].count() < len(rows)  # the others are on no least way


def test_edges_of_two_costs_are_aggregated_without_sorting(spark):
    plan = tables.timed_trade(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
