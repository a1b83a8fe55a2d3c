"""Queries whose tasks hold a fixed number of rows at any size, and what they rest on."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import DATA, database, rows_of, sql_rows

from haulmark import plans
from haulmark.operators import aggregates, graphs
from haulmark.sources.tables import traded


def test_edges_inside_an_envelope_are_those_of_two_passes(spark):
    rng = np.random.default_rng(2)
    values = {k: rng.integers(0, 30, n).astype(float) for k, n in (("a", 400), ("b", 1), ("c", 101))} | {"d": np.full(50, 7.0)}
    rows = [(k, float(v)) for k, of in values.items() for v in of] + [("a", None), ("e", None)]
    got = {r.k: (r.cap, r.edges) for r in aggregates.enveloped_edges(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", 0.99).collect()}
    assert set(got) == set(values)
    for k, of in values.items():
        cap = np.quantile(of, 0.99)
        assert got[k][0] == pytest.approx(cap) and got[k][1] == pytest.approx(np.quantile(of[of <= got[k][0]], np.arange(11) / 10))


@pytest.mark.parametrize("name", ["station_deciles", "join_right", "generalized_cost"])
def test_rows_are_dealt_to_tasks_by_their_number(spark, monkeypatch, name):
    monkeypatch.setattr(aggregates, "DEALT", 500)
    sf = DATA / "sf0.001"
    db = database(sf)
    tasks = db.execute("SELECT count(*) FROM lineitem").fetchone()[0] // 500 + 1
    frame = plans.QUERIES[name](spark, str(sf))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert any("hashpartitioning" in line and f", {tasks})" in line and "REPARTITION_BY_NUM" in line for line in plan.splitlines())
    assert rows_of(frame) == sql_rows(db, plans.ORACLES[name])[0]


def test_strong_components_of_dense_graphs_start_from_few_edges(spark, monkeypatch):
    rng = np.random.default_rng(4)
    inner = [(int(a) + 40 * g, int(b) + 40 * g) for g in range(3) for a, b in rng.integers(0, 40, (500, 2))]
    edges = spark.createDataFrame([*inner, *inner[:200], (0, 41), (1, 45), (81, 50), (200, 3), (3, 201), (202, 203), (203, 202)], "u int, v int")
    nodes = edges.selectExpr("explode(array(u, v)) AS node").distinct()
    rows = lambda: sorted((r.node, r.component) for r in graphs.strong_components(edges, nodes).collect())
    whole, sizes, coloured = rows(), [], graphs._coloured
    monkeypatch.setattr(graphs, "DENSE", 100)
    monkeypatch.setattr(graphs, "LIGHT", 3)
    monkeypatch.setattr(graphs, "_coloured", lambda e, n, **more: sizes.append(e.count()) or coloured(e, n, **more))
    assert rows() == whole and {c for _, c in whole} >= {0, 40, 80, 200, 201, 202}
    assert len(sizes) == 2 and sizes[0] < edges.count() / 4 and sizes[1] < edges.count() * 2 / 3


def test_trade_components_need_no_distinct_edges(spark):
    sf = str(DATA / "sf0.001")
    found = {r.node: r.component for r in plans.QUERIES["scc_trade"](spark, sf).collect()}
    edges = {(r.u, r.v) for r in traded(spark, sf).collect()}
    ahead, behind = {}, {}
    for u, v in edges:
        ahead.setdefault(u, set()).add(v)
        behind.setdefault(v, set()).add(u)

    def reach(start, of):
        seen, todo = {start}, [start]
        while todo:
            todo = [v for u in todo for v in of.get(u, ()) if v not in seen and not seen.add(v)]
        return seen

    left, want = {n for e in edges for n in e}, {}
    while left:
        start = min(left)
        part = reach(start, ahead) & reach(start, behind)
        want |= dict.fromkeys(part, start)
        left -= part
    assert found == want


def test_generalized_cost_has_every_term(spark):
    """A plain loop over each customer's routes: load, lateness and battery carried along, and the attributes of the history."""
    db = database(DATA / "sf0.001")
    found = db.execute("""SELECT o_custkey, l_orderkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag = 'N' FROM lineitem JOIN orders ON o_orderkey = l_orderkey
      ORDER BY o_custkey, l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT), l_extendedprice""").fetchall()
    solutions: dict = {}
    for customer, order, node, packages, price, station in found:
        solutions.setdefault(customer, {}).setdefault(order, []).append((node, packages, price, station))
    history, of = {}, {}
    for key, routes in solutions.items():
        of[key] = [(r[i][0], k, r[i - 1][0] if i else -1, r[i + 1][0] if i + 1 < len(r) else -1) for k, r in enumerate(routes.values()) for i in range(len(r))]
        for attribute in of[key]:
            history[attribute] = history.get(attribute, 0) + 1
    want = {}
    for key, routes in solutions.items():
        distance = load_pen = late = short = 0.0
        feasible = True
        for stops in routes.values():
            t, used, load = 28800.0, 0.0, 0.0
            for _, packages, price, station in stops:
                t, used, distance = t + price / 100, used + 1.5 * packages, distance + price / 10
                t, due = max(t, 28800 if station else 30000), 86400 if station else 31000 + 500 * packages
                late, short, load = late + max(0, t - due), short + max(0, used - 100), load + (0 if station else 1000 * packages)
                feasible &= t <= due + 1e-5 and used <= 100 + 1e-5
                t, used = (t + used * 36, 0.0) if station else (t + 30 + 2 * packages, used)
            load_pen += max(0, load - 100000)
            feasible &= load <= 100000 and any(not s[3] for s in stops)
        served = [s[0] for r in routes.values() for s in r if not s[3]]
        frequency = sum(history[a] for a in of[key])
        cost = distance + 0.01 * load_pen + 0.5 * late + 10 * short + 0.1 * distance * frequency * (len(of[key]) * len(routes)) ** 0.5 / (1e-10 + len(found))
        want[key] = (len(routes), frequency, cost, short, distance if feasible and len(set(served)) == len(served) else 1e10)
    got = {r.solution_id: (r.routes, r.frequency, r.cost, r.battery_pen, r.feasible_cost) for r in plans.QUERIES["generalized_cost"](spark, str(DATA / "sf0.001")).collect()}
    assert set(got) == set(want) and any(w[3] > 0 for w in want.values())
    for key, each in want.items():
        assert got[key] == pytest.approx(each, rel=1e-9, abs=1e-3)
