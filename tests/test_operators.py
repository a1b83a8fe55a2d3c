"""Operators on small fixtures, against brute force where the data's SQL doesn't reach."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from haulmark.functions import text, time
from haulmark.operators import allocation, graphs, joins, journal, matching, replay, windows
from haulmark.sources import documents, sinks
from haulmark.sources.tables import eligible, require


@given(st.lists(st.lists(st.floats(0, 9), min_size=3, max_size=3), min_size=2, max_size=5))
@settings(max_examples=60, deadline=None)
def test_rounded_margins_are_exact(cells):
    x = np.array(cells)
    total = round(x.sum())

    def whole(v):
        out = np.floor(v)
        for k in np.argsort(-(v - out))[: int(total - out.sum())]:
            out[k] += 1
        return out if out.sum() == total else None

    if total == 0:
        return
    x = x * total / x.sum()
    up, across = whole(x.sum(1)), whole(x.sum(0))
    if up is None or across is None:
        return
    found = allocation.rounded_margins(x, up, across)
    assert (found.sum(1) == up).all() and (found.sum(0) == across).all() and (found >= 0).all()
    assert np.abs(found - x).max() < 3


def test_matching_is_as_large_as_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(g, int(a), int(b)) for g in range(6) for a in range(5) for b in range(5) if rng.random() < 0.35]
    found = matching.matched(spark.createDataFrame(rows, "group int, left int, right int"))[0].withColumnRenamed("group", "g").collect()
    for g in range(6):
        own = {(a, b) for k, a, b in rows if k == g}
        best = max((sum((a, b) in own for a, b in enumerate(p)) for p in itertools.permutations(range(5))), default=0)
        got = [(r.left, r.right) for r in found if r.g == g]
        assert len(got) == best and set(got) <= own and len({a for a, _ in got}) == len({b for _, b in got}) == best


def test_assignment_costs_as_little_as_brute_force(spark):
    rng = np.random.default_rng(7)
    cost = rng.integers(1, 30, (5, 2))
    options = spark.createDataFrame([(0, i, c, float(cost[i, c])) for i in range(5) for c in range(2)], "g int, id int, cell int, cost double")
    quotas = spark.createDataFrame([(0, 0, 3), (0, 1, 2)], "g int, cell int, quota int")
    got = allocation.assigned(options, quotas, "g").collect()
    best = min(sum(cost[i, c] for i, c in enumerate(p)) for p in itertools.product(range(2), repeat=5) if p.count(0) == 3)
    assert len(got) == 5 and sum(r.cost for r in got) == best


def test_split_and_seeds_cover_their_groups(spark):
    rows = spark.createDataFrame([("k", i, float(i % 7), float(i // 7), 1 + i % 3) for i in range(40)], "kind string, id long, x double, y double, size int")
    seeds = allocation.farthest_seeds(rows, "kind", 4).collect()
    assert [r["rank"] for r in sorted(seeds, key=lambda r: r["rank"])] == [1, 2, 3, 4] and len({r.id for r in seeds}) == 4
    grown = allocation.grown_regions(rows, "kind", 20.0, 4).collect()
    assert sorted(r.id for r in grown) == list(range(40)) and {r.region for r in grown} == {0, 1, 2, 3}
    cover = allocation.greedy_cover(rows.withColumnRenamed("size", "weight"), "kind", 3).orderBy("rank").collect()
    assert [r.score for r in cover] == sorted((r.score for r in cover), reverse=True)
    tries = allocation.balanced_split(spark.createDataFrame([(i, 10) for i in range(10)], "g int, size int"), 0.3, 4)
    assert {r.n for r in tries.where("held_out").groupBy("restart").agg(F.sum("size").alias("n")).collect()} == {30}


def test_graph_operators_match_brute_force(spark):
    rng = np.random.default_rng(3)
    edges = {(int(a), int(b)): float(rng.integers(1, 9)) for a, b in rng.integers(0, 14, (26, 2)) if a != b}
    df = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "u int, v int, w double")
    dist = np.full((14, 14), np.inf)
    np.fill_diagonal(dist, 0)
    for (a, b), w in edges.items():
        dist[a, b] = w
    for k in range(14):
        dist = np.minimum(dist, dist[:, k : k + 1] + dist[k])
    starts = spark.range(14).select(F.col("id").cast("int").alias("source"), F.col("id").cast("int").alias("node"), F.lit(0.0).alias("cost"))
    got = {(r.source, r.node): r.cost for r in graphs.shortest(df, starts).collect()}
    assert got == {(a, b): dist[a, b] for a in range(14) for b in range(14) if np.isfinite(dist[a, b])}
    nodes = spark.range(14).select(F.col("id").cast("int").alias("node"))
    strong = {r.node: r.component for r in graphs.strong_components(df, nodes).collect()}
    assert strong == {a: min(b for b in range(14) if np.isfinite(dist[a, b] + dist[b, a])) for a in range(14)}
    either = np.isfinite(np.minimum(dist, dist.T))
    for k in range(14):
        either |= either[:, k : k + 1] & either[k]
    weak = {r.node: r.component for r in graphs.components(df.select(F.col("u").alias("a"), F.col("v").alias("b"))).collect()}
    assert weak == {a: int(np.flatnonzero(either[a])[0]) for a in range(14) if either[a].sum() > 1}


def test_grid_joins_match_brute_force(spark):
    rng = np.random.default_rng(1)
    a, b = rng.uniform(-50, 50, (30, 2)).round(3), np.vstack((rng.uniform(-50, 50, (25, 2)), [[4000.0, 0.0]])).round(3)
    left = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(a)] + [(99, 3000.0, 0.0)], "id int, x double, y double")
    right = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(b)], "id int, x double, y double")
    far = np.hypot(*(a[:, None] - b[None]).transpose(2, 0, 1))
    assert {(r.id, r.other) for r in joins.radius_join(left, right, 8.0).collect()} == {(int(i), int(j)) for i, j in zip(*np.nonzero(far <= 8.0), strict=True)}
    nearest = {r.id: r.other for r in joins.nearest_join(left, right, 5.0).collect()}
    assert nearest == {i: int(row.argmin()) for i, row in enumerate(far)} | {99: 25}


def test_asof_never_looks_ahead(spark):
    events = spark.createDataFrame([(1, 10, "a"), (1, 20, "b"), (2, 5, "c")], "k int, t int, v string")
    marks = spark.createDataFrame([(1, 9), (1, 10), (1, 25), (2, 4), (3, 7)], "k int, at int")
    got = {(r.k, r.at): r.v for r in joins.asof_latest(marks, events, ["k"], "at", "t", ["v"]).collect()}
    assert got == {(1, 9): None, (1, 10): "a", (1, 25): "b", (2, 4): None, (3, 7): None}


def test_positions_cover_ties_and_empty_tables(spark):
    rows = spark.createDataFrame([(5,), (5,), (1,), (9,)], "v int")
    assert sorted((r.v, r.position) for r in windows.global_position(rows, ["v"]).collect()) == [(1, 0), (5, 1), (5, 2), (9, 3)]
    assert windows.global_position(rows.limit(0), ["v"]).count() == 0


def test_journal_resets_and_upserts(spark):
    log = spark.createDataFrame([("a", 1, "x", 1.0), ("a", 2, "reset", 0.0), ("a", 3, "x", 2.0), ("b", 1, "x", 5.0), ("b", 2, "x", 6.0)], "scope string, t int, kind string, v double")
    got = {(r.scope, r.kind): r.v for r in journal.replayed(log, ["scope"], ["kind"], "t", F.col("kind") == "reset").collect()}
    assert got == {("a", "x"): 2.0, ("b", "x"): 6.0}
    tasks = spark.createDataFrame([(1, "p"), (2, "p")], "id int, contract string")
    done = spark.createDataFrame([(1, "p", "OK"), (2, "q", "OK"), (2, "p", "RUNNING")], "id int, contract string, status string")
    assert [r.id for r in journal.pending(tasks, done, ["id", "contract"], ["OK"]).collect()] == [2]
    assert sorted(map(tuple, journal.upsert(tasks, spark.createDataFrame([(2, "z"), (3, "y")], "id int, contract string"), ["id"]).collect())) == [(1, "p"), (2, "z"), (3, "y")]


def test_replay_waits_charges_and_counts(spark):
    stop = "array<struct<at:int,travel_s:double,energy:double,demand:double,tw0:double,tw1:double,service_s:double,station:boolean>>"
    rows = spark.createDataFrame([(1, [(1, 100.0, 60.0, 5.0, 500.0, 600.0, 10.0, False), (2, 100.0, 60.0, 6.0, 0.0, 550.0, 0.0, True)])], f"route int, stops {stop}")
    r = replay.replayed(rows, 0.0, 10.0).first()
    assert (r.n, r.late, r.empty, r.over, r.battery, r.load) == (2, 1, 1, 1, 100.0, -1.0)
    assert r.end_s == 610.0 + 120.0 * 36


def test_document_formats(spark, tmp_path):
    (tmp_path / "seq").write_bytes(b'\x1e{"a": 1}\n\x1e{"a": 2}\n')
    assert sorted(r.a for r in documents.record_separated_json(spark, str(tmp_path / "seq"), "a int").collect()) == [1, 2]
    (tmp_path / "lines").write_text('{"type": "Collection", "features": [\n{"a": 1},\n{"a": 2}\n]}\n')
    assert sorted(r.a for r in documents.tolerant_json_lines(spark, str(tmp_path / "lines"), "a int", "a").collect()) == [1, 2]
    (tmp_path / "g.xml").write_text('<graphml><graph><node id="1"><data key="x">0.5</data></node><node id="2"/><edge source="1" target="2"><data key="length">7</data></edge></graph></graphml>')
    nodes, edges = documents.graphml(spark, str(tmp_path / "g.xml"))
    assert {r.node: dict(r.data) for r in nodes.collect()} == {"1": {"x": "0.5"}, "2": {}}
    assert [(r.u, r.v, r.data["length"]) for r in edges.collect()] == [("1", "2", "7")]
    np.save(tmp_path / "m.npy", np.arange(6, dtype=np.float32).reshape(2, 3))
    assert sorted((r.i, r.j, r.value) for r in documents.matrices(spark, str(tmp_path / "m.npy"), 4).collect()) == [(k // 3, k % 3, float(k)) for k in range(6)]


def test_sinks_refuse_to_replace(spark, tmp_path):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(10)], "id int, cohort string")
    sinks.write_partitioned(df, str(tmp_path / "p"), "cohort", order=["id"])
    assert spark.read.parquet(str(tmp_path / "p")).where("cohort = 'a'").count() == 5
    with pytest.raises(Exception, match="already exists"):
        sinks.write_new(df, str(tmp_path / "p"))


def test_gates_and_parsers_on_nulls(spark):
    df = spark.createDataFrame([(1, True), (2, None), (3, False)], "id int, gate boolean")
    assert [r.id for r in eligible(df, "gate", "id").collect()] == [1]
    with pytest.raises(ValueError, match="nope"):
        require(df, "nope")
    one = spark.range(1).select(
        text.speed_tag(F.lit("30 mph;50"))["kph"].alias("a"), text.speed_tag(F.lit("30 mph;walk"))["kph"].alias("b"), text.tri_bool(F.lit(None).cast("string")).alias("c"), text.unsafe_path(F.lit("a/../b")).alias("d"),
        text.unsafe_path(F.lit("a/b")).alias("e"), text.try_number(F.lit("1e999")).alias("f"), text.checkpoint_label(F.lit(0.5)).alias("g"), time.day_type(F.lit("2024-01-06").cast("date")).alias("h"),
        text.normalize(F.lit("  A--b c ")).alias("i"), F.array_join(text.multivalue(F.lit("['a', 'b']")), "+").alias("j")).first()
    assert tuple(one) == (30 * 1.609344, None, None, True, False, None, "0p5s", "weekend", "a b c", "a+b")


def test_labels_of_many_components_differ(spark):
    members = spark.range(10_012).select(F.col("id").alias("node"), F.col("id").alias("component"))
    labels = {r.node: r.label for r in graphs.ranked(members, "W").collect()}
    assert labels == {i: f"W{i + 1:04d}" for i in range(10_012)}
