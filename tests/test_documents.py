"""Journals, dumps and polygons against brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from haulmark.operators import graphs, journal, polygons
from haulmark.sources import documents

SF = str(DATA / "sf0.001")


def test_dumps_with_quotes_commas_and_brackets(spark, tmp_path):
    text = r"""-- head
CREATE TABLE `t` (a int);
INSERT INTO `t` VALUES (1,'a, b'),(2, 'it''s'),(3,'back\'s \\ (x), y'),
(4,NULL),(5,''),(6,'null'), (7, 'two\nlines');
UNLOCK TABLES;
(8,'none')
INSERT INTO `u` VALUES
(-1.5, 'é;', '),(');
"""
    (tmp_path / "d.sql").write_text(text)
    got = sorted((r.table, *r["values"]) for r in documents.sql_dump(spark, f"file://{tmp_path}/d.sql").where("values[1] IS NOT NULL").collect())
    assert got == sorted([("t", "1", "a, b"), ("t", "2", "it's"), ("t", "3", "back's \\ (x), y"), ("t", "5", ""), ("t", "6", "null"), ("t", "7", "two\nlines"), ("u", "-1.5", "é;", "),(")])
    assert documents.sql_dump(spark, f"file://{tmp_path}/d.sql").where("values[1] IS NULL").count() == 1


LOG = ['{"id":1,"v":2}', "", '{"id":1,"v":3}', '{"id":2,"v":9}']


@pytest.mark.parametrize("tail", ["", '{"id":3,"v', '{"id":3,"v":7', "{"])
def test_torn_ends_are_left_out(spark, tmp_path, tail):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.jsonl").write_text("\n".join([*LOG, tail]))
    (tmp_path / "j" / "b.jsonl").write_text("\n".join(LOG) + "\n\n")
    records, torn = journal.recovered(spark, f"file://{tmp_path}/j", "id long, v long")
    assert [(r.id, r.v) for r in records.orderBy("at").collect()] == 2 * [(1, 2), (1, 3), (2, 9)]
    assert [r.tail for r in torn.collect()] == ([tail] if tail else [])
    left = journal.replayed(records, [], ["id"], F.col("at"), F.lit(False))
    journal.compacted(left, f"file://{tmp_path}/new")
    again, torn = journal.recovered(spark, f"file://{tmp_path}/new", "id long, v long")
    assert sorted((r.id, r.v) for r in again.collect()) == [(1, 3), (2, 9)] and torn.isEmpty()


@pytest.mark.parametrize("line", ['{"id":3,"v', "[1, 2]", "17"])
def test_broken_journals_are_errors(spark, tmp_path, line):
    (tmp_path / "a.jsonl").write_text("\n".join([LOG[0], line, LOG[2]]))
    with pytest.raises(ValueError, match="malformed"):
        journal.recovered(spark, f"file://{tmp_path}/a.jsonl", "id long, v long")


def test_chains_in_a_circle_are_errors(spark):
    nexts = spark.createDataFrame([(1, 2), (2, 3)], "node long, next long")
    starts = spark.createDataFrame([(1,)], "node long")
    assert sorted((r.step, r.node) for r in graphs.chains(nexts, starts, 4).collect()) == [(0, 1), (1, 2), (2, 3)]
    with pytest.raises(RuntimeError):
        graphs.chains(nexts.union(spark.createDataFrame([(3, 1)], nexts.schema)), starts, 4)


# polygons
def star(rng: random.Random, x: float, y: float, low: int, high: int) -> list[tuple]:
    out = []
    for dx, dy in ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)):
        r = rng.randint(low, high)
        out.append((float(x + dx * r), float(y + dy * r)))
    return out


def inside(x: float, y: float, rings: list[list[tuple]]) -> bool:
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if (y1 > y) != (y2 > y) and x < x1 + (x2 - x1) * (y - y1) / (y2 - y1):
                odd = not odd
    return odd


def sides(spark, polygons_: dict) -> object:
    rows = [(k, [{"x": x, "y": y} for x, y in ring]) for k, rings in polygons_.items() for ring in rings]
    return polygons.edges(spark.createDataFrame(rows, "key long, ring array<struct<x:double,y:double>>"), "key")


def test_areas_equal_a_fine_grid(spark):
    rng = random.Random(3)
    a = {k: [star(rng, 0, 0, 20, 60), star(rng, 0, 0, 4, 15)] for k in range(6)}
    b = {k: [star(rng, rng.randint(-30, 30), rng.randint(-30, 30), 15, 50), star(rng, 90, 0, 5, 9)] for k in range(6)}
    b[6] = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]]
    a[6] = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (1.0, 3.0), (3.0, 3.0), (3.0, 1.0)]]  # shares its outer ring
    got = {r.key: r for r in polygons.areas(polygons.trapezoids(sides(spark, a), sides(spark, b))).collect()}
    assert (got[6].a, got[6].b, got[6].common, got[6].either, got[6].only_a) == (12, 16, 12, 16, 0)
    step = 0.5
    for k in range(6):
        n = Counter()
        for i in range(-160, 210):
            for j in range(-160, 160):
                x, y = (i + 0.37) * step, (j + 0.41) * step
                n[inside(x, y, a[k]), inside(x, y, b[k])] += 1
        cell = step * step
        want = {"a": n[True, False] + n[True, True], "b": n[False, True] + n[True, True], "common": n[True, True], "either": sum(v for key, v in n.items() if any(key)), "only_a": n[True, False]}
        for name, cells in want.items():
            assert got[k][name] == pytest.approx(cells * cell, abs=40)
        assert got[k].a + got[k].b == pytest.approx(got[k].common + got[k].either)


def test_points_that_polygons_cover(spark):
    rng = random.Random(9)
    shapes = {k: [star(rng, rng.randint(-200, 200), rng.randint(-200, 200), 20, 90), []] for k in range(8)}
    for rings in shapes.values():
        x, y = (sum(c) / 8 for c in zip(*rings[0], strict=True))
        rings[1] = star(rng, x, y, 3, 12)
    shapes[9] = [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]]
    points = [(i, rng.uniform(-300, 300), rng.uniform(-300, 300)) for i in range(600)] + [(1000, 0.0, 5.0), (1001, 10.0, 10.0), (1002, 5.0, 0.0), (1003, 10.5, 5.0)]
    got = {tuple(r) for r in polygons.covered(spark.createDataFrame(points, "id long, x double, y double"), sides(spark, shapes), 50.0).collect()}
    want = {(i, k) for i, x, y in points[:600] for k, rings in shapes.items() if inside(x, y, rings)}
    of = defaultdict(set)
    for i, k in got:
        of[i].add(k)
    assert {p for p in got if p[0] < 1000} == want and 9 in of[1000] and 9 in of[1001] and 9 in of[1002] and 9 not in of[1003]
