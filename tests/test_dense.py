"""Spatial queries where many points lie close together: what is paired and shuffled may not grow with their density."""

from __future__ import annotations

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import rows_of, sql_rows
from pyspark.sql import functions as F

from haulmark import plans
from haulmark.operators import joins, polygons

N = 1200


@pytest.fixture(scope="module")
def dense(tmp_path_factory) -> str:
    """Points on a square of 600 m."""
    rng, folder = random.Random(3), tmp_path_factory.mktemp("dense")
    vectors = [[round(rng.uniform(-0.03, 0.03), 6) for _ in range(2)] for _ in range(N)]
    rows = pa.table({"vec_id": pa.array(range(N), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([i % 10 for i in range(N)], pa.int32())})
    pq.write_table(rows, folder / "embeddings.parquet")
    return str(folder)


def expected(name: str, folder: str) -> list[tuple]:
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet')")
    return sql_rows(db, plans.ORACLES[name])[0]


@pytest.mark.parametrize(("name", "most"), [("knn_join_1", 150), ("best_match_ambiguity", 60)])
def test_pairs_of_a_point_do_not_grow_with_density(spark, dense, monkeypatch, name, most):
    pairs, plain = [], joins.radius_join

    def counted(*args, **more):
        found = plain(*args, **more)
        pairs.append(found.count())
        return found

    monkeypatch.setattr(joins, "radius_join", counted)
    # the last digit of a rounded fraction may differ where it is a half
    assert [pytest.approx(r, abs=2e-6) if name == "knn_join_1" else r for r in rows_of(plans.QUERIES[name](spark, dense))] == expected(name, dense)
    assert sum(pairs) <= most * N / 2


def test_pairs_of_points_and_polygons_are_not_shuffled(spark, dense):
    found = plans.QUERIES["points_in_rings"](spark, dense)
    assert rows_of(found) == expected("points_in_rings", dense)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any("hashpartitioning(id" in line for line in plan.splitlines())


def test_pairs_of_points_and_polygons_are_dealt_by_their_number(spark, dense, tmp_path, monkeypatch):
    """Copies of one point crowd a cell: its points and pieces go to several groups, and those to tasks by their pairs."""
    table = pq.read_table(f"{dense}/embeddings.parquet").to_pylist()
    crowd = [r | {"vec_id": N + i, "embedding": [0.001, 0.002]} for i, r in enumerate(table[:300])]
    pq.write_table(pa.Table.from_pylist(table + crowd, pq.read_schema(f"{dense}/embeddings.parquet")), tmp_path / "embeddings.parquet")
    monkeypatch.setattr(polygons, "CROWD", 100, raising=False)
    monkeypatch.setattr(polygons, "PAIRS", 1 << 16, raising=False)
    found = plans.QUERIES["points_in_rings"](spark, str(tmp_path))
    assert rows_of(found) == expected("points_in_rings", str(tmp_path))
    tasks = sorted(r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect())
    assert len(tasks) >= 20 and tasks[-1] < sum(tasks) / 5


def test_points_on_edges_corners_and_borders_of_cells(spark):
    """Whole numbers, so that points lie on edges, corners and on the borders of cells, inside and outside."""
    rng, size = random.Random(5), 8.0
    rings = [(k, [{"x": float(rng.randint(-12, 12)), "y": float(rng.randint(-12, 12))} for _ in range(rng.choice([3, 4, 9]))]) for k in range(40) for _ in range(2)]
    rings += [(50, [{"x": x, "y": y} for x, y in ((-8.0, -8.0), (8.0, -8.0), (8.0, 8.0), (-8.0, 8.0))]), (51, [{"x": -40.0, "y": 3.0}, {"x": 40.0, "y": 3.0}, {"x": 0.0, "y": 4.0}])]
    sides = polygons.edges(spark.createDataFrame(rings, "key long, ring array<struct<x:double,y:double>>"), "key")
    points = [(i, float(i % 29 - 14), float(i // 29 - 14)) for i in range(29 * 29)]
    db, at = duckdb.connect(), pa.table(dict(zip(("id", "x", "y"), map(list, zip(*points, strict=True)), strict=True)))
    edges = pa.Table.from_pylist([r.asDict() for r in sides.collect()])
    db.register("p", at), db.register("e", edges)
    want = db.execute("""SELECT id, key FROM (SELECT *, (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) AS turn FROM p, e) GROUP BY ALL
      HAVING bool_or(turn = 0 AND x BETWEEN least(x1, x2) AND greatest(x1, x2) AND y BETWEEN least(y1, y2) AND greatest(y1, y2)) OR count(*) FILTER ((y1 > y) <> (y2 > y) AND (turn > 0) = (y2 > y1) AND turn <> 0) % 2 = 1""").fetchall()
    got = polygons.covered(spark.createDataFrame(points, "id long, x double, y double"), sides, size).collect()
    assert sorted(map(tuple, got)) == sorted(want)
