"""Polygon overlays by array functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.functions import geo
from haulmark.operators import polygons
from haulmark.sources.tables import POINTS, points

from .registry import query

#: Each point has a field of its own size; the square that clips it is the grid cell that the point is in.
CELL = 500.0


@query(f"""WITH {POINTS}, b AS (SELECT point_id, x AS x1, y AS y1, x + 50 + point_id % 11 * 60 AS x2, y + 40 + point_id % 7 * 90 AS y2, floor(x / 500) * 500 AS cx, floor(y / 500) * 500 AS cy FROM points),
  a AS (SELECT point_id, (x2 - x1) * (y2 - y1) AS area, greatest(0, least(x2, cx + 500) - greatest(x1, cx)) * greatest(0, least(y2, cy + 500) - greatest(y1, cy)) AS common FROM b)
  SELECT point_id, round(common, 6) AS common, round(area - common, 6) AS difference, round(area + 250000 - common, 6) AS either FROM a""")
def polygon_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection, difference and union areas of each point's field and the grid cell it is in."""
    x, y = F.col("x"), F.col("y")
    x2, y2 = x + 50 + F.col("point_id") % 11 * 60, y + 40 + F.col("point_id") % 7 * 90
    cx, cy = F.floor(x / CELL) * CELL, F.floor(y / CELL) * CELL
    field, cell = geo.ring((x, y), (x2, y), (x2, y2), (x, y2)), geo.ring((cx, cy), (cx + CELL, cy), (cx + CELL, cy + CELL), (cx, cy + CELL))
    rows = points(spark, sf_dir).select("point_id", field.alias("field"), cell.alias("cell")).withColumn("clip", geo.clipped(F.col("field"), F.col("cell")))
    common, area = geo.ring_area(F.col("clip")), geo.ring_area(F.col("field"))
    return rows.select("point_id", F.round(common, 6).alias("common"), F.round(area - common, 6).alias("difference"), F.round(area + geo.ring_area(F.col("cell")) - common, 6).alias("either"))


#: Eight directions, as they stand in both engines, and how far a ring's corner lies out in them.
DIRECTIONS = [(1.0, 0.0), (0.75, 0.75), (0.0, 1.0), (-0.75, 0.75), (-1.0, 0.0), (-0.75, -0.75), (0.0, -1.0), (0.75, -0.75)]


def _sql_rings(name: str, x: str, y: str, out: str, hole: str) -> str:
    """Edges of a star of eight corners and of a hole in its middle, for each point."""
    corner = lambda r: "[" + ", ".join(f"{{'x': {x} + {dx}::DOUBLE * ({r.format(k=k)}), 'y': {y} + {dy}::DOUBLE * ({r.format(k=k)})}}" for k, (dx, dy) in enumerate(DIRECTIONS)) + "]"
    return f"""{name}_rings AS (SELECT point_id AS key, {corner(out)} AS ring FROM points UNION ALL SELECT point_id, {corner(hole)} FROM points),
  {name} AS (SELECT key, ring[i].x AS x1, ring[i].y AS y1, ring[i % 8 + 1].x AS x2, ring[i % 8 + 1].y AS y2 FROM {name}_rings, (SELECT unnest(range(1, 9)) AS i))"""


FOOTPRINT, LAKE, YARD = "200 + (point_id * 37 + {k} * 91) % 300", "180 + (point_id * 53 + {k} * 67) % 260", "40 + (point_id * 11 + {k} * 29) % 80"


def _rings(rows: DataFrame, x: F.Column, y: F.Column, *outs: str) -> DataFrame:
    far = lambda out, k: F.expr(out.format(k=k))
    rings = F.array(*(geo.ring(*((x + dx * far(out, k), y + dy * far(out, k)) for k, (dx, dy) in enumerate(DIRECTIONS))) for out in outs))
    return polygons.edges(rows.select(F.col("point_id").alias("key"), F.explode(rings).alias("ring")), "key")


SLABS = """up AS (SELECT key, own, CASE WHEN y1 < y2 THEN x1 ELSE x2 END AS x1, least(y1, y2) AS y1, CASE WHEN y1 < y2 THEN x2 ELSE x1 END AS x2, greatest(y1, y2) AS y2, (x2 - x1) / (y2 - y1) AS slope FROM (SELECT *, 0 AS own FROM a UNION ALL SELECT *, 1 FROM b) WHERE y1 <> y2),
  cross_ AS (SELECT p.key, ((p.x1 - p.slope * p.y1) - (q.x1 - q.slope * q.y1)) / (q.slope - p.slope) AS y, greatest(p.y1, q.y1) AS f, least(p.y2, q.y2) AS t FROM up p JOIN up q ON p.key = q.key AND p.slope < q.slope AND p.y1 < q.y2 AND q.y1 < p.y2),
  heights AS (SELECT key, y1 AS y FROM up UNION SELECT key, y2 FROM up UNION SELECT key, y FROM cross_ WHERE y > f AND y < t),
  slabs AS (SELECT * FROM (SELECT key, y AS low, lead(y) OVER (PARTITION BY key ORDER BY y) AS high FROM heights) WHERE high IS NOT NULL),
  lines AS (SELECT key, low, high, own, x1 + slope * (low - y1) AS x_low, x1 + slope * (high - y1) AS x_high FROM slabs JOIN up USING (key) WHERE y1 <= low AND y2 >= high),
  pieces AS (SELECT key, ((lead(x_low) OVER w - x_low) + (lead(x_high) OVER w - x_high)) / 2 * (high - low) AS size, count(*) FILTER (own = 0) OVER v % 2 = 1 AS in_a, count(*) FILTER (own = 1) OVER v % 2 = 1 AS in_b FROM lines
    WINDOW w AS (PARTITION BY key, low ORDER BY x_low + x_high, x_low, own), v AS (PARTITION BY key, low ORDER BY x_low + x_high, x_low, own ROWS UNBOUNDED PRECEDING))"""


@query(f"""WITH {POINTS}, {_sql_rings("a", "x", "y", FOOTPRINT, YARD)}, {_sql_rings("b", "x + 150", "y - 100", LAKE, YARD)}, {SLABS}
  SELECT key AS point_id, round(sum(size) FILTER (in_a), 3) AS land, round(sum(size) FILTER (in_b), 3) AS water, round(coalesce(sum(size) FILTER (in_a AND in_b), 0), 3) AS common, round(sum(size) FILTER (in_a OR in_b), 3) AS either, round(sum(size) FILTER (in_a AND NOT in_b), 3) AS dry FROM pieces GROUP BY 1""")
def ring_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land and water as stars with holes around each point: union, intersection, and land without water."""
    rows = points(spark, sf_dir)
    land, water = _rings(rows, F.col("x"), F.col("y"), FOOTPRINT, YARD), _rings(rows, F.col("x") + 150, F.col("y") - 100, LAKE, YARD)
    found = polygons.areas(polygons.trapezoids(land, water))
    return found.select(F.col("key").alias("point_id"), *(F.round(c, 3).alias(n) for c, n in (("a", "land"), ("b", "water"), ("common", "common"), ("either", "either"), ("only_a", "dry"))))


@query(f"""WITH {POINTS}, {_sql_rings("a", "x", "y", FOOTPRINT, YARD)},
  t AS (SELECT point_id AS id, key, x, y, x1, y1, x2, y2, (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) AS turn FROM points, a WHERE x BETWEEN x1 - 1100 AND x1 + 1100 AND y BETWEEN y1 - 1100 AND y1 + 1100)
  SELECT id, key AS polygon FROM t GROUP BY id, key HAVING count(*) = 16 AND (bool_or(turn = 0 AND x BETWEEN least(x1, x2) AND greatest(x1, x2) AND y BETWEEN least(y1, y2) AND greatest(y1, y2)) OR count(*) FILTER ((y1 > y) <> (y2 > y) AND (turn > 0) = (y2 > y1) AND turn <> 0) % 2 = 1)""")
def points_in_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which points each point's star with a hole covers."""
    rows = points(spark, sf_dir)
    land = _rings(rows, F.col("x"), F.col("y"), FOOTPRINT, YARD)
    return polygons.covered(rows.select(F.col("point_id").alias("id"), "x", "y"), land, CELL).select("id", F.col("key").alias("polygon"))
