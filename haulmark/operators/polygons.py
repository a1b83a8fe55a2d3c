"""Polygons as tables of edges: containment joins and overlays of general rings, with holes.

A polygon is all edges (key, x1, y1, x2, y2) of its rings, in any direction: what lies inside an odd
number of rings is inside, so a ring in a ring is a hole. Nothing has to be convex.

Overlays cut both polygons of a key into slabs: between two heights at which any edge ends or crosses
another one, edges only run side by side. In a slab the order of the edges says what lies inside
either polygon, and every piece between two edges is a trapezoid, so areas are exact. Slabs are rows,
joined with the edges that cross them, and what a window orders is one slab of one key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .aggregates import tasks_for
from .lineage import settle


def edges(rings: DataFrame, key: str, ring: str = "ring") -> DataFrame:
    """(key, x1, y1, x2, y2) of rings (key, ring: array<struct<x, y>>), which need not be closed."""
    corners = F.col(ring)
    sides = F.transform(corners, lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), F.get(corners, (i + 1) % F.size(corners))["x"].alias("x2"), F.get(corners, (i + 1) % F.size(corners))["y"].alias("y2")))
    return rings.select(key, F.explode(sides).alias("e")).select(key, "e.*").where("x1 <> x2 OR y1 <> y2")


#: Parts that a side of `covered`'s cells is cut into, points and pieces of a cell that one group has, pairs of points and boxes that a task is meant for, and pairs that are compared at once.
FINE, CROWD, PAIRS, BLOCK = 2, 2048, 1 << 24, 1 << 17


def _pieces(shapes: DataFrame, size: float) -> DataFrame:
    """(key, cx, cy, inside, edges) of the cells that shapes (key, left, right, low, high, edges) touch or hold.

    A cell that no edge touches is inside or dropped. Another one has the edges that decide a ray from its points
    to the right, four numbers each: not those that lie left of it, nor those right of it that pass its whole
    height, which count in `inside`.
    """
    slack = size * 1e-6  # more than the rounding of a point's cell, or of where an edge enters it
    at, along = F.col("cy").cast("double"), F.col("cx").cast("double")
    bottom, top, west, east = at * size - slack, (at + 1) * size + slack, along * size - slack, (along + 1) * size + slack
    rows = shapes.select("key", "left", "right", "edges", F.explode(F.sequence("low", "high")).alias("cy"))

    def within(e: Column) -> Column:
        x_at = lambda y: F.when(e["y1"] == e["y2"], e["x1"]).otherwise(e["x1"] + (F.least(F.greatest(y, F.least(e["y1"], e["y2"])), F.greatest(e["y1"], e["y2"])) - e["y1"]) / (e["y2"] - e["y1"]) * (e["x2"] - e["x1"]))
        ends = [F.when(e["y1"] == e["y2"], e["x2"]).otherwise(x_at(bottom)), x_at(top)]
        return F.struct(*(e[c] for c in ("x1", "y1", "x2", "y2")), (F.least(*ends) - slack).alias("from"), (F.greatest(*ends) + slack).alias("to"), ((F.least(e["y1"], e["y2"]) < bottom) & (F.greatest(e["y1"], e["y2"]) > top)).alias("whole"))

    met = F.filter("edges", lambda e: (F.least(e["y1"], e["y2"]) <= top) & (F.greatest(e["y1"], e["y2"]) >= bottom))
    rows = rows.select("key", "cy", "left", "right", F.transform(met, within).alias("edges")).select("key", "cy", "edges", F.explode(F.sequence("left", "right")).alias("cx"))
    beyond = lambda e: e["whole"] & (e["from"] > east)
    rows = rows.select("key", "cx", "cy", F.filter("edges", lambda e: (e["to"] >= west) & ~beyond(e)).alias("kept"), (F.size(F.filter("edges", beyond)) % 2 == 1).alias("odd"))
    middle = (at + 0.5) * size
    touched, crossed = F.exists("kept", lambda e: e["from"] <= east), F.size(F.filter("kept", lambda e: (e["y1"] > middle) != (e["y2"] > middle))) % 2 == 1
    piece = F.when(touched, F.struct(F.col("odd").alias("inside"), F.flatten(F.transform("kept", lambda e: F.array(e["x1"], e["y1"], e["x2"], e["y2"]))).alias("edges")))
    piece = piece.when(F.col("odd") != crossed, F.struct(F.lit(True).alias("inside"), F.array().cast("array<double>").alias("edges")))
    return rows.select("key", "cx", "cy", F.explode(F.array_compact(F.array(piece))).alias("p")).select("key", "cx", "cy", "p.*")


def _hits(points: pa.Table, pieces: pa.Table) -> pa.Table:
    """(id, key) of the points (id, x, y) of a cell that its pieces (key, inside, edges) cover."""
    points, pieces = points.combine_chunks(), pieces.combine_chunks()
    x, y, inside, lists = points["x"].to_numpy(), points["y"].to_numpy(), pieces["inside"].to_numpy(), pieces["edges"].combine_chunks()
    edges, sizes = lists.flatten().to_numpy().reshape(-1, 4), lists.value_lengths().to_numpy() // 4
    x1, y1, x2, y2 = edges.T[:, :, None]
    low, high, up = np.minimum(y1, y2), np.maximum(y1, y2), np.where(y2 > y1, 1.0, -1.0)
    dx, dy = (x2 - x1) * up, (y2 - y1) * up  # a turn is positive where the edge lies to the right
    order, starts, found = np.argsort(-sizes), np.cumsum(sizes) - sizes, []
    step = max(1, BLOCK // max(1, len(x)))
    room = np.empty((2, step, len(x)))
    for rows in (order[i : i + step] for i in range(0, len(order), step)):
        hit, on = np.repeat(inside[rows][:, None], len(x), axis=1), None
        for k in range(sizes[rows[0]]):
            e = starts[rows[: np.count_nonzero(sizes[rows] > k)]] + k  # those that have as many come first
            turn, other = room[:, : len(e)]
            np.multiply(np.subtract(y, y1[e], out=turn), dx[e], out=turn)
            np.multiply(np.subtract(x, x1[e], out=other), dy[e], out=other)
            np.subtract(turn, other, out=turn)
            # the ray to the right crosses an edge if that passes the height and lies to the right
            hit[: len(e)] ^= (low[e] <= y) & (high[e] > y) & (turn > 0)
            if not turn.all():
                on = np.zeros_like(hit) if on is None else on
                on[: len(e)] |= (turn == 0) & (x >= np.minimum(x1, x2)[e]) & (x <= np.maximum(x1, x2)[e]) & (low[e] <= y) & (high[e] >= y)
        of, at = np.divmod(np.flatnonzero(hit if on is None else hit | on), len(x))
        found.append(pa.table({"id": points["id"].take(pa.array(at)), "key": pieces["key"].take(pa.array(rows[of]))}))
    return pa.concat_tables(found) if found else pa.table({"id": points["id"][:0], "key": pieces["key"][:0]})


def covered(points: DataFrame, sides: DataFrame, size: float) -> DataFrame:
    """(id, key) of the points (id, x, y) that a polygon of `sides` (key, x1, y1, x2, y2) covers, its edges included.

    A polygon is laid out on the cells that its box meets, which are a fraction of `size` wide. Cells inside it give
    all their points; in cells that an edge touches a pair is decided where point and piece meet, by the few edges
    that matter there. So neither pairs nor edges of pairs are shuffled. Pairs grow with the square of the density:
    tasks go by their number, and the points and pieces of a crowded cell are dealt to several groups.
    """
    size /= FINE
    cell = lambda v: F.floor(v / size)
    box = (F.min(cell(F.least("x1", "x2"))).alias("left"), F.max(cell(F.greatest("x1", "x2"))).alias("right"), F.min(cell(F.least("y1", "y2"))).alias("low"), F.max(cell(F.greatest("y1", "y2"))).alias("high"))
    shapes = settle(sides.groupBy("key").agg(*box, F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges")))
    placed = settle(points.select("id", "x", "y", cell(F.col("x")).alias("cx"), cell(F.col("y")).alias("cy")))
    boxes = shapes.select("left", "right", F.explode(F.sequence("low", "high")).alias("cy")).select("cy", F.explode(F.sequence("left", "right")).alias("cx"))
    count = lambda df, name: df.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias(name))
    met = settle(count(placed, "n").join(count(boxes, "boxes"), ["cx", "cy"]).select("*", *(F.ceil(F.col(c) / CROWD).alias(g) for c, g in (("n", "parts"), ("boxes", "slices")))))
    pairs, rows = met.agg(F.coalesce(F.sum(F.col("n").cast("double") * F.col("boxes")), F.lit(0.0)), F.coalesce(F.sum("boxes"), F.lit(0))).first()
    keys, tasks = ["cx", "cy", "part", "slice"], int(pairs // PAIRS) + tasks_for(rows)
    dealt = lambda c, n: F.pmod(F.hash(c), n)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    laid = _pieces(shapes, size).join(met, ["cx", "cy"]).select("cx", "cy", "key", "inside", "edges", dealt("key", "slices").alias("slice"), every("parts").alias("part"))
    near = placed.join(met, ["cx", "cy"]).select("cx", "cy", "id", "x", "y", dealt("id", "parts").alias("part"), every("slices").alias("slice"))
    near, laid = (df.repartition(tasks, *keys).groupBy(*keys) for df in (near, laid))
    kinds = {"id": points.schema["id"].dataType, "key": sides.schema["key"].dataType}
    return near.cogroup(laid).applyInArrow(lambda p, q: _hits(p.select(["id", "x", "y"]), q), StructType([StructField(c, t) for c, t in kinds.items()]))


def trapezoids(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, low, high, left_low, left_high, right_low, right_high, in_a, in_b): the pieces of all slabs of the keys'
    two polygons that lie in either; a side is given by its x at both heights."""
    every = settle(a.withColumn("own", F.lit(0)).union(b.select(*a.columns, F.lit(1).alias("own"))))
    up = every.where("y1 <> y2").select("key", "own", *(F.when(F.col("y1") < F.col("y2"), F.col(f"{c}1")).otherwise(F.col(f"{c}2")).alias(f"{c}1") for c in "xy"), *(F.when(F.col("y1") < F.col("y2"), F.col(f"{c}2")).otherwise(F.col(f"{c}1")).alias(f"{c}2") for c in "xy"))
    up = settle(up.withColumn("slope", (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))))
    p, q = (up.select("key", *(F.col(c).alias(f"{s}_{c}") for c in up.columns if c != "key")) for s in "pq")
    crosses = p.join(q, "key").where("p_slope < q_slope AND p_y1 < q_y2 AND q_y1 < p_y2")
    # where two lines meet
    at = ((F.col("p_x1") - F.col("p_slope") * F.col("p_y1")) - (F.col("q_x1") - F.col("q_slope") * F.col("q_y1"))) / (F.col("q_slope") - F.col("p_slope"))
    crosses = crosses.select("key", at.alias("y"), F.greatest("p_y1", "q_y1").alias("from"), F.least("p_y2", "q_y2").alias("to")).where("y > from AND y < to").select("key", "y")
    heights = up.select("key", F.explode(F.array("y1", "y2")).alias("y")).union(crosses).distinct()
    slabs = heights.select("key", F.col("y").alias("low"), F.lead("y").over(W.partitionBy("key").orderBy("y")).alias("high")).where("high IS NOT NULL")
    at_height = lambda y: F.col("x1") + F.col("slope") * (y - F.col("y1"))
    lines = slabs.join(up, "key").where("y1 <= low AND y2 >= high").select("key", "low", "high", "own", at_height(F.col("low")).alias("x_low"), at_height(F.col("high")).alias("x_high"))
    order = W.partitionBy("key", "low").orderBy(F.col("x_low") + F.col("x_high"), "x_low", "own")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    inside = lambda own: F.count_if(F.col("own") == own).over(upto) % 2 == 1
    pieces = lines.select("key", "low", "high", F.col("x_low").alias("left_low"), F.col("x_high").alias("left_high"), F.lead("x_low").over(order).alias("right_low"), F.lead("x_high").over(order).alias("right_high"), inside(0).alias("in_a"), inside(1).alias("in_b"))
    return pieces.where("right_low IS NOT NULL AND (in_a OR in_b)")


def areas(pieces: DataFrame) -> DataFrame:
    """(key, a, b, common, either, only_a) of trapezoids."""
    size = ((F.col("right_low") - F.col("left_low")) + (F.col("right_high") - F.col("left_high"))) / 2 * (F.col("high") - F.col("low"))
    of = lambda test: F.sum(F.when(F.expr(test), size).otherwise(0.0))
    return pieces.groupBy("key").agg(of("in_a").alias("a"), of("in_b").alias("b"), of("in_a AND in_b").alias("common"), F.sum(size).alias("either"), of("in_a AND NOT in_b").alias("only_a"))
