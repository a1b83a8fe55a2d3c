"""Distances, bearings and projections as Column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


HAVERSINE_SQL = "2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x1 - x2, y1 - y2)


def bearing(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Degrees from north, clockwise, of a plane segment."""
    return F.pmod(F.degrees(F.atan2(x2 - x1, y2 - y1)) + 360, F.lit(360.0))


def turn_delta(incoming: Column, outgoing: Column) -> Column:
    """Signed turn in [-180, 180)."""
    return F.pmod(outgoing - incoming + 540, F.lit(360.0)) - 180


#: Degrees and seconds of the turn classes.
STRAIGHT, UTURN, UTURN_S, RIGHT_S, LEFT_S = 30.0, 150.0, 20.0, 3.0, 8.0


def turn_penalty_s(delta: Column) -> Column:
    return F.when(F.abs(delta) <= STRAIGHT, 0.0).when(F.abs(delta) >= UTURN, UTURN_S).when(delta > 0, RIGHT_S).otherwise(LEFT_S)


def orientation_delta(a: Column, b: Column) -> Column:
    """The angle between two undirected lines, 0 to 90 degrees."""
    off = F.pmod(a - b, F.lit(180.0))
    return F.least(off, 180 - off)


def segment_fraction(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Where on a segment its point nearest to (px, py) lies, 0 to 1."""
    dx, dy = x2 - x1, y2 - y1
    size = dx * dx + dy * dy
    return F.when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / size)))


def inside_ring(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Ray casting against a closed ring of fixed corners."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if y1 != y2:
            hit = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            crossings = crossings + hit.cast("int")
    return crossings % 2 == 1


def ring(*corners: tuple[Column, Column]) -> Column:
    """A ring of corners, counter-clockwise and not closed: array<struct<x, y>>."""
    return F.array(*(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners))


def _turns(points: Column) -> Column:
    """Each corner of a ring beside the next one."""
    n = F.size(points)
    pairs = F.transform(points, lambda p, i: F.struct(p.alias("p"), F.get(points, (i + 1) % n).alias("q")))
    return F.when(n > 0, pairs).otherwise(F.slice(pairs, 1, 0))


def ring_area(points: Column) -> Column:
    """The area in a counter-clockwise ring."""
    return F.aggregate(_turns(points), F.lit(0.0), lambda a, t: a + (t["p"]["x"] * t["q"]["y"] - t["q"]["x"] * t["p"]["y"]) / 2)


def clipped(points: Column, convex: Column) -> Column:
    """The ring of what lies in both a ring and a convex one: the sides of the convex ring cut it one after another."""

    def cut(own: Column, side: Column) -> Column:
        a, b = side["p"], side["q"]

        def left_of(p: Column) -> Column:
            return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])

        def kept(t: Column) -> Column:
            p, q, d, e = t["p"], t["q"], left_of(t["p"]), left_of(t["q"])
            share = d / F.when(d == e, 1.0).otherwise(d - e)
            crossing = F.struct((p["x"] + share * (q["x"] - p["x"])).alias("x"), (p["y"] + share * (q["y"] - p["y"])).alias("y"))
            crosses = (d >= 0) != (e >= 0)
            return F.when((d >= 0) & crosses, F.array(p, crossing)).when(d >= 0, F.array(p)).when(crosses, F.array(crossing)).otherwise(F.slice(F.array(p), 1, 0))

        return F.flatten(F.transform(_turns(own), kept))

    return F.aggregate(_turns(convex), points, cut)
