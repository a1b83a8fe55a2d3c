"""Joins beyond a plain equi-join. Sides are never broadcast by hint unless their size is bounded."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from haulmark.functions import geo

from .lineage import settle


def fill_left(left: DataFrame, right: DataFrame, on: list[str], fills: dict[str, object]) -> DataFrame:
    """Left join; the filled columns of `right` get their default where nothing matched."""
    return left.join(right, on, "left").na.fill(fills)


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row of each key: the first of a total order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def last_wins(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row of each key: that of the largest `order` (unique in a key). An aggregate, so it combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(*keys, *(F.col("_last")[c].alias(c) for c in rest))


def relative_gap(value: Column, reference: Column) -> Column:
    return F.when(F.abs(reference) > 1e-12, (value - reference) / F.abs(reference))


def asof_latest(marks: DataFrame, events: DataFrame, by: list[str], mark_at: str, event_at: str, values: list[str]) -> DataFrame:
    """Each mark with the last event of its key at or before it (no tolerance, never a later one).
    Of events at one time that with the largest `values` is the last.

    One shuffle and one sort by key: marks and events are one stream in which the last event is
    carried forward, so nothing is multiplied as in a range join.
    """
    held = F.struct(*values)
    a = events.select(*by, F.col(event_at).alias("_at"), F.lit(0).alias("_mark"), held.alias("_held"), F.lit(None).cast(marks.schema[mark_at].dataType).alias("_own"))
    b = marks.select(*by, F.col(mark_at).alias("_at"), F.lit(1).alias("_mark"), F.lit(None).cast(a.schema["_held"].dataType).alias("_held"), F.col(mark_at).alias("_own"))
    run = W.partitionBy(*by).orderBy("_at", "_mark", "_held").rowsBetween(W.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_last", F.last("_held", ignorenulls=True).over(run)).where("_mark = 1")
    return both.select(*by, F.col("_own").alias(mark_at), *(F.col("_last")[v].alias(v) for v in values))


def _cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("bigint")


def near(x: Column, size: float) -> Column:
    """The cells that neighbours of a point within `size` can lie in."""
    return F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: _cell(x, size) + d))


def radius_join(left: DataFrame, right: DataFrame, radius: float, on: tuple[str, ...] = (), also: tuple[str, ...] = ()) -> DataFrame:
    """All pairs of (id, x, y) rows with a distance of at most `radius`, and equal in the columns `on`: (id, other, distance),
    and the columns `also` of the right rows and the left one's x and y beside them, if there are such.

    An equi-join on grid cells of that size: each left row looks at nine cells, so only the density
    of the points counts. `right` rows stay where they are.
    """
    a = left.select(*on, "id", "x", "y", near(F.col("x"), radius).alias("cx")).select("*", near(F.col("y"), radius).alias("cy"))
    b = right.select(*on, *also, F.col("id").alias("other"), F.col("x").alias("x2"), F.col("y").alias("y2"), _cell(F.col("x"), radius).alias("cx"), _cell(F.col("y"), radius).alias("cy"))
    found = a.join(b, [*on, "cx", "cy"]).withColumn("distance", geo.distance(F.col("x"), F.col("y"), F.col("x2"), F.col("y2")))
    return found.where(F.col("distance") <= radius).select("id", "other", "distance", *(("x", "y", *also) if also else ()))


def extent(*sides: DataFrame) -> tuple[float, float]:
    """The diagonal of the box around the (x, y) rows of all sides, and the mean spacing of the last one's rows in it."""
    boxes = [s.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("x")).first() for s in sides]
    some = [b for b in boxes if b[4]]
    if not some or not boxes[-1][4]:
        return 0.0, 0.0
    wide, high = max(b[1] for b in some) - min(b[0] for b in some), max(b[3] for b in some) - min(b[2] for b in some)
    return math.hypot(wide, high), math.sqrt(max(wide * high, 1e-12) / boxes[-1][4])


def nearest_join(left: DataFrame, right: DataFrame, radius: float | None = None) -> DataFrame:
    """The nearest right row of each left row, ties by the smaller id: (id, other, distance).

    Rows that find nothing within the radius (that of the mean spacing, if none is given) go on with
    four times the radius, until it covers everything, so no row is lost and dense places stay cheap.
    Every round is an equi-join on cells. Rows without coordinates have no nearest row.
    """
    reach, spacing = extent(left, right)
    radius, parts = radius or max(spacing, reach / (1 << 40), 1e-9), []
    rest = left.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    while True:
        best = radius_join(rest, right, radius).groupBy("id").agg(F.min(F.struct("distance", "other")).alias("best"))
        parts.append(settle(best))
        if radius > reach:
            break
        rest = settle(rest.join(parts[-1].select("id"), "id", "left_anti"))
        if rest.isEmpty():
            break
        radius *= 4
    return reduce(DataFrame.union, parts).select("id", F.col("best.other").alias("other"), F.col("best.distance").alias("distance"))


def contained_join(inner: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """Pairs of (id, x, y) and the (box, x1, y1, x2, y2) that cover it, edges included; boxes are laid out on cells of `size`."""
    cells = F.sequence(_cell(F.col("x1"), size), _cell(F.col("x2"), size)), F.sequence(_cell(F.col("y1"), size), _cell(F.col("y2"), size))
    b = boxes.select("*", F.explode(cells[0]).alias("cx")).select("*", F.explode(cells[1]).alias("cy"))
    a = inner.select("id", "x", "y", _cell(F.col("x"), size).alias("cx"), _cell(F.col("y"), size).alias("cy"))
    return a.join(b, ["cx", "cy"]).where("x between x1 and x2 and y between y1 and y2").select("id", "box")


def overlap_join(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Interval pairs of one key: rows whose (start_a, end_a) and (start_b, end_b) meet."""
    return a.join(b, on).where((F.col("start_a") <= F.col("end_b")) & (F.col("start_b") <= F.col("end_a")))
