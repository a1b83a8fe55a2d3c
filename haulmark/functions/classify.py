"""Bands, tiers and first-match rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(*rules: tuple[Column, object], otherwise: object = None) -> Column:
    """The value of the first rule that holds; null tests don't hold."""
    (test, value), *rest = rules
    out = F.when(test, value)
    for test, value in rest:
        out = out.when(test, value)
    return out.otherwise(otherwise)


def bands(x: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the half-open band (edge before, edge] that x lies in; there is one label more than edges."""
    return first_match(*((x <= e, label) for e, label in zip(edges, labels, strict=False)), otherwise=F.when(x.isNotNull(), labels[-1]))


#: Bands of residential units.
UNIT_EDGES, UNIT_LABELS = [1, 4, 9, 19, 49], ["1", "2-4", "5-9", "10-19", "20-49", "50+"]


def unit_band(units: Column) -> Column:
    return bands(units, UNIT_EDGES, UNIT_LABELS)


def unit_kind(units: Column) -> Column:
    return bands(units, [1, 4, 19], ["house", "small_apt", "mid_apt", "large_apt"])


def decile(x: Column, edges: Column) -> Column:
    """0 to 9: how many of the nine inner edges of an 11-edge array are at most x."""
    inner = F.slice(edges, 2, 9)
    return F.aggregate(inner, F.lit(0), lambda n, e: n + (e <= x).cast("int"))


def first_blocker(*rules: tuple[Column, str]) -> Column:
    return first_match(*rules)


def reasons(*rules: tuple[Column, str]) -> Column:
    """Tokens of all rules that hold, in their order, joined with ';'."""
    return F.concat_ws(";", *(F.when(test, token) for test, token in rules))
