"""Registered queries by family; each module adds its own to the registry."""

from . import aggregates, allocations, checks, filters, formats, matches, networks, ranks, scalars, scans, shapes
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "aggregates", "allocations", "checks", "filters", "formats", "matches", "networks", "ranks", "scalars", "scans", "shapes"]
