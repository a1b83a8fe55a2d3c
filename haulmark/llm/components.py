"""Connected components of a table of edges, each round a join and a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, comp): the smallest node that each node of edges (a, b) reaches.

    Alternating large-star and small-star steps: every step keeps the components and links nodes
    to smaller ones, and so halves the depth about each round; edges never grow in number. Loops and
    repeated edges change nothing; nodes without an edge to another aren't among the rows; edges with
    a null end are left out; no edges give no rows.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(rounds):
        # large star: each node's larger neighbours are linked to its smallest neighbour
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours are linked to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = materialize(small)
        same = after.count() == now.count() and after.exceptAll(now).isEmpty()
        forget(now)
        now = after
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("comp"))
    out = materialize(now.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(roots).distinct())
    forget(now)
    return out
