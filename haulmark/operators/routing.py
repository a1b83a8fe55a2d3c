"""Shortest paths with their trees: a label of costs travels with the relaxation, and so do the ways.

A label is (cost, second, hops, previous) and labels are compared in that order: of equally cheap ways
the one with the lesser second cost wins, then that of fewer edges, then that of the smaller previous
node. Each edge adds one hop, so trees have no cycles, not even over edges that cost nothing. Costs
should be whole numbers where ties matter: sums of doubles are equal only by chance.

As in `graphs.shortest`, a round joins and writes only labels that have improved.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graphs
from .lineage import forget, settle

#: Rounds after which what is known is compacted.
LOGGED = 8


def shortest_tree(edges: DataFrame, sources: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(source, node, cost, second, hops, previous): the least label of each node from each source.

    edges: (u, v, w, t), of which w >= 0 is added to `cost` and t >= 0 to `second`; sources: (source, node, cost,
    second). A source's own node has no previous one. Parallel edges and loops do no harm.

    Costs settle first; least labels go only over edges that cost just what their ends differ by, so
    the rest of a label is looked for on these, about one for each node and source.
    """
    key = ["source", "node"]
    edges = settle(edges.select("u", "v", "w", "t"))
    costs, useful = graphs.least_costs(edges, sources, rounds)
    costs = settle(costs)
    away = costs.select("source", F.col("node").alias("u"), "cost").join(useful, "u").select("source", "u", "v", (F.col("cost") + F.col("w")).alias("cost"), "t")
    tight = settle(away.join(costs.withColumnRenamed("node", "v"), ["source", "v", "cost"]).groupBy("source", "u", "v").agg(F.min("t").alias("t")))
    none = F.lit(None).cast(edges.schema["u"].dataType)
    label = lambda second, hops, previous: F.struct(second.alias("second"), hops.cast("int").alias("hops"), previous.alias("previous")).alias("label")
    least = lambda log: reduce(DataFrame.union, log).groupBy(*key).agg(F.min("label").alias("label"))
    frontier = settle(sources.join(costs, [*key, "cost"], "left_semi").groupBy(*key).agg(F.min(label(F.col("second"), F.lit(0), none)).alias("label")))
    log = [frontier]
    for _ in range(rounds):
        step = label(F.col("label.second") + F.col("t"), F.col("label.hops") + 1, F.col("u"))
        reached = frontier.withColumnRenamed("node", "u").join(tight, ["source", "u"]).select("source", F.col("v").alias("node"), step).groupBy(*key).agg(F.min("label").alias("new"))
        known = reduce(DataFrame.union, log).join(reached.select(*key), key, "left_semi").groupBy(*key).agg(F.min("label").alias("label"))
        better = reached.join(known, key, "left").where(F.col("label").isNull() | (F.col("new") < F.col("label")))
        frontier = settle(better.select(*key, F.col("new").alias("label")))
        if frontier.isEmpty():
            return least(log).join(costs, key).select(*key, "cost", "label.*")
        log.append(frontier)
        if len(log) > LOGGED:
            before, log = log, [settle(least(log)), frontier]
            forget(*before[:-1])
    raise RuntimeError("labels did not settle")


def paths(tree: DataFrame) -> DataFrame:
    """(source, node, path): the nodes from each source to each node of a `shortest_tree`, both included.

    All paths of one number of hops are one join with those of a hop less.
    """
    tree = settle(tree.select("source", "node", "hops", "previous"))
    now = settle(tree.where("hops = 0").select("source", "node", F.array("node").alias("path")))
    out = [now]
    for hops in range(1, (tree.agg(F.max("hops")).first()[0] or 0) + 1):
        before = now.select("source", F.col("node").alias("previous"), "path")
        now = settle(tree.where(F.col("hops") == hops).join(before, ["source", "previous"]).select("source", "node", F.concat("path", F.array("node")).alias("path")))
        out.append(now)
    return reduce(DataFrame.union, out)


def turning(edges: DataFrame, turns: DataFrame) -> DataFrame:
    """(u, v, w, t) between edges (edge, time, length): going on from edge `a` to `b` of turns (a, b, penalty) costs the
    penalty and b's time, and b's length as second cost."""
    onto = edges.select(F.col("edge").alias("b"), "time", "length")
    return turns.join(onto, "b").select(F.col("a").alias("u"), F.col("b").alias("v"), (F.col("penalty") + F.col("time")).alias("w"), F.col("length").alias("t"))


def access_matrix(edges: DataFrame, turns: DataFrame, options: DataFrame) -> DataFrame:
    """(family, i, j, time, length, option_i, option_j): the quickest way between all terminals of a family, and of
    equally quick ones the shortest, with the options it leaves and arrives by.

    edges: (edge, time, length); turns: (a, b, penalty), which edge may follow which; options: (family, terminal,
    option, edge, at, link_time, link_length), where a terminal is linked to a road: `at` is the place on the
    edge, from 0 to 1. A way goes on from there to the edge's end, over other edges, and along the last
    edge up to its place; on one edge it may go straight from a place to a later one. From a terminal
    to itself there is no way to go. Pairs without a way are left out.

    Searches start from the edges that have terminals, not from terminals, so their number is bounded
    by the road graph. The pairs of a family are the result, so they are joined as such.
    """
    edges, turns, options = settle(edges.select("edge", "time", "length")), settle(turns.select("a", "b", "penalty")), settle(options)
    used = options.select("edge").distinct()
    zero = F.lit(0).cast(edges.schema["time"].dataType)
    starts = used.select(F.col("edge").alias("source"), F.col("edge").alias("node"), zero.alias("cost"), F.lit(0).cast(edges.schema["length"].dataType).alias("second"))
    tree = shortest_tree(turning(edges, turns), starts)
    # from the end of one edge to the start of another, which may be the same one
    onto = turns.join(used.withColumnRenamed("edge", "b"), "b", "left_semi")
    between = tree.join(onto, F.col("node") == F.col("a")).groupBy(F.col("source").alias("edge_i"), F.col("b").alias("edge_j")).agg(F.min(F.struct((F.col("cost") + F.col("penalty")).alias("time"), F.col("second").alias("length"))).alias("way"))
    placed = options.join(edges, "edge").select("family", "terminal", "option", "edge", "at", "link_time", "link_length", "time", "length")
    names = [c for c in placed.columns if c != "family"]
    left, right = (placed.select("family", *(F.col(c).alias(f"{c}_{s}") for c in names)) for s in "ij")
    pairs = settle(left.join(right, "family").where("terminal_i <> terminal_j"))

    def candidate(time: Column, length: Column) -> Column:
        return F.struct((F.col("link_time_i") + time + F.col("link_time_j")).alias("time"), (F.col("link_length_i") + length + F.col("link_length_j")).alias("length"), "option_i", "option_j").alias("way")

    key = ["family", "terminal_i", "terminal_j"]
    around = pairs.join(between, ["edge_i", "edge_j"]).select(*key, candidate(*((1 - F.col("at_i")) * F.col(f"{c}_i") + F.col(f"way.{c}") + F.col("at_j") * F.col(f"{c}_j") for c in ("time", "length"))))
    direct = pairs.where("edge_i = edge_j AND at_i <= at_j").select(*key, candidate(*((F.col("at_j") - F.col("at_i")) * F.col(f"{c}_i") for c in ("time", "length"))))
    best = around.union(direct).groupBy(*key).agg(F.min("way").alias("way"))
    own = options.groupBy("family", F.col("terminal").alias("terminal_i")).agg(F.min("option").alias("o"))
    kinds = best.schema["way"].dataType
    here = own.select("family", "terminal_i", F.col("terminal_i").alias("terminal_j"), F.struct(*(F.lit(0).cast(kinds[c].dataType).alias(c) for c in ("time", "length")), F.col("o").alias("option_i"), F.col("o").alias("option_j")).alias("way"))
    return best.union(here).select("family", F.col("terminal_i").alias("i"), F.col("terminal_j").alias("j"), "way.*")
