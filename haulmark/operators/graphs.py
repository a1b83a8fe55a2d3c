"""Graphs as tables of edges: components, shortest paths, line graphs, contraction.

Each round of a loop is one join and one aggregate over the frontier, kept in the shared checkpoint
folder. Recursive SQL isn't used: it allows neither distinct unions nor aggregates in Spark.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import forget, settle
from .windows import global_position


#: Rounds of paths after which what is known is compacted.
LOGGED = 8
#: Graphs of more edges than DENSE, and of more than twice LIGHT a node, settle over the LIGHT cheapest of a node first.
DENSE, LIGHT = 1 << 20, 8


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, component): the smallest node that links of (a, b) reach, either way.

    Large-star and small-star steps in turn, so the rounds grow with the logarithm of a
    component's diameter, and the edges never grow in number.
    """

    def mark(df: DataFrame) -> tuple:
        """The number of links and the sum of their hashes: alike twice in a row, no link has moved."""
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first())

    links = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    before = mark(links)
    for _ in range(rounds):
        both = links.union(links.select("lo", "hi"))
        least = both.groupBy("hi").agg(F.least(F.min("lo"), F.first("hi")).alias("m"))
        wide = both.where("lo > hi").join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        wide = wide.union(least.where("m < hi").select("hi", F.col("m").alias("lo"))).distinct()
        least = wide.groupBy("hi").agg(F.min("lo").alias("m"))
        close = wide.join(least, "hi").select(F.explode(F.array("hi", "lo")).alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        last, links = links, settle(close)
        now = mark(links)
        forget(last)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("lo").alias("node"), F.col("lo").alias("component"))
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots).distinct()


def _least(log: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, log).groupBy("source", "node").agg(F.min("cost").alias("cost"))


def _relaxed(edges: DataFrame, log: list[DataFrame], rounds: int, first: DataFrame | None = None) -> list[DataFrame]:
    """The log (source, node, cost) of rounds until no edge makes a node cheaper; the last round goes on first, over
    the edges `first` if they are given."""
    frontier = log[-1]
    for _ in range(rounds):
        along, first = edges if first is None else first, None
        reached = frontier.join(along, frontier.node == along.u).select("source", F.col("v").alias("node"), (F.col("cost") + F.col("w")).alias("cost"))
        reached = reached.groupBy("source", "node").agg(F.min("cost").alias("new"))
        known = reduce(DataFrame.union, log).join(reached.select("source", "node"), ["source", "node"], "left_semi")
        joined = reached.join(known.groupBy("source", "node").agg(F.min("cost").alias("cost")), ["source", "node"], "left")
        frontier = settle(joined.where(F.col("cost").isNull() | (F.col("new") < F.col("cost"))).select("source", "node", F.col("new").alias("cost")))
        if frontier.isEmpty():
            return log
        log = [*log, frontier]
        if len(log) > LOGGED:
            before, log = log, [settle(_least(log)), frontier]
            forget(*before[:-1])
    raise RuntimeError("costs did not settle")


def least_costs(edges: DataFrame, sources: DataFrame, rounds: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(source, node, cost) as of `shortest`, and the edges that least ways may go over: no other edge is on one.

    In a dense graph few edges are on least ways, so the LIGHT cheapest of a node on average settle first. They bound what
    a node costs from any source, and so which of the dearer edges can be of use: those whose own cost, after the least
    that their start may cost, isn't beyond the bound of their end, and all that lead to where a source hasn't been yet.
    """
    start = settle(sources.groupBy("source", "node").agg(F.min("cost").alias("cost")))
    count, nodes = edges.agg(F.count(F.lit(1)), F.approx_count_distinct("u")).first()
    if count <= DENSE or count <= 2 * LIGHT * nodes:
        return _least(_relaxed(edges, [start], rounds)), edges
    bound = edges.agg(F.percentile_approx("w", LIGHT * nodes / count)).first()[0]
    least, n = start.agg(F.min("cost"), F.count_distinct("source")).first()
    if bound is None or least is None:
        return _least(_relaxed(edges, [start], rounds)), edges
    light, heavy = settle(edges.where(F.col("w") <= bound)), edges.where((F.col("w") > bound) | F.col("w").isNull())
    log = _relaxed(light, [start], rounds)
    known = settle(_least(log))
    forget(*log)
    seen = known.groupBy("node").agg(F.min("cost").alias("low"), F.when(F.count("cost") == n, F.max("cost")).alias("cap"))
    # a way over a dearer edge costs more than `bound`, so no start gets cheaper than that by one
    low = F.least(F.coalesce("low", F.lit(least + bound)), F.lit(least + bound))
    ends = heavy.join(seen.select(F.col("node").alias("v"), "cap").where("cap IS NOT NULL"), "v", "left").where(F.col("cap").isNull() | (F.col("w") + least <= F.col("cap")))
    some = ends.join(seen.select(F.col("node").alias("u"), "low"), "u", "left").where(F.col("cap").isNull() | (F.col("w") + low <= F.col("cap")))
    some = settle(some.select(edges.columns))
    both = light.union(some)
    return _least(_relaxed(both, [known], rounds, some)), both


def shortest(edges: DataFrame, sources: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(source, node, cost): least cost from each source over edges (u, v, w), w >= 0; `sources` has (source, node, cost).

    Only nodes that became cheaper go on to the next round, and only they are written; what is known
    is a log of such rounds, which is compacted now and then. A round looks up what it has reached.
    """
    return least_costs(edges, sources, rounds)[0]


def reachable(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node) pairs that edges (u, v) lead to, the source itself included."""
    cost = shortest(edges.select("u", "v", F.lit(0.0).alias("w")), sources.select("source", F.col("source").alias("node"), F.lit(0.0).alias("cost")))
    return cost.select("source", "node")


def strong_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): the smallest node that reaches `node` and is reached by it.

    In a dense graph some edges, LIGHT a node on average, already tie most nodes together. What one round of colours
    finds in them becomes one node each, and all edges between different ones, of which few are left, then tell what
    else belongs together: what reaches and is reached by a part of a component is in it, so nothing is lost.
    """
    count, n = edges.count(), nodes.count()
    if count <= DENSE or count <= 2 * LIGHT * n:
        return _coloured(edges, nodes)
    some = edges.where(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 20)) < int(LIGHT * n / count * (1 << 20)))
    part = settle(_coloured(some, nodes, once=True))
    u, v = (part.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "uv")
    between = settle(edges.join(u, "u").join(v, "v").where("cu <> cv").select(F.col("cu").alias("u"), F.col("cv").alias("v")).distinct())
    whole = _coloured(between, part.select(F.col("component").alias("node")).distinct())
    return part.select("node", F.col("component").alias("part")).join(whole.withColumnRenamed("node", "part"), "part").select("node", "component")


def _coloured(edges: DataFrame, nodes: DataFrame, once: bool = False) -> DataFrame:
    """The components by colouring: the smallest colour is passed forward until it settles, then backward inside a
    colour; what the backward pass reaches is a component and goes, and the rest goes on, or stays apart if `once`.
    Only nodes whose colour has changed pass it on.
    """
    left, out, inside = settle(nodes.select("node")), None, None
    while not left.isEmpty():
        last, between = inside, edges if inside is None else inside
        inside = settle(between.join(left.withColumnRenamed("node", "u"), "u", "left_semi").join(left.withColumnRenamed("node", "v"), "v", "left_semi").select("u", "v").distinct())
        if last is not None:
            forget(last)
        colour = left.select("node", F.col("node").alias("c"))
        passed = inside.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("p"))
        while True:
            last, colour = colour, settle(colour.join(passed, "node", "left").select("node", F.least("c", F.coalesce("p", "c")).alias("c"), (F.coalesce("p", "c") < F.col("c")).alias("moved")))
            forget(last)
            moved = colour.where("moved")
            if moved.isEmpty():
                break
            passed = moved.join(inside, F.col("node") == F.col("u")).groupBy(F.col("v").alias("node")).agg(F.min("c").alias("p"))
        tagged = inside.join(colour.select(F.col("node").alias("u"), F.col("c").alias("cu")), "u").join(colour.select(F.col("node").alias("v"), F.col("c").alias("cv")), "v")
        back = settle(tagged.where("cu = cv").select("u", "v"))
        found = settle(colour.where("node = c").select("node", "c"))
        grown = found
        while True:
            more = settle(grown.join(back, F.col("node") == F.col("v")).select(F.col("u").alias("node"), "c").distinct().join(found, "node", "left_anti"))
            if more.isEmpty():
                break
            found, grown = settle(found.union(more)), more
        forget(back, colour)
        part = found.select("node", F.col("c").alias("component"))
        out = part if out is None else out.union(part)
        left = settle(left.join(found, "node", "left_anti"))
        if once:
            return out.union(left.select("node", F.col("node").alias("component")))
    return out if out is not None else nodes.select("node", F.col("node").alias("component")).limit(0)


def ranked(members: DataFrame, prefix: str) -> DataFrame:
    """`members` (node, component) with the component's size and label: by size down, then smallest node."""
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("least"))
    # a place in the whole order of components, which no task sorts alone, nor all those of one size
    placed = global_position(sizes, [F.desc("size"), F.asc("least")])
    named = placed.select("component", "size", F.format_string("%s%04d", F.lit(prefix), F.col("position") + 1).alias("label"))
    return members.join(named, "component")


def line_graph(edges: DataFrame, penalty: Column) -> DataFrame:
    """(a, b, w): from edge a to edge b that goes on where a ends; w is b's weight and the turn's penalty.

    edges: (edge, u, v, w, angle); `penalty` is in terms of a_angle and b_angle.
    """
    a = edges.select(F.col("edge").alias("a"), F.col("u").alias("a_u"), F.col("v").alias("at"), F.col("angle").alias("a_angle"))
    b = edges.select(F.col("edge").alias("b"), F.col("u").alias("at"), F.col("v").alias("b_v"), F.col("angle").alias("b_angle"), F.col("w").alias("b_w"))
    return a.join(b, "at").select("a", "b", (F.col("b_w") + penalty).alias("w"))


def contract(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b, w, n): the least weight and the number of edges (u, v, w) between different groups of (node, g)."""
    joined = edges.join(groups.select(F.col("node").alias("u"), F.col("g").alias("a")), "u").join(groups.select(F.col("node").alias("v"), F.col("g").alias("b")), "v")
    return joined.where("a <> b").groupBy("a", "b").agg(F.min("w").alias("w"), F.count(F.lit(1)).alias("n"))


def chains(nexts: DataFrame, starts: DataFrame, rounds: int = 1000) -> DataFrame:
    """(start, step, node): the nodes that following (node, next) leads through from each start, which is step 0.

    A chain that goes on after so many rounds, as one in a circle does, is an error.
    """
    now = settle(starts.select(F.col("node").alias("start"), F.lit(0).cast("bigint").alias("step"), "node"))
    parts = [now]
    for _ in range(rounds):
        now = settle(now.join(nexts, "node").select("start", (F.col("step") + 1).alias("step"), F.col("next").alias("node")))
        if now.isEmpty():
            break
        parts.append(now)
    else:
        raise RuntimeError(f"chains go on after {rounds} steps")
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
