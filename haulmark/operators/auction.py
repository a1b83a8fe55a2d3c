"""Assignments to cells with quotas at least cost, as rounds of bids and prices in tables, and regions that
take in more communities while they compete for the same ids and lose.

A cell that lacks ids bids for as many as it lacks, those of the least cost and price, each up to what
the next one would cost it and one unit more. An id goes to the highest bid and is never free again. So
what a cell holds is within a unit of the best that it could have at these prices, and when all cells
have their quotas the sum is within a unit for each id of the least one. Bids are picked by their places
in one order of all options, so a cell may have any share of them.

Ids that know the same cells at the same whole costs are alike, so a group is decided by how many ids
there are of each profile, however many ids it has: with few profiles the least cost is found by cheapest
ways between its cells, and ids are dealt to it by their places in one order. Rounds of bids are for
groups whose profiles come to more than ENTRIES.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.functions import hashing

from . import windows
from .lineage import forget, settle

CELL = ["group", "cell"]
#: What a cell without an alternative adds to its bid, in units: more than prices come to otherwise.
WALL = 1 << 40
#: What profiles of a group may come to (profiles by the cells that they know) without rounds of bids.
ENTRIES = 1 << 13
#: What a group's communities, links and quotas may come to, times its regions, for its regions to grow in one task.
TOWN = 1 << 18


def _lot(*parts: str) -> Column:
    return hashing.stable_long(*(F.to_json(F.struct(c)) for c in parts))


def _round(options: DataFrame, needs: DataFrame, held: DataFrame) -> DataFrame | None:
    """`held` (group, id, cell, price) after one round of bids, None if no cell can bid. needs: (group, cell, need, bound);
    what costs `bound` or more isn't asked for."""
    asked = options.join(needs, CELL).join(held.select("group", "id", F.col("cell").alias("holder"), "price"), ["group", "id"], "left")
    net = F.col("cost") + F.coalesce("price", F.lit(0))
    open_ = asked.where(F.col("holder").isNull() | (F.col("holder") != F.col("cell"))).withColumn("net", net).where(F.col("bound").isNull() | (F.col("net") < F.col("bound")))
    # of equal options each cell takes others first
    open_ = open_.select(*CELL, "id", "cost", "net", "need", "bound", _lot("cell", "id").alias("lot"))
    placed = windows.global_position(open_, [*CELL, "net", "lot", "id"])
    first = placed.groupBy(*CELL).agg(F.min("position").alias("first"), F.max("net").alias("most"))
    placed = placed.join(first, CELL).withColumn("place", F.col("position") - F.col("first"))
    level = placed.where("place = need").select(*CELL, F.col("net").alias("level"))
    upto = F.coalesce("level", "bound", F.col("most") + WALL) + 1
    bids = placed.where("place < need").join(level, CELL, "left").withColumn("price", upto - F.col("cost"))
    won = settle(bids.groupBy("group", "id").agg(F.max(F.struct("price", "lot", "cell")).alias("x")).select("group", "id", "x.cell", "x.price"))
    if won.isEmpty():
        return None
    after = settle(held.join(won, ["group", "id"], "left_anti").unionByName(won))
    forget(won)
    return after


def _lacking(quotas: DataFrame, held: DataFrame) -> DataFrame:
    """`quotas` with `need`, where it isn't met."""
    got = held.groupBy(*CELL).agg(F.count(F.lit(1)).alias("got"))
    return quotas.join(got, CELL, "left").withColumn("need", F.col("quota") - F.coalesce("got", F.lit(0))).where("need > 0").drop("got")


def _auction(options: DataFrame, quotas: DataFrame, held: DataFrame) -> DataFrame:
    """`held` when every cell of `quotas` (group, cell, quota, bound) has its quota or nothing within reach."""
    while (after := _round(options, _lacking(quotas, held).drop("quota"), held)) is not None:
        forget(held)
        held = after
    return held


def _ways(options: DataFrame, held: DataFrame) -> DataFrame:
    """(group, cell, steps) of the cells from which ids can be passed on to a free one, and over how many others."""
    held = held.select("group", "id", F.col("cell").alias("holder"))
    front = reach = settle(options.join(held, ["group", "id"], "left_anti").select(*CELL).distinct().withColumn("steps", F.lit(0).cast("bigint")))
    taken = settle(options.join(held, ["group", "id"]).where("cell <> holder").select("group", "cell", "holder").distinct())  # pairs of cells
    while not front.isEmpty():
        next_ = taken.join(front.select("group", F.col("cell").alias("holder"), (F.col("steps") + 1).alias("steps")), ["group", "holder"]).select(*CELL, "steps").distinct()
        front = settle(next_.join(reach, CELL, "left_anti"))
        reach = settle(reach.union(front))
    forget(taken)
    return reach


def filled(options: DataFrame, quotas: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """(group, id, cell): ids to the cells that know them, as many as quotas and options allow.

    Here an id's price is how far its cell is from a free one, worked out anew in every round: cells from
    which none can be reached bid no more, and when those that lack ids are all such, no assignment
    has more. `held` is where to go on from.
    """
    options = settle(options.select(*CELL, "id", F.lit(0).cast("bigint").alias("cost")).distinct())
    held = settle((options.limit(0) if held is None else held).select("group", "id", "cell"))
    while True:
        ways = _ways(options, held)
        needs = settle(_lacking(quotas, held).join(ways, CELL).select(*CELL, "need", (F.col("steps") + 1).alias("bound")))
        if needs.isEmpty():
            break
        priced = held.join(ways, CELL, "left").select("group", "id", "cell", F.coalesce(F.col("steps") + 1, F.lit(WALL)).alias("price"))
        before, held = held, settle(_round(options, needs, priced).select("group", "id", "cell"))
        forget(before, ways, needs)
    forget(options, ways, needs)
    return held


FLOW = "takes array<array<struct<at: int, start: bigint, stop: bigint>>>, got array<bigint>, rival array<boolean>"


def _flow(quotas: list[int], sizes: list[int], at: list[list[int]], costs: list[list[int]]) -> tuple:
    """Of each profile (so many ids of `sizes`, which know the cells `at` for `costs`) how many go to which cell, what cells
    get, and which cells alternating ways from those that lack ids reach. Cheapest ways first, each taken by all it has room for."""
    cells, n = len(quotas), len(sizes)
    cost = np.full((n, cells), np.inf)
    for i in range(n):
        cost[i, at[i]] = costs[i]
    need, free, held = np.array(quotas, np.int64), np.array(sizes, np.int64), np.zeros((n, cells), np.int64)
    while n:
        # the least cost of an id that is free for a cell, or that another one passes on
        start = np.where((free > 0)[:, None], cost, np.inf)
        first, far, back = start.argmin(0), start.min(0), np.full(cells, -1)
        via = np.zeros((cells, cells), np.int64)
        passed = np.full((cells, cells), np.inf)
        for c in range(cells):
            own = np.flatnonzero(held[:, c] > 0)
            if len(own):
                change = cost[own] - cost[own, c][:, None]
                via[c], passed[c] = own[change.argmin(0)], change.min(0)
                passed[c, c] = np.inf
        for _ in range(cells):
            through = far[:, None] + passed
            better = through.min(0) < far
            if not better.any():
                break
            back[better], far = through.argmin(0)[better], np.minimum(far, through.min(0))
        far = np.where(need > 0, far, np.inf)
        end = int(far.argmin())
        if far[end] == np.inf:
            break
        way = [end]
        while back[way[-1]] >= 0:
            way.append(int(back[way[-1]]))
        begin = first[way[-1]]
        steps = [(via[b, a], b, a) for a, b in zip(way, way[1:], strict=False)]
        room = min(need[end], free[begin], *(held[i, b] for i, b, _ in steps))
        need[end] -= room
        free[begin] -= room
        held[begin, way[-1]] += room
        for i, b, a in steps:
            held[i, b] -= room
            held[i, a] += room
    reach = need > 0
    while True:
        wanted = np.isfinite(cost[:, reach]).any(1)
        more = reach | (held[wanted] > 0).any(0)
        if (more == reach).all():
            break
        reach = more
    takes = []
    for row in held:
        stop = np.cumsum(row)
        takes.append([(c, int(stop[c] - row[c]), int(stop[c])) for c in np.flatnonzero(row).tolist()])
    return takes, [int(q - x) for q, x in zip(quotas, need, strict=True)], reach.tolist()


def _profiles(ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profiles (group, knows, n) of ids (group, id, n, knows: array<struct<cell, cost>>), and the groups that have too many."""
    profiles = settle(ids.groupBy("group", "knows").agg(F.sum("n").alias("n")))
    return profiles, settle(profiles.groupBy("group").agg(F.sum(F.size("knows")).alias("entries")).where(F.col("entries") > ENTRIES).select("group"))


def _solved(profiles: DataFrame, quotas: DataFrame) -> DataFrame:
    """(group, cells, items, x): `_flow` of each group of `quotas`; the cells of profiles have to be among its cells."""
    cells = quotas.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("cell", "quota"))).alias("cells"))
    items = profiles.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("knows", "n"))).alias("items"))
    both = cells.join(items, "group", "left").withColumn("items", F.coalesce("items", F.array().cast(items.schema["items"].dataType)))
    at = F.transform("items", lambda i: F.transform(i["knows"], lambda k: (F.array_position(F.col("cells")["cell"], k["cell"]) - 1).cast("int")))
    x = F.udf(_flow, FLOW)(F.col("cells")["quota"], F.col("items")["n"], at, F.transform("items", lambda i: i["knows"]["cost"]))
    return settle(both.withColumn("x", x))


def _got(solved: DataFrame) -> DataFrame:
    """(group, cell, got, rival) of `_solved`."""
    each = solved.select("group", F.explode(F.arrays_zip(F.col("cells")["cell"].alias("cell"), F.col("x.got").alias("got"), F.col("x.rival").alias("rival"))).alias("y"))
    return each.select("group", "y.cell", "y.got", "y.rival")


def _dealt(ids: DataFrame, solved: DataFrame) -> DataFrame:
    """(group, cell, id) of ids (group, id, knows), as many of each profile as `_solved` says."""
    placed = windows.global_position(ids.select("group", "knows", "id"), ["group", "knows", "id"])
    first = placed.groupBy("group", "knows").agg(F.min("position").alias("first"))
    each = solved.select("group", "cells", F.explode(F.arrays_zip(F.col("items")["knows"].alias("knows"), F.col("x.takes").alias("takes"))).alias("y"))
    takes = each.select("group", "cells", "y.knows", F.explode("y.takes").alias("t")).select("group", "knows", F.get("cells", F.col("t.at"))["cell"].alias("cell"), "t.start", "t.stop")
    bounds = settle(takes.join(first, ["group", "knows"]))
    place = F.col("position") - F.col("first")
    return placed.join(bounds, ["group", "knows"]).where((place >= F.col("start")) & (place < F.col("stop"))).select("group", "cell", "id")


def auctioned(options: DataFrame, quotas: DataFrame, unit: float) -> tuple[DataFrame, DataFrame]:
    """(group, cell, id, cost): each id once, no cell over its quota, as many as can be; and what cells lack (group, cell, deficit).

    options: (group, cell, id, cost); quotas: (group, cell, quota). Costs count in whole units, and the sum is within two
    units for each id of the least one of all assignments with as many ids in each cell: smaller units are more
    exact and take more rounds. Of repeated options the least costs; nulls and quotas of nothing give nothing.
    """
    quotas = settle(quotas.dropna().where("quota > 0").groupBy(*CELL).agg(F.sum("quota").alias("quota")))
    own = settle(options.dropna().groupBy(*CELL, "id").agg(F.min("cost").alias("cost")).join(quotas.select(*CELL), CELL))
    whole = settle(own.withColumn("cost", F.round(F.col("cost") / unit).cast("bigint")))
    ids = settle(whole.groupBy("group", "id").agg(F.array_sort(F.collect_list(F.struct("cell", "cost"))).alias("knows")))
    profiles, many = _profiles(ids.withColumn("n", F.lit(1)))
    here = lambda df: df.join(many, "group", "left_anti")
    solved = _solved(here(profiles), here(quotas))
    held = _dealt(here(ids), solved)
    lacks = quotas.join(_got(solved), CELL).select(*CELL, (F.col("quota") - F.col("got")).alias("deficit")).where("deficit > 0")
    if not many.isEmpty():
        more, lacking = _by_bids(*(df.join(many, "group", "left_semi") for df in (whole, quotas)))
        held, lacks = held.union(more), lacks.union(lacking)
    held, lacks = settle(held), settle(lacks)
    forget(whole, ids, profiles, solved, quotas)
    return held.join(own, [*CELL, "id"]), lacks


def _by_bids(whole: DataFrame, quotas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(group, cell, id) by rounds of bids, and what is lacking."""
    most = filled(whole, quotas)
    lacks = settle(_lacking(quotas, most).select(*CELL, F.col("need").alias("deficit")))
    can = settle(most.groupBy(*CELL).agg(F.count(F.lit(1)).alias("quota"), F.lit(None).cast("bigint").alias("bound")))
    open_ = settle(whole.join(can.select(*CELL), CELL).select(*whole.columns))
    start = settle(open_.limit(0).select("group", "id", "cell", F.lit(0).cast("bigint").alias("price")))
    held = _auction(open_, can, start)
    forget(open_, can)
    return held.select(*CELL, "id"), lacks


def _rivals(options: DataFrame, held: DataFrame, short: DataFrame) -> DataFrame:
    """The cells that alternating ways from `short` ones reach: those that hold what they want, and so on."""
    reach = front = settle(short.select(*CELL))
    holders = held.select("group", "id", F.col("cell").alias("holder"))
    while True:
        next_ = options.join(front, CELL).join(holders, ["group", "id"]).select("group", F.col("holder").alias("cell")).distinct()
        front = settle(next_.join(reach, CELL, "left_anti"))
        if front.isEmpty():
            return reach
        reach = settle(reach.union(front))


def _grown(quotas: list, census: list, members: list, links: list, lots: list) -> tuple[list, list]:
    """The rounds of `contested` for one group: (region, id, step) taken in, and what each (region, decile, quota) got."""
    room, near, far, lives, lot = {}, {}, {}, {}, {(x["region"], x["id"]): x["lot"] for x in lots}
    for q in sorted(quotas, key=lambda q: q["region"]):
        room.setdefault(q["decile"], []).append((q["region"], q["quota"]))
    for c in census:
        lives.setdefault(c["decile"], {})[c["id"]] = c["n"]
    for x in links:
        far.setdefault(x["u"], []).append((x["v"], x["w"]))
    own = {}

    def take(region: object, one: object) -> None:
        own.setdefault(region, set()).add(one)
        ways = near.setdefault(region, {})
        for v, w in far.get(one, ()):
            ways[v] = min(w, ways.get(v, w))

    for m in members:
        take(m["region"], m["id"])
    more, step = [], 0
    while True:
        step += 1
        told, grow, open_ = [], [], False
        for decile, cells in room.items():
            sizes: dict[tuple, int] = {}
            for one, n in lives.get(decile, {}).items():
                if at := tuple(i for i, (region, _) in enumerate(cells) if one in own.get(region, ())):
                    sizes[at] = sizes.get(at, 0) + n
            _, got, rival = _flow([q for _, q in cells], list(sizes.values()), [list(at) for at in sizes], [[0] * len(at) for at in sizes])
            told += [(region, decile, quota, x) for (region, quota), x in zip(cells, got, strict=True)]
            open_ |= any(x < quota for (_, quota), x in zip(cells, got, strict=True))
            grow += [(region, decile) for (region, _), r in zip(cells, rival, strict=True) if r]
        asked = set()
        for region, decile in grow:
            here = lives.get(decile, {})
            options = [(v not in here, w, lot[region, v], v) for v, w in near.get(region, {}).items() if v not in own[region]]
            if options:
                asked.add((region, min(options)[3]))
        if not open_ or not asked:
            return more, told
        for region, one in sorted(asked):
            take(region, one)
            more.append((region, one, step))


def _grown_here(census: DataFrame, members: DataFrame, links: DataFrame, quotas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`_grown` by group, each on how many residents of each decile its communities have: what is taken in, and what is told."""
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((members, "region"), (members, "id"), (census, "decile"))}
    taken = f"more array<struct<region: {kinds['region']}, id: {kinds['id']}, step: int>>, told array<struct<region: {kinds['region']}, decile: {kinds['decile']}, quota: bigint, got: bigint>>"
    regions, places = quotas.select("group", "region").distinct(), links.select("group", F.col("v").alias("id")).distinct()
    lots = regions.join(places, "group").select("group", "region", "id", _lot("region", "id").alias("lot"))
    rows = quotas.groupBy("group").agg(F.collect_list(F.struct("region", "decile", "quota")).alias("quotas"))
    for name, df in (("census", census), ("members", members), ("links", links), ("lots", lots)):
        each = df.groupBy("group").agg(F.collect_list(F.struct(*(c for c in df.columns if c != "group"))).alias(name))
        rows = rows.join(each, "group", "left").withColumn(name, F.coalesce(name, F.array().cast(each.schema[name].dataType)))
    told = settle(rows.select("group", F.udf(_grown, taken)("quotas", "census", "members", "links", "lots").alias("x")))
    return tuple(told.select("group", F.explode(f"x.{c}").alias("y")).select("group", "y.*") for c in ("more", "told"))


def _grown_in_rounds(residents: DataFrame, census: DataFrame, members: DataFrame, links: DataFrame, quotas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for groups of any number of communities, as rounds of joins: all members, and what is told."""
    group, cell = F.struct("group", "decile").alias("group"), F.col("region").alias("cell")
    wanted, quotas = quotas.select("group", "decile", "region"), settle(quotas.select(group, cell, "quota"))
    known = lambda of: members.select("group", "region", "id").join(wanted, ["group", "region"]).join(of, ["group", "id", "decile"])
    held, step = None, 0
    while True:
        step += 1
        own = known(census).select(group, cell, "id", "n").groupBy("group", "id").agg(F.array_sort(F.collect_set(F.struct("cell", F.lit(0).cast("bigint").alias("cost")))).alias("knows"), F.first("n").alias("n"))
        profiles, many = _profiles(own)
        solved = _solved(profiles.join(many, "group", "left_anti"), quotas.join(many, "group", "left_anti"))
        told = quotas.join(_got(solved), CELL)
        if not many.isEmpty():
            options = settle(known(residents).select(group, cell, F.col("who").alias("id")).join(many, "group", "left_semi"))
            large = quotas.join(many, "group", "left_semi")
            # what is held stays held, at no price: more options never take away from what can be filled
            held = settle(filled(options, large, held))
            rivals = _rivals(options, held, settle(_lacking(large, held))).withColumn("rival", F.lit(True))
            counts = held.groupBy(*CELL).agg(F.count(F.lit(1)).alias("got"))
            told = told.union(large.join(counts, CELL, "left").join(rivals, CELL, "left").select(*CELL, "quota", F.coalesce("got", F.lit(0)), F.coalesce("rival", F.lit(False))))
            forget(options)
        told = settle(told)
        forget(profiles, solved)
        short = settle(told.where("got < quota").select(*CELL, (F.col("quota") - F.col("got")).alias("need")))
        if short.isEmpty():
            break
        grow = settle(told.where("rival").select("group.group", "group.decile", F.col("cell").alias("region")))
        near = members.join(grow.select("group", "region").distinct(), ["group", "region"]).join(links.withColumnRenamed("u", "id"), ["group", "id"])
        near = near.groupBy("group", "region", F.col("v").alias("id")).agg(F.min("w").alias("w")).join(members, ["group", "region", "id"], "left_anti")
        lives = residents.select("group", "id", "decile", F.lit(True).alias("lives")).distinct()
        asked = near.join(grow, ["group", "region"]).join(lives, ["group", "id", "decile"], "left")
        best = asked.groupBy("group", "region", "decile").agg(F.min_by("id", F.struct(F.col("lives").isNull(), "w", _lot("region", "id"), "id")).alias("id"))
        more = settle(best.select("group", "region", "id").distinct().withColumn("step", F.lit(step)))
        if more.isEmpty():
            break
        before, members = members, settle(members.union(more))
        forget(before, more, grow)
    return members, told.select("group.group", F.col("cell").alias("region"), "group.decile", "quota", "got")


def contested(residents: DataFrame, members: DataFrame, links: DataFrame, quotas: DataFrame, cost: Column, unit: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Residents of regions' communities assigned to the regions' quotas by decile, each to one region at most. Regions share
    communities; where that leaves a quota open, those that lack and all whose residents they want take
    in a neighbour for each such decile (the nearest with residents of it, or else the nearest), until all
    quotas are met or none of them has a neighbour left.

    residents: (group, id, decile, who, ...); members: (group, region, id); links: (group, u, v, w), both ways; quotas: (group,
    region, decile, quota); cost: of a resident for a region, by their columns. Gives (group, region, decile, who, cost),
    the members (group, region, id, step; step 0 for those given) and what is lacking (group, region, decile, deficit).
    """
    # a resident has one decile, so each decile's regions are a group of their own
    group, cell = F.struct("group", "decile").alias("group"), F.col("region").alias("cell")
    quotas = settle(quotas.where("quota > 0").select("group", "region", "decile", F.col("quota").cast("bigint").alias("quota")))
    residents = settle(residents)
    members = settle(members.select("group", "region", "id", F.lit(0).alias("step")))
    # what is filled and who competes is told by how many residents of each decile a community has
    census = settle(residents.groupBy("group", "id", "decile").agg(F.count(F.lit(1)).alias("n")))
    links = settle(links.select("group", "u", "v", "w"))
    size = lambda df: df.groupBy("group").agg(F.count(F.lit(1)).alias("k"))
    sizes = reduce(DataFrame.union, map(size, (census, links, members, quotas))).groupBy("group").agg(F.sum("k").alias("k"))
    regions = size(quotas.select("group", "region").distinct()).withColumnRenamed("k", "r")
    many = settle(sizes.join(regions, "group").where(F.col("k") * F.col("r") > TOWN).select("group"))
    more, told = _grown_here(*(df.join(many, "group", "left_anti") for df in (census, members.drop("step"), links, quotas)))
    areas = members.union(more.select(*members.columns))
    if not many.isEmpty():
        large, more = _grown_in_rounds(*(df.join(many, "group", "left_semi") for df in (residents, census, members, links, quotas)))
        areas, told = areas.join(many, "group", "left_anti").union(large), told.union(more.select(*told.columns))
    members, told = settle(areas), settle(told)
    own = members.select("group", "region", "id").join(told.select("group", "region", "decile"), ["group", "region"]).join(residents, ["group", "id", "decile"])
    options = own.select(group, cell, F.col("who").alias("id"), cost.cast("double").alias("cost"))
    pairs, _ = auctioned(options, told.select(group, cell, F.col("got").alias("quota")), unit)
    short = told.where("got < quota").select("group", "region", "decile", (F.col("quota") - F.col("got")).alias("deficit"))
    return pairs.select("group.group", F.col("cell").alias("region"), "group.decile", F.col("id").alias("who"), "cost"), members, short
