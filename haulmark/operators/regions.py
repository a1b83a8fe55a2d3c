"""Regions over a graph of communities: seeds and growth for all groups at once, in rounds of joins.

A region has a quota for each decile, and a community has room in some deciles. Each round every region
ranks what it could take by one key, in an aggregate; nothing is searched in a task of its own, so a
group may have any number of communities. Communities may belong to several regions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.functions import hashing

from . import graphs
from .lineage import forget, settle

KEY = ["group", "region"]


def _lot(*parts: str) -> Column:
    return hashing.stable_long(*map(F.col, parts))


def seeds(cells: DataFrame, links: DataFrame, quotas: DataFrame) -> DataFrame:
    """(group, region, id): a community for each region, no two alike.

    Regions without a seed ask for the community with the most room towards their quotas that isn't
    beside a seed already, or else for one that is; a community that several ask for goes to the region
    of the largest quota. Those turned down ask again. Regions are left over when communities are.

    cells: (group, id, decile, capacity); links: (group, u, v), both ways; quotas: (group, region, decile, quota).
    """
    useful = cells.join(quotas, ["group", "decile"]).groupBy(*KEY, "id").agg(F.sum(F.least("capacity", "quota")).alias("fit"))
    sizes = quotas.groupBy(*KEY).agg(F.sum("quota").alias("size"))
    # a region that no community has room for takes any
    every = sizes.join(cells.select("group", "id").distinct(), "group").join(useful, [*KEY, "id"], "left")
    asks = settle(every.select(*KEY, "size", "id", F.coalesce("fit", F.lit(0)).alias("fit")))
    chosen = settle(asks.limit(0).select(*KEY, "id"))
    while True:
        beside = links.join(chosen.select("group", F.col("id").alias("u")), ["group", "u"]).select("group", F.col("v").alias("id")).distinct().withColumn("beside", F.lit(True))
        open_ = asks.join(chosen, KEY, "left_anti").join(chosen, ["group", "id"], "left_anti").join(beside, ["group", "id"], "left")
        wish = open_.groupBy(*KEY, "size").agg(F.min_by("id", F.struct(F.col("beside").isNotNull(), -F.col("fit"), _lot("region", "id"), "id")).alias("id"))
        given = settle(wish.groupBy("group", "id").agg(F.min_by("region", F.struct(-F.col("size"), _lot("region"), "region")).alias("region")))
        if given.isEmpty():
            return chosen
        before, chosen = chosen, settle(chosen.union(given.select(*KEY, "id")))
        forget(before, given)


def grown(cells: DataFrame, links: DataFrame, quotas: DataFrame, starts: DataFrame) -> DataFrame:
    """(group, region, id, step): `starts` (step 0) and what each region takes in until its communities have room for
    all its quotas, or no neighbour is left.

    A region whose quotas nothing that it can reach would cover takes all of that in its first round. In the others each decile that lacks room asks for the neighbour that gives it any over the shortest
    link (w), or else for the nearest one, through which others may be reached.
    """
    members = settle(starts.select(*KEY, "id", F.lit(0).alias("step")))
    # where all that can be reached has too little room, a region ends up with all of it
    node = lambda c: F.struct("group", F.col(c).alias("id"))
    parts = graphs.components(links.select(node("u").alias("a"), node("v").alias("b"))).select("node.group", "node.id", "component")
    room = cells.join(parts, ["group", "id"]).groupBy("group", "component", "decile").agg(F.sum("capacity").alias("room"))
    wanted = quotas.join(members, KEY).join(parts, ["group", "id"]).join(room, ["group", "component", "decile"], "left")
    short = wanted.where(F.col("quota") > F.coalesce("room", F.lit(0))).select(*KEY, "component").distinct()
    rest = short.join(parts, ["group", "component"]).select(*KEY, "id").join(members, [*KEY, "id"], "left_anti")
    members = settle(members.union(rest.withColumn("step", F.lit(1))))
    step = 1
    while True:
        step += 1
        lacking = lacks(cells, quotas, members)
        near = members.join(links, (members.group == links.group) & (members.id == links.u)).select(members.group, "region", F.col("v").alias("id"), "w")
        near = near.groupBy(*KEY, "id").agg(F.min("w").alias("w")).join(members, [*KEY, "id"], "left_anti")
        asked = near.join(lacking, KEY).join(cells, ["group", "id", "decile"], "left")
        best = asked.groupBy(*KEY, "decile").agg(F.min_by("id", F.struct(F.coalesce("capacity", F.lit(0)) == 0, "w", _lot("region", "id"), "id")).alias("id"))
        more = settle(best.select(*KEY, "id").distinct().withColumn("step", F.lit(step)))
        if more.isEmpty():
            return members
        before, members = members, settle(members.union(more))
        forget(before, more)


def lacks(cells: DataFrame, quotas: DataFrame, members: DataFrame) -> DataFrame:
    """(group, region, decile, deficit) of the quotas that the members' room doesn't cover."""
    room = members.join(cells, ["group", "id"]).groupBy(*KEY, "decile").agg(F.sum("capacity").alias("room"))
    short = quotas.join(room, [*KEY, "decile"], "left").withColumn("deficit", F.col("quota") - F.coalesce("room", F.lit(0)))
    return short.where("deficit > 0").select(*KEY, "decile", "deficit")


def graph_regions(cells: DataFrame, edges: DataFrame, quotas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(group, region, id, step) and the deficits (group, region, decile, deficit) that are left when no neighbour is.

    edges: (group, u, v, w), one way each; regions grow over them either way. A region that finds no seed
    has no communities and lacks all of its quotas.
    """
    cells = settle(cells.groupBy("group", "id", "decile").agg(F.sum("capacity").alias("capacity")).where("capacity > 0"))
    both = edges.select("group", "u", "v", "w").union(edges.select("group", "v", "u", "w")).where("u <> v")
    links = settle(both.groupBy("group", "u", "v").agg(F.min("w").alias("w")))
    quotas = settle(quotas.groupBy(*KEY, "decile").agg(F.sum("quota").alias("quota")).where("quota > 0"))
    members = grown(cells, links, quotas, seeds(cells, links, quotas))
    return members, lacks(cells, quotas, members)


