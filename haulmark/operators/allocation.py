"""Exact allocation: rounding to totals and margins, quotas, seeds, nested and balanced splits.

Rounding and quotas are windows. What is a search over one bounded group (a city's communities) runs in
that group's task, by `applyInPandas`; groups are independent, so Spark
spreads them, and none grows with the number of groups.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from haulmark.functions import hashing

from . import windows
from .lineage import settle


def largest_remainder(df: DataFrame, keys: list[str], share: str, total: str, label: str) -> DataFrame:
    """`df` with `count`: shares scaled to a key's whole `total`, floors first, the rest to the largest
    fractions (ties by hash, then label). Totals are met exactly."""
    every = W.partitionBy(*keys)
    exact = F.col(share) / F.sum(share).over(every) * F.col(total)
    rows = df.withColumn("_exact", F.round(exact, 9)).withColumn("_floor", F.floor("_exact").cast("bigint"))
    rows = rows.withColumn("_short", F.col(total) - F.sum("_floor").over(every))
    order = every.orderBy(F.desc(F.round(F.col("_exact") - F.col("_floor"), 9)), hashing.stable_long(F.col(label)), F.col(label))
    rows = rows.withColumn("_n", F.row_number().over(order))
    return rows.withColumn("count", F.col("_floor") + (F.col("_n") <= F.col("_short")).cast("bigint")).drop("_exact", "_floor", "_short", "_n")


def rounded_margins(cells: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The whole numbers with exactly these row and column sums (of one total) that are nearest to `cells`
    in the sum of absolute differences.

    Cells start at their floors; a cell with a fraction f can take one unit, at a cost of 1 - 2 f. What
    rows and columns miss goes along cheapest augmenting paths, a unit at a time, which gives a flow
    of least cost. Where the margins ask for more than the fractions can take, the rest goes to whole cells.
    """
    given = np.floor(cells + 1e-9)
    fraction = cells - given
    order = np.arange(cells.size).reshape(cells.shape) * 1e-12  # of equal costs the first cells
    cost = np.where(fraction > 1e-9, np.round(1 - 2 * fraction, 9), np.inf) + order
    taken = np.zeros(cells.shape, bool)
    row_need, column_need = rows - given.sum(1), columns - given.sum(0)
    while row_need.sum() > 0.5:
        near_row = np.where(row_need > 0, 0.0, np.inf)  # cost of the cheapest way to each row and column
        near_column, from_row, from_column = np.full(len(columns), np.inf), {}, {}
        for _ in range(len(rows) + len(columns)):
            ways = np.where(taken, np.inf, near_row[:, None] + cost)
            best = ways.min(0)
            closer = np.flatnonzero(best < near_column - 1e-15)
            near_column[closer] = best[closer]
            from_row.update(zip(closer.tolist(), ways.argmin(0)[closer].tolist(), strict=True))
            ways = np.where(taken, near_column[None, :] - np.where(taken, cost, 0), np.inf)
            best = ways.min(1)
            closer = np.flatnonzero(best < near_row - 1e-15)
            near_row[closer] = best[closer]
            from_column.update(zip(closer.tolist(), ways.argmin(1)[closer].tolist(), strict=True))
            if not len(closer):
                break
        ends = np.where(column_need > 0, near_column, np.inf)
        c = int(ends.argmin())
        if ends[c] == np.inf:  # no cell with a fraction is left on any way
            r, c = int(row_need.argmax()), int(column_need.argmax())
            given[r, c] += 1
            row_need[r] -= 1
            column_need[c] -= 1
            continue
        column_need[c] -= 1
        while True:
            r = from_row[c]
            taken[r, c] = True
            if r not in from_column:
                break
            c = from_column[r]
            taken[r, c] = False
        row_need[r] -= 1
    return (given + taken).astype(np.int64)


def controlled_rounding(df: DataFrame, group: str, row: str, column: str, share: str) -> DataFrame:
    """(group, row, column, share, count): a group's table scaled to whole margins and rounded so that row
    and column sums are exact. Margins are the largest-remainder rounding of the shares' sums."""

    def whole(x: np.ndarray, total: int) -> np.ndarray:
        out = np.floor(x + 1e-9)
        for k in np.argsort(-(x - out), kind="stable")[: int(total - out.sum())]:
            out[k] += 1
        return out

    def per_group(rows: pd.DataFrame) -> pd.DataFrame:
        cells = rows.pivot_table(index=row, columns=column, values=share, aggfunc="sum", fill_value=0.0).sort_index().sort_index(axis=1)
        x = cells.to_numpy(float)
        total = int(round(x.sum()))
        up, across = whole(x.sum(1) * (total / max(x.sum(), 1e-12)), total), whole(x.sum(0) * (total / max(x.sum(), 1e-12)), total)
        fitted = np.where(x > 0, x, 1e-6)
        for _ in range(500):  # iterative proportional fitting to the whole margins
            fitted *= (up / np.maximum(fitted.sum(1), 1e-12))[:, None]
            fitted *= across / np.maximum(fitted.sum(0), 1e-12)
            if np.abs(fitted.sum(1) - up).max() < 1e-10:
                break
        found = rounded_margins(fitted, up, across)
        out = cells.stack().rename("share").reset_index()
        out["count"] = found.ravel()
        out.insert(0, group, rows[group].iloc[0])
        out.columns = [group, row, column, "share", "count"]
        return out

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.groupBy(group).applyInPandas(per_group, f"{group} {kinds[group]}, {row} {kinds[row]}, {column} {kinds[column]}, share double, count long")


def farthest_seeds(df: DataFrame, group: str, n: int) -> DataFrame:
    """(group, rank, id): points spread by farthest-first choice in each group of (id, x, y); the first is
    that of the least hash, ties go to the smaller id. Ids are numbers.

    Each rank is one aggregate over all points beside the few seeds chosen so far, so a group may have
    any number of points.
    """
    rows = df.select(group, "id", "x", "y")
    one = F.struct("id", "x", "y")
    first = rows.groupBy(group).agg(F.min_by(one, F.struct(hashing.stable_long(F.col("id")), "id")).alias("p"))
    chosen = settle(first.select(group, F.lit(1).cast("bigint").alias("rank"), "p.*"))
    few = chosen.count() * n <= 1 << 18
    for rank in range(2, n + 1):
        seeds = chosen.groupBy(group).agg(F.collect_list(one).alias("seeds"))  # n at most in each
        beside = rows.join(seeds.hint("broadcast") if few else seeds, group).where(~F.exists("seeds", lambda s: s["id"] == F.col("id")))
        far = F.array_min(F.transform("seeds", lambda s: F.hypot(F.col("x") - s["x"], F.col("y") - s["y"])))
        best = beside.groupBy(group).agg(F.max_by(one, F.struct(far, -F.col("id"))).alias("p"))
        chosen = settle(chosen.union(best.select(group, F.lit(rank).cast("bigint"), "p.*")))
    return chosen.select(group, "rank", "id")


def grown_regions(communities: DataFrame, group: str, quota: float, regions: int) -> DataFrame:
    """(group, id, region): communities (id, x, y, size) joined to growing regions, nearest to a region's
    centre first, until each has its quota; what is left goes to the nearest region."""

    def per_group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id").reset_index(drop=True)
        at, size = rows[["x", "y"]].to_numpy(float), rows["size"].to_numpy(float)
        seeds = [int(size.argmax())]
        far = np.hypot(*(at - at[seeds[0]]).T)
        while len(seeds) < min(regions, len(rows)):
            seeds.append(int(far.argmax()))
            far = np.minimum(far, np.hypot(*(at - at[seeds[-1]]).T))
        region = np.full(len(rows), -1)
        region[seeds] = range(len(seeds))
        filled = [size[s] for s in seeds]
        heap = [(float(np.hypot(*(at[i] - at[s]))), i, k) for k, s in enumerate(seeds) for i in range(len(rows)) if region[i] < 0]
        heapq.heapify(heap)
        rest = []
        while heap:
            d, i, k = heapq.heappop(heap)
            if region[i] < 0 and filled[k] < quota:
                region[i] = k
                filled[k] += size[i]
            elif region[i] < 0:
                rest.append((d, i, k))
        for _, i, k in rest:
            if region[i] < 0:
                region[i] = k
        return pd.DataFrame({group: rows[group].iloc[0], "id": rows["id"], "region": region})

    kinds = {f.name: f.dataType.simpleString() for f in communities.schema}
    return communities.groupBy(group).applyInPandas(per_group, f"{group} {kinds[group]}, id {kinds['id']}, region long")


def assigned(options: DataFrame, quotas: DataFrame, group: str) -> DataFrame:
    """(group, id, cell, cost): each id once, no cell over its quota, at the least total cost; ids that no
    cell has room for are left out, as few as possible.

    Successive cheapest augmenting paths over cells: with c cells a path is found in c^3 whatever the ids.
    """

    def per_group(key: tuple, rows: pd.DataFrame, caps: pd.DataFrame) -> pd.DataFrame:
        cells = sorted(caps["cell"].tolist())
        room = dict(zip(caps["cell"], caps["quota"], strict=True))
        cost: dict = defaultdict(dict)
        for i, c, w in sorted(zip(rows["id"].tolist(), rows["cell"].tolist(), rows["cost"].tolist(), strict=True)):
            if c in room:
                cost[i][c] = w
        held: dict = {c: set() for c in cells}
        for i in sorted(cost):
            # cheapest path from i over cells that pass one of theirs on
            dist = {c: w for c, w in cost[i].items()}
            back: dict = {c: (None, i) for c in dist}
            for _ in cells:
                moved = False
                for a in cells:
                    if a not in dist:
                        continue
                    for j in held[a]:
                        for b, w in cost[j].items():
                            if b != a and dist[a] - cost[j][a] + w < dist.get(b, float("inf")) - 1e-9:
                                dist[b], back[b], moved = dist[a] - cost[j][a] + w, (a, j), True
                if not moved:
                    break
            free = [(dist[c], c) for c in dist if len(held[c]) < room[c]]
            if not free:
                continue
            c = min(free)[1]
            while c is not None:
                a, j = back[c]
                if a is not None:
                    held[a].discard(j)
                held[c].add(j)
                c = a
        out = [(key[0], i, c, cost[i][c]) for c in cells for i in sorted(held[c])]
        return pd.DataFrame(out, columns=[group, "id", "cell", "cost"])

    kinds = {f.name: f.dataType.simpleString() for f in options.schema}
    schema = f"{group} {kinds[group]}, id {kinds['id']}, cell {kinds['cell']}, cost double"
    return options.groupBy(group).cogroup(quotas.groupBy(group)).applyInPandas(per_group, schema)


def greedy_cover(df: DataFrame, group: str, n: int) -> DataFrame:
    """(group, rank, id, score): points chosen one by one so that mean + a quarter of the 90 % quantile + a
    tenth of the largest distance of all points to the nearest chosen one is least."""

    def per_group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id").reset_index(drop=True)
        at, weight = rows[["x", "y"]].to_numpy(float), rows["weight"].to_numpy(float)
        near, out = np.full(len(rows), np.inf), []
        for rank in range(1, min(n, len(rows)) + 1):
            best = None
            for i in range(len(rows)):
                d = np.minimum(near, np.hypot(*(at - at[i]).T))
                score = float(np.average(d, weights=weight) + 0.25 * np.quantile(d, 0.9) + 0.1 * d.max())
                if best is None or score < best[0] - 1e-9:
                    best = (score, i, d)
            near = best[2]
            out.append((rows[group].iloc[0], rank, rows["id"].iloc[best[1]], best[0]))
        return pd.DataFrame(out, columns=[group, "rank", "id", "score"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.groupBy(group).applyInPandas(per_group, f"{group} {kinds[group]}, rank long, id {kinds['id']}, score double")


def balanced_split(groups: DataFrame, share: float, restarts: int) -> DataFrame:
    """`groups` (g, size, ...) for each restart with `held_out`: whole groups held out in a hashed order while at most
    `share` of all is, and `total`.

    Restarts are rows, so Spark runs them side by side; the running sum is a window in each restart.
    """
    tries = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))).alias("restart"))
    rank = hashing.stable_long(F.col("restart"), F.col("g"))
    every = W.partitionBy("restart")
    run = tries.withColumns({"upto": F.sum("size").over(every.orderBy(rank, "g").rowsBetween(W.unboundedPreceding, 0)), "total": F.sum("size").over(every)})
    return run.withColumn("held_out", F.col("upto") <= F.col("total") * share).drop("upto")


def best_split(groups: DataFrame, share: float, restarts: int, features: list[str], tolerance: float, slack: float) -> DataFrame:
    """(g, size, held_out, restart, count_error, feature_error) of the best restart of `balanced_split`: of those whose
    number is off by no more than `tolerance` of all, or than the least by `slack`, that of the least error in
    the features' sums (their differences from the share, relative, on average)."""
    run = settle(balanced_split(groups, share, restarts))

    def off(name: str) -> F.Column:
        return F.abs(F.sum(F.when(F.col("held_out"), F.col(name)).otherwise(0)) - F.sum(name) * share)

    relative = sum((off(n) / F.greatest(F.sum(n) * share, F.lit(1.0)) for n in features[1:]), off(features[0]) / F.greatest(F.sum(features[0]) * share, F.lit(1.0)))
    errors = settle(run.groupBy("restart").agg((off("size") / F.sum("size")).alias("count_error"), F.round(relative / len(features), 12).alias("feature_error")))
    least = errors.agg(F.greatest(F.lit(tolerance), F.min("count_error") + slack).alias("most"))
    best = errors.join(F.broadcast(least)).where("count_error <= most").agg(F.min(F.struct("feature_error", "count_error", "restart")).alias("b")).select("b.*")  # one row each
    return run.join(F.broadcast(best), "restart").select("g", "size", "held_out", "restart", F.round("count_error", 9).alias("count_error"), F.round("feature_error", 9).alias("feature_error"))


def nested_partition(df: DataFrame, groups: list[str], cells: list[str], key: str, parts: list[int], salt: str) -> DataFrame:
    """`df` with level_1, level_2 ...: each group cut into parts[0] children, each of these into parts[1], and so on,
    numbered from 0 inside the group.

    Rows are numbered by cell and inside it by hash, and dealt to the children in turn. So each child has
    its even share of its parent and of each of the parent's cells, up or down to a whole number, which is a
    controlled rounding of both margins at every level; a child's rows are in that order again, so one
    numbering serves all levels. The numbering is of the whole table, less the group's first.
    """
    rows = df.withColumn("_hash", hashing.stable_long(F.col(key), F.lit(salt)))
    placed = windows.global_position(rows, [*groups, *cells, "_hash", key])
    first = placed.groupBy(*groups).agg(F.min("position").alias("_first"))
    out = placed.join(first, groups).withColumn("_at", F.col("position") - F.col("_first"))
    child, done = F.lit(0).cast("bigint"), 1
    levels = {}
    for level, n in enumerate(parts, 1):
        child = child * n + F.pmod(F.floor(F.col("_at") / done), F.lit(n))
        levels[f"level_{level}"] = child
        done *= n
    return out.withColumns(levels).select(*df.columns, *levels)
