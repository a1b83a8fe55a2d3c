"""Allocation, quotas, sampling and generated plans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from haulmark.functions import hashing
from haulmark.operators import allocation, auction, joins, matching, regions, windows
from haulmark.operators.lineage import settle
from haulmark.sources.tables import LOCATIONS, locations, points, table

from .registry import query

L = hashing.sql_long


@query(f"""WITH {LOCATIONS}, s AS (SELECT city_id, kind, sum(units) AS share FROM locations GROUP BY 1, 2), e AS (SELECT *, round(share / sum(share) OVER (PARTITION BY city_id) * 50, 9) AS exact FROM s), f AS (SELECT *, CAST(floor(exact) AS BIGINT) AS fl, 50 - sum(CAST(floor(exact) AS BIGINT)) OVER (PARTITION BY city_id) AS short FROM e)
  SELECT city_id, kind, fl + (row_number() OVER (PARTITION BY city_id ORDER BY round(exact - fl, 9) DESC, {L("kind")}, kind) <= short)::BIGINT AS count FROM f""")
def largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = locations(spark, sf_dir).groupBy("city_id", "kind").agg(F.sum("units").alias("share")).withColumn("total", F.lit(50))
    return allocation.largest_remainder(shares, ["city_id"], "share", "total", "kind").select("city_id", "kind", "count")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City tables of kind by decile, scaled to about 200 in each city."""
    cells = locations(spark, sf_dir).groupBy("city_id", "kind", F.pmod("units", F.lit(10)).alias("decile")).agg(F.sum("units").alias("n"))
    return cells.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("city_id")) * 200).drop("n")


@query()
def controlled_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole counts with exact row and column margins; a city's table has at most 5 by 10 cells."""
    return allocation.controlled_rounding(_cells(spark, sf_dir), "city_id", "kind", "decile", "share")


@query()
def quota_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotas that the available rows of each cell can meet: the rounded table, cut where a cell has fewer."""
    quota = allocation.controlled_rounding(_cells(spark, sf_dir), "city_id", "kind", "decile", "share")
    have = locations(spark, sf_dir).groupBy("city_id", "kind", F.pmod("units", F.lit(10)).alias("decile")).agg(F.count(F.lit(1)).alias("available"))
    both = joins.fill_left(quota, have, ["city_id", "kind", "decile"], {"available": 0})
    return both.select("city_id", "kind", "decile", F.least("count", "available").alias("quota"), F.greatest(F.col("count") - F.col("available"), F.lit(0)).alias("deficit"))


@query()
def maxmin_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allocation.farthest_seeds(points(spark, sf_dir).withColumnRenamed("point_id", "id"), "kind", 5)


def _communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid cells of 500 m as communities: few for each kind whatever the number of points."""
    rows = points(spark, sf_dir)
    cells = rows.groupBy("kind", F.floor(F.col("x") / 500).alias("gx"), F.floor(F.col("y") / 500).alias("gy")).agg(F.count(F.lit(1)).alias("size"))
    return cells.select("kind", (F.col("gx") * 1000 + F.col("gy")).alias("id"), (F.col("gx") * 500.0 + 250).alias("x"), (F.col("gy") * 500.0 + 250).alias("y"), "size")


@query()
def region_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allocation.grown_regions(_communities(spark, sf_dir), "kind", 12.0, 4)


def _area(spark: SparkSession, sf_dir: str, part: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Points with their communities (kind, gx, gy) and deciles; the communities' capacities; ways between adjacent ones;
    and the quotas of three regions, each a `part`-th of every decile."""
    rows = points(spark, sf_dir).withColumn("decile", F.least(F.lit(9), F.floor(F.hypot("x", "y") / 400)).cast("int"))
    gx, gy = F.floor(F.col("x") / 500), F.floor(F.col("y") / 500)
    rows = rows.withColumns({"gx": gx, "gy": gy}).withColumn("id", F.col("gx") * 1000 + F.col("gy"))
    cells = settle(rows.groupBy("kind", "gx", "gy", "id", "decile").agg(F.count(F.lit(1)).alias("capacity")))
    quotas = cells.groupBy("kind", "decile").agg(F.ceil(F.sum("capacity") / part).alias("quota"))
    quotas = quotas.select("kind", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("region"), "decile", "quota")
    place = cells.select("kind", "id", "gx", "gy").distinct()
    step = F.explode(F.array(*(F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j))).alias("s")
    ways = place.select("kind", F.col("id").alias("u"), "gx", "gy", step).select("kind", "u", ((F.col("gx") + F.col("s.dx")) * 1000 + F.col("gy") + F.col("s.dy")).alias("v"), F.hypot("s.dx", "s.dy").alias("far"))
    edges = ways.join(place.select("kind", F.col("id").alias("v")), ["kind", "v"]).select("kind", "u", "v", (F.col("far") * (1 + hashing.stable_unit(F.col("u"), F.col("v")))).alias("w"))
    return tuple(df.withColumnRenamed("kind", "group") for df in (rows, cells, edges, quotas))


@query()
def graph_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three regions for each kind, grown over adjacent communities until they have room for their quotas by decile."""
    _, cells, edges, quotas = _area(spark, sf_dir, 6)
    members, lacks = regions.graph_regions(cells.select("group", "id", "decile", "capacity"), edges, quotas)
    short = lacks.groupBy("group", "region").agg(F.sum("deficit").alias("deficit"))
    return members.join(short, ["group", "region"], "left").select(F.col("group").alias("kind"), "region", "id", "step", F.coalesce("deficit", F.lit(0)).alias("deficit"))


@query()
def contested_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points to the quotas of three regions for each kind that start from the same communities (within four cells of
    the fullest) and grow while they compete: each point once, by a hashed priority; beside it the round in
    which its region took the community in (0: at first), and what the region lacks."""
    rows, cells, edges, quotas = _area(spark, sf_dir, 6)
    full = cells.groupBy("group", "id", "gx", "gy").agg(F.sum("capacity").alias("n")).groupBy("group").agg(F.max_by(F.struct("gx", "gy"), F.struct("n", "id")).alias("c"))
    near = cells.join(full, "group").where((F.abs(F.col("gx") - F.col("c.gx")) <= 4) & (F.abs(F.col("gy") - F.col("c.gy")) <= 4)).select("group", "id").distinct()
    members = near.select("group", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("region"), "id")
    residents = rows.select("group", "id", "decile", F.col("point_id").alias("who"))
    links = settle(edges.union(edges.select("group", "v", "u", "w")).groupBy("group", "u", "v").agg(F.min("w").alias("w")))
    priority = -F.log(hashing.stable_unit(F.col("region"), F.col("who")) + 1e-9)
    placed, areas, lacks = auction.contested(residents, members, links, quotas, priority, 1.0)
    short = lacks.groupBy("group", "region").agg(F.sum("deficit").alias("deficit"))
    out = placed.join(residents.select("group", "who", "id"), ["group", "who"]).join(areas, ["group", "region", "id"]).join(short, ["group", "region"], "left")
    return out.select(F.col("group").alias("kind"), "region", "decile", F.col("who").alias("point_id"), "cost", "step", F.coalesce("deficit", F.lit(0)).alias("deficit"))


@query()
def greedy_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four chargers for each kind, chosen among its communities."""
    return allocation.greedy_cover(_communities(spark, sf_dir).withColumnRenamed("size", "weight"), "kind", 4)


@query()
def quota_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities to four quadrants' quotas at the least total distance."""
    rows = _communities(spark, sf_dir)
    corners = F.array(*(F.struct(F.lit(c).alias("cell"), F.lit(x).alias("cx"), F.lit(y).alias("cy")) for c, (x, y) in enumerate(((-1000.0, -1000.0), (-1000.0, 1000.0), (1000.0, -1000.0), (1000.0, 1000.0)))))
    options = rows.select("kind", "id", "x", "y", F.explode(corners).alias("c")).select("kind", "id", F.col("c.cell").alias("cell"), F.hypot(F.col("x") - F.col("c.cx"), F.col("y") - F.col("c.cy")).alias("cost"))
    quotas = rows.groupBy("kind").agg(F.ceil(F.count(F.lit(1)) / 4).cast("int").alias("quota")).select("kind", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("cell"), "quota")
    return allocation.assigned(options, quotas, "kind")


def _options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and the suppliers that could serve them, in each order's family (customer), with the quantity."""
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    order = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("group"))
    return item.join(order, "l_orderkey").select("group", F.col("l_orderkey").alias("left"), F.col("l_suppkey").alias("right"), "l_quantity")


@query()
def bipartite_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders to suppliers' slots that are feasible, as many as can be, in each order's family (customer)."""
    options = _options(spark, sf_dir).where("l_quantity >= 10").select("group", "left", "right")
    return matching.matched(options)[0].select(F.col("group").alias("family"), "left", "right")


#: Least quantities that a supplier's slots take, source by source.
SOURCES = [40, 20, 5]


@query()
def order_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each family's sources in turn until one covers all of its orders: what was asked, matched, and stuck at each."""
    options = settle(_options(spark, sf_dir))
    ranked = options.withColumn("rank", F.explode(F.array(*(F.when(F.col("l_quantity") >= q, F.lit(rank)) for rank, q in enumerate(SOURCES))))).where("rank IS NOT NULL")
    _, attempts = matching.by_sources(options.select("group", "left"), ranked.select("group", "rank", "left", "right"), len(SOURCES))
    return attempts.withColumnRenamed("group", "family")


#: What a held-out fifth of the stations should look like, and how far off the number of stops may be.
SHARE, RESTARTS, TOLERANCE, SLACK = 0.2, 256, 0.002, 0.0005
FEATURES = {"n_returned": "l_returnflag = 'R'", "n_accepted": "l_returnflag = 'A'", "n_open": "l_linestatus = 'O'", "n_large": "l_quantity > 25"}


@query(f"""WITH g AS (SELECT l_suppkey AS g, count(*) AS size, {", ".join(f"count(*) FILTER ({test}) AS {name}" for name, test in FEATURES.items())} FROM lineitem GROUP BY 1),
  t AS (SELECT *, sum(size) OVER (PARTITION BY restart ORDER BY {L("CAST(restart AS VARCHAR) || '|' || CAST(g AS VARCHAR)")}, g ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER (PARTITION BY restart) AS total FROM g, (SELECT unnest(range(0, {RESTARTS})) AS restart)),
  e AS (SELECT restart, abs(coalesce(sum(size) FILTER (upto <= total * {SHARE}::DOUBLE), 0) - sum(size) * {SHARE}::DOUBLE) / sum(size) AS count_error,
    round(({" + ".join(f"abs(coalesce(sum({n}) FILTER (upto <= total * {SHARE}::DOUBLE), 0) - sum({n}) * {SHARE}::DOUBLE) / greatest(sum({n}) * {SHARE}::DOUBLE, 1.0::DOUBLE)" for n in FEATURES)}) / {len(FEATURES)}, 12) AS feature_error FROM t GROUP BY 1),
  b AS (SELECT arg_min(restart, (feature_error, count_error, restart)) AS restart FROM e WHERE count_error <= (SELECT greatest({TOLERANCE}::DOUBLE, min(count_error) + {SLACK}::DOUBLE) FROM e))
  SELECT g, size, upto <= total * {SHARE}::DOUBLE AS held_out, CAST(t.restart AS INTEGER) AS restart, round(count_error, 9) AS count_error, round(feature_error, 9) AS feature_error FROM t JOIN b USING (restart) JOIN e USING (restart)""")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole stations held out for a fifth of all stops: of 256 hashed restarts those near the share by number, and of
    these the one whose features are held out most evenly."""
    sizes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("g")).agg(F.count(F.lit(1)).alias("size"), *(F.count_if(F.expr(test)).alias(name) for name, test in FEATURES.items()))
    return allocation.best_split(sizes, SHARE, RESTARTS, list(FEATURES), TOLERANCE, SLACK)


@query(f"""SELECT c_custkey AS family, {L("CAST(c_custkey AS VARCHAR) || '|depot'")} AS depot_seed, {L("CAST(c_custkey AS VARCHAR) || '|customers'")} AS customer_seed, {L("CAST(c_custkey AS VARCHAR) || '|depot|retry|1'")} AS retry_seed, CASE WHEN {L("CAST(c_custkey AS VARCHAR) || '|day'")} % 7 < 5 THEN 'weekday' ELSE 'weekend' END AS day_type FROM customer""")
def seed_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = F.col("c_custkey")
    seed = lambda *names: hashing.stable_long(family, *map(F.lit, names))
    day = F.when(F.pmod(seed("day"), F.lit(7)) < 5, "weekday").otherwise("weekend")
    return table(spark, sf_dir, "customer").select(family.alias("family"), seed("depot").alias("depot_seed"), seed("customers").alias("customer_seed"), seed("depot", "retry", "1").alias("retry_seed"), day.alias("day_type"))


@query(f"""WITH c AS (SELECT c_nationkey AS city, count(*) AS families FROM customer GROUP BY 1), f AS (SELECT city, families, unnest(range(0, families)) AS ordinal FROM c), d AS (SELECT city, ordinal, families, row_number() OVER (PARTITION BY city ORDER BY {L("CAST(city AS VARCHAR) || '|' || CAST(ordinal AS VARCHAR)")}, ordinal) AS n FROM f),
  t AS (SELECT city, ordinal, CASE WHEN n <= ceil(families * 5 / 7) THEN 'weekday' ELSE 'weekend' END AS day_type FROM d)
  SELECT city, ordinal, CAST(scale AS INTEGER) AS scale, branch, day_type, 'F' || substr(md5(city || '|' || ordinal), 1, 10) AS family_id FROM t, (SELECT unnest([50, 100, 500]) AS scale), (SELECT unnest(range(0, 10)) AS branch) WHERE branch < 500 // scale""")
def generation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City by ordinal by scale by branch, with an exact five-to-two quota of day types in a hashed order.

    A family for each customer. Ordinals and hashed places are places in whole orders less the city's
    first, so no city's families meet in one task.
    """

    def placed(df: DataFrame, order: list, name: str) -> DataFrame:
        rows = windows.global_position(df, ["city", *order])
        first = rows.groupBy("city").agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("families"))
        return rows.join(first, "city").select(*df.columns, (F.col("position") - F.col("first")).alias(name), "families")

    family = placed(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("city"), "c_custkey"), ["c_custkey"], "ordinal").select("city", "ordinal")
    typed = placed(family.withColumn("rank", hashing.stable_long(F.col("city"), F.col("ordinal"))), ["rank", "ordinal"], "n")
    typed = typed.withColumn("day_type", F.when(F.col("n") < F.ceil(F.col("families") * 5 / 7), "weekday").otherwise("weekend"))
    views = F.array(*(F.struct(F.lit(s).alias("scale"), F.lit(b).cast("bigint").alias("branch")) for s in (50, 100, 500) for b in range(500 // s)))
    out = typed.select("city", "ordinal", "day_type", F.explode(views).alias("v"))
    return out.select("city", "ordinal", "v.scale", "v.branch", "day_type", F.concat(F.lit("F"), F.substring(F.md5(hashing.joined(F.col("city"), F.col("ordinal"))), 1, 10)).alias("family_id"))


#: Draws of an order until its window, the day's end and the vehicle all fit; the seconds are those of a day.
ATTEMPTS, DAY_START, DAY_END, CAPACITY = 64, 28800, 64800, 150_000
PARTS = [(1, "start"), (9, "service"), (17, "demand")]
DRAWS = ", ".join(f"CAST('0x' || substr(h, {at}, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u_{name}" for at, name in PARTS)


@query(f"""WITH t AS (SELECT o_orderkey, attempt, {DAY_START} + 600 * (o_custkey % 17) AS arrival, 1800 + 60 * (o_custkey % 89) AS back, md5(CAST(o_orderkey AS VARCHAR) || '|' || CAST(attempt AS VARCHAR)) AS h FROM orders, (SELECT unnest(range(0, {ATTEMPTS})) AS attempt)),
  d AS (SELECT *, {DRAWS} FROM t), w AS (SELECT *, {DAY_START} + CAST(floor(u_start * 36000) AS BIGINT) AS tw_start, 60 + CAST(floor(u_service * 1800) AS BIGINT) AS service, 1000 + CAST(floor(u_demand * 200000) AS BIGINT) AS demand FROM d),
  k AS (SELECT o_orderkey, attempt, greatest(arrival, tw_start) <= tw_start + 7200 AS tw_ok, greatest(arrival, tw_start) + service + back <= {DAY_END} AS horizon_ok, demand <= {CAPACITY} AS capacity_ok FROM w),
  m AS (SELECT *, min(attempt) FILTER (tw_ok AND horizon_ok AND capacity_ok) OVER (PARTITION BY o_orderkey) AS ok FROM k)
  SELECT o_orderkey, CAST(min(ok) AS INTEGER) AS attempt, CAST(count(*) FILTER (NOT tw_ok AND attempt < coalesce(ok, {ATTEMPTS})) AS INTEGER) AS time_window, CAST(count(*) FILTER (NOT horizon_ok AND attempt < coalesce(ok, {ATTEMPTS})) AS INTEGER) AS operating_horizon, CAST(count(*) FILTER (NOT capacity_ok AND attempt < coalesce(ok, {ATTEMPTS})) AS INTEGER) AS cargo_capacity FROM m GROUP BY 1""")
def resample_until_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws by attempt until one passes all gates, with what the ones before failed: a fold inside the row, without a
    shuffle, that draws no further once it has passed; up to 64 draws."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (DAY_START + F.pmod("o_custkey", F.lit(17)) * 600).alias("arrival"), (1800 + F.pmod("o_custkey", F.lit(89)) * 60).alias("back"))

    def draw(state: F.Column, attempt: F.Column) -> F.Column:
        h = F.md5(hashing.joined(F.col("o_orderkey"), attempt))
        u = {name: F.conv(F.substring(h, at, 8), 16, 10).cast("bigint") / F.lit(4294967296.0) for at, name in PARTS}
        start, service, demand = DAY_START + F.floor(u["start"] * 36000), 60 + F.floor(u["service"] * 1800), 1000 + F.floor(u["demand"] * 200000)
        begins = F.greatest("arrival", start)
        ok = {"time_window": begins <= start + 7200, "operating_horizon": begins + service + F.col("back") <= DAY_END, "cargo_capacity": demand <= CAPACITY}
        passed = ok["time_window"] & ok["operating_horizon"] & ok["cargo_capacity"]
        failed = {name: state[name] + F.when(test, 0).otherwise(1) for name, test in ok.items()}
        drawn = F.struct(F.when(passed, attempt).alias("attempt"), *(f.alias(name) for name, f in failed.items()))
        return F.when(state["attempt"].isNotNull(), state).otherwise(drawn)

    none = F.struct(F.lit(None).cast("int").alias("attempt"), *(F.lit(0).alias(name) for name in ("time_window", "operating_horizon", "cargo_capacity")))
    return rows.select("o_orderkey", F.aggregate(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1)), none, draw).alias("x")).select("o_orderkey", "x.*")


#: Most draws of one kind that an order needs, and orders that are drawn at once.
MOST_UNITS, MOST_PACKAGES, BLOCK = 60, 72, 2048
#: How likely a unit orders.
ORDERS = 0.3


def uniforms(seeds: np.ndarray, stream: int, n: int) -> np.ndarray:
    """n draws in (0, 1) for each seed: a mixed counter (splitmix64), so the same wherever a row is drawn."""
    x = seeds.astype(np.uint64)[:, None] + (np.arange(n, dtype=np.uint64) + np.uint64(stream << 20)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53) + 2.0**-54


def drawn_orders(seeds: np.ndarray, units: np.ndarray) -> dict[str, np.ndarray]:
    """Packages, volume, service time and window of the orders of these seeds and units.

    Orders of units are binomial, given that there is one at least: the first is drawn among the units, those after it
    are free; packages add a negative binomial of two failures an
    order (a sum of geometric draws); volumes and service times are lognormal, window starts normal.
    """

    def normal(stream: int, n: int) -> np.ndarray:
        return np.sqrt(-2 * np.log(uniforms(seeds, stream, n))) * np.cos(2 * np.pi * uniforms(seeds, stream + 1, n))

    def first(n: int, counts: np.ndarray) -> np.ndarray:
        return np.arange(n) < counts[:, None]

    # the place of the first unit that orders, given that one does
    place = np.ceil(np.log1p(-uniforms(seeds, 10, 1)[:, 0] * (1 - (1 - ORDERS) ** units)) / np.log(1 - ORDERS))
    later = np.arange(1, MOST_UNITS + 1) > np.clip(place, 1, units)[:, None]
    orders = 1 + ((uniforms(seeds, 0, MOST_UNITS) < ORDERS) & first(MOST_UNITS, units) & later).sum(1)
    geometric = np.floor(np.log(uniforms(seeds, 1, 2 * MOST_UNITS)) / np.log(0.2))
    packages = np.clip(orders + (geometric * first(2 * MOST_UNITS, 2 * orders)).sum(1), 1, MOST_PACKAGES).astype(np.int64)
    volumes = np.clip(np.exp(7.5 + 0.9 * normal(2, MOST_PACKAGES)), 1, 2e5)
    start = np.clip(36000 + 5400 * normal(6, 1)[:, 0], 28800, 72000)
    return {
        "packages": packages, "volume_cm3": (volumes * first(MOST_PACKAGES, packages)).sum(1), "service_s": np.clip(np.exp(4.0 + 0.5 * normal(4, 1)[:, 0]), 10, 1800),
        "tw_start_s": np.where(uniforms(seeds, 8, 1)[:, 0] < 0.3, start, np.nan),
    }


@query()
def sample_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages, volume, service time and window of each order, drawn in blocks of orders from counters that
    the order's own key seeds: the same on every partitioning."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                out = drawn_orders(some.column(1).to_numpy(), some.column(2).to_numpy())
                yield pa.record_batch([some.column(0), *(pa.array(x, from_pandas=True) for x in out.values())], ["o_orderkey", *out])

    rows = table(spark, sf_dir, "orders").select("o_orderkey", hashing.stable_long(F.col("o_orderkey"), F.lit("orders")).alias("seed"), (1 + F.pmod("o_custkey", F.lit(MOST_UNITS))).alias("units"))
    return rows.mapInArrow(draw, "o_orderkey long, packages long, volume_cm3 double, service_s double, tw_start_s double")
