"""Windows, sorts, top-k, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from haulmark.functions import hashing
from haulmark.operators import aggregates, allocation, windows
from haulmark.sources.tables import LOCATIONS, POINTS, ROADS, STOP_ORDER, STOPS, locations, points, roads, stops, table

from .registry import query

ROUTES = "s AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY stop_no, part_id, station_id, packages, travel_s, ship_date) AS pos FROM stops)"


@query(f"WITH {ROADS} SELECT u, v, key, length_m FROM (SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY length_m, trips, key) AS n FROM roads) WHERE n = 1")
def win_row_number_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of parallel edges in a total order; as an aggregate it combines before the shuffle."""
    best = roads(spark, sf_dir).groupBy("u", "v").agg(F.min(F.struct("length_m", "trips", "key")).alias("b"))
    return best.select("u", "v", "b.key", "b.length_m")


@query(f"WITH {ROADS} SELECT u, v, key, length_m, least, n_at_least > 1 AS tied FROM (SELECT *, count(*) FILTER (length_m = least) OVER (PARTITION BY u, v) AS n_at_least FROM (SELECT *, min(length_m) OVER (PARTITION BY u, v) AS least FROM roads))")
def win_ties_at_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = W.partitionBy("u", "v")
    rows = roads(spark, sf_dir).withColumn("least", F.min("length_m").over(pair))
    return rows.withColumn("tied", F.count_if(F.col("length_m") == F.col("least")).over(pair) > 1).select("u", "v", "key", "length_m", "least", "tied")


@query(f"""WITH {STOPS}, d AS (SELECT station_id, ship_date, count(*) AS n FROM stops GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY station_id ORDER BY n DESC, ship_date ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM d)
  SELECT station_id, ship_date, n, running FROM c WHERE running - n < 40""")
def win_cumsum_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = stops(spark, sf_dir).groupBy("station_id", "ship_date").agg(F.count(F.lit(1)).alias("n"))
    return windows.take_until(days, ["station_id"], [F.desc("n"), F.asc("ship_date")], "n", 40)


@query(f"WITH {LOCATIONS}, c AS (SELECT city_id, units % 10 AS decile, count(*) AS n FROM locations GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY city_id ORDER BY decile) AS upto, sum(n) OVER (PARTITION BY city_id) AS total FROM c) SELECT city_id, min(decile) AS seed_decile FROM r WHERE upto >= total / 2 GROUP BY 1")
def win_seed_decile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = locations(spark, sf_dir).select("city_id", F.pmod("units", F.lit(10)).alias("decile"), F.lit(1).alias("w"))
    return aggregates.weighted_median(rows, ["city_id"], "decile", "w").withColumnRenamed("median", "seed_decile")


@query("SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_acctbal DESC, c_custkey) AS candidate_rank FROM customer")
def win_candidate_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("c_nationkey").orderBy("c_mktsegment", F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.row_number().over(w).cast("bigint").alias("candidate_rank"))


@query(f"""WITH {LOCATIONS}, p AS (SELECT location_id, city_id, kind, units % 10 AS decile, row_number() OVER (PARTITION BY city_id ORDER BY kind, units % 10, {hashing.sql_long("CAST(location_id AS VARCHAR) || '|nest'")}, location_id) - 1 AS pos FROM locations)
  SELECT location_id, city_id, kind, decile, pos % 2 AS half, pos % 2 * 5 + pos // 2 % 5 AS tenth, (pos % 2 * 5 + pos // 2 % 5) * 2 + pos // 10 % 2 AS twentieth FROM p""")
def nested_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each city in halves, tenths and twentieths, one inside the other, that share each (kind, decile) cell of their
    parent evenly: at every level a child has its share of a cell, up or down to a whole number."""
    rows = locations(spark, sf_dir).select("location_id", "city_id", "kind", F.pmod("units", F.lit(10)).alias("decile"))
    dealt = allocation.nested_partition(rows, ["city_id"], ["kind", "decile"], "location_id", [2, 5, 2], "nest")
    return dealt.select("location_id", "city_id", "kind", "decile", F.col("level_1").alias("half"), F.col("level_2").alias("tenth"), F.col("level_3").alias("twentieth"))


@query(f"WITH {STOPS} SELECT station_id, status, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY station_id), 6) AS share FROM stops GROUP BY 1, 2")
def win_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = stops(spark, sf_dir).groupBy("station_id", "status").agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("station_id")), 6))


@query("""SELECT user_id, event_id, value FROM (SELECT *, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) WHERE before IS NULL OR value < before""")
def win_running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.improving(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value").select("user_id", "event_id", "value")


@query(f"WITH {STOPS}, {ROUTES} SELECT route_id, pos, u, v FROM (SELECT route_id, pos, station_id AS u, lead(station_id) OVER (PARTITION BY route_id ORDER BY pos) AS v FROM s) WHERE v IS NOT NULL")
def route_arcs_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("route_id").orderBy(*STOP_ORDER)
    rows = stops(spark, sf_dir).select("route_id", F.row_number().over(w).cast("bigint").alias("pos"), F.col("station_id").alias("u"), F.lead("station_id").over(w).alias("v"))
    return rows.where(F.col("v").isNotNull())


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, value, event_type = 'purchase' AS done, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events),
  r AS (SELECT user_id, event_id, n, value AS ret FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.event_id, e.n, e.value + CASE WHEN e.done THEN 0 ELSE 0.9::DOUBLE * r.ret END FROM e JOIN r ON e.user_id = r.user_id AND e.n = r.n + 1)
  SELECT event_id, user_id, ret AS discounted FROM r""")
def discounted_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reverse discounted sums with a reset after each finished episode, by a fold over a user's episodes.

    An episode ends at a purchase, so a user's events are split there first and no fold is longer than an episode.
    """
    back = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")).rowsBetween(W.unboundedPreceding, 0)
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", (F.col("event_type") == "purchase").alias("done"))
    rows = rows.withColumn("episode", F.sum(F.col("done").cast("int")).over(back))
    episodes = rows.groupBy("user_id", "episode").agg(F.reverse(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value")))).alias("steps"))
    zero = F.struct(F.lit(0.0).alias("ret"), F.array().cast("array<struct<event_id:bigint,ret:double>>").alias("out"))

    def step(acc: F.Column, x: F.Column) -> F.Column:
        ret = x["value"] + 0.9 * acc["ret"]
        return F.struct(ret.alias("ret"), F.concat(acc["out"], F.array(F.struct(x["event_id"].alias("event_id"), ret.alias("ret")))).alias("out"))

    out = episodes.select("user_id", F.explode(F.aggregate("steps", zero, step, lambda a: a["out"])).alias("r"))
    return out.select("r.event_id", "user_id", F.col("r.ret").alias("discounted"))


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC NULLS LAST, o_orderkey")
def sort_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole order, by range partitioning."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy("o_orderpriority", F.desc_nulls_last("o_totalprice"), "o_orderkey")


@query(f"""SELECT c_custkey, c_nationkey, c_mktsegment, pick FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY {hashing.sql_long("CAST(c_custkey AS VARCHAR) || '|map'")}, c_custkey) AS pick FROM customer) WHERE pick <= 3""")
def stratified_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = hashing.stable_long(F.col("c_custkey"), F.lit("map"))
    found = windows.hash_quota(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], rank, ["c_custkey"], 3)
    return found.select("c_custkey", "c_nationkey", "c_mktsegment", "pick")


@query(f"""WITH {STOPS}, d AS (SELECT station_id, ship_date, count(*) AS n FROM stops GROUP BY 1, 2 HAVING count(*) >= 2)
  SELECT station_id, arg_min(ship_date, ({hashing.sql_long("CAST(station_id AS VARCHAR) || '|' || CAST(ship_date AS VARCHAR)")}, ship_date)) AS ship_date FROM d GROUP BY 1""")
def hash_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = stops(spark, sf_dir).groupBy("station_id", "ship_date").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    rank = F.struct(hashing.stable_long(F.col("station_id"), F.col("ship_date")), "ship_date")
    return days.groupBy("station_id").agg(F.min_by("ship_date", rank).alias("ship_date"))


@query("SELECT p_name AS value, n, round(n / total, 6) AS share FROM (SELECT p_name, count(*) AS n, sum(count(*)) OVER () AS total FROM part GROUP BY 1) ORDER BY n DESC, value LIMIT 10")
def topk_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten commonest values with their share of all rows: a top-k report."""
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    top = counts.orderBy(F.desc("n"), "value").limit(10)
    return top.withColumn("_one", F.lit(1)).join(F.broadcast(total.withColumn("_one", F.lit(1))), "_one").select("value", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100")
def limit_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred of an order: the limit is the operator."""
    return table(spark, sf_dir, "orders").orderBy("o_orderdate", "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query(f"WITH {STOPS} SELECT route_id, stop_no, part_id, station_id, travel_s FROM stops WHERE travel_s > 5000 ORDER BY travel_s DESC, route_id, stop_no, part_id LIMIT 50")
def topn_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty largest over a threshold: a top-k report."""
    far = stops(spark, sf_dir).where("travel_s > 5000").select("route_id", "stop_no", "part_id", "station_id", "travel_s")
    return far.orderBy(F.desc("travel_s"), "route_id", "stop_no", "part_id").limit(50)


@query(f"""WITH {STOPS}, r AS (SELECT station_id, route_id % 16 AS restart, abs(avg(packages) - 25.5) AS count_error, abs(avg(discount) - 0.05) AS feature_error FROM stops GROUP BY 1, 2), m AS (SELECT *, min(count_error) OVER (PARTITION BY station_id) AS least FROM r)
  SELECT station_id, arg_min(restart, (round(feature_error, 9), restart)) AS restart, count(*) AS in_tolerance FROM m WHERE count_error <= greatest(2.0, least + 0.5) GROUP BY 1""")
def restart_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the restarts whose count error is in tolerance, that of the least feature error."""
    tries = stops(spark, sf_dir).groupBy("station_id", F.pmod("route_id", F.lit(16)).alias("restart")).agg(F.abs(F.avg("packages") - 25.5).alias("count_error"), F.abs(F.avg("discount") - 0.05).alias("feature_error"))
    ok = tries.withColumn("least", F.min("count_error").over(W.partitionBy("station_id"))).where(F.col("count_error") <= F.greatest(F.lit(2.0), F.col("least") + 0.5))
    return ok.groupBy("station_id").agg(F.min_by("restart", F.struct(F.round("feature_error", 9), "restart")).alias("restart"), F.count(F.lit(1)).alias("in_tolerance"))


@query("SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    b = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT l_partkey AS part_id FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40 INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 40")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    heavy = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("part_id"), "l_returnflag")
    return heavy.where("l_returnflag = 'R'").select("part_id").intersect(heavy.where("l_returnflag = 'A'").select("part_id"))


@query("SELECT p_partkey AS part_id FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 47")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    heavy = table(spark, sf_dir, "lineitem").where("l_quantity > 47").select(F.col("l_partkey").alias("part_id"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id")).subtract(heavy)


@query(f"""WITH {LOCATIONS}, c AS (SELECT city_id, location_id, units % 3 AS child FROM locations) SELECT city_id, count(*) AS n_parent, count(DISTINCT location_id) AS n_union, count(DISTINCT child) AS children, count(*) = count(DISTINCT location_id) AS is_partition FROM c GROUP BY 1""")
def partition_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children are disjoint and complete if their sizes add up to that of their union and of the parent."""
    child = locations(spark, sf_dir).select("city_id", "location_id", F.pmod("units", F.lit(3)).alias("child"))
    sizes = child.groupBy("city_id", "child").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("location_id").alias("d"))
    parts = sizes.groupBy("city_id").agg(F.sum("n").alias("n_parent"), F.count(F.lit(1)).alias("children"))
    union = child.groupBy("city_id").agg(F.count_distinct("location_id").alias("n_union"))
    return parts.join(union, "city_id").select("city_id", "n_parent", "n_union", "children", (F.col("n_parent") == F.col("n_union")).alias("is_partition"))


@query("SELECT l_partkey AS part_id, count(DISTINCT l_suppkey) AS parents, min(l_suppkey) AS first_parent, max(l_suppkey) AS last_parent FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def conflict_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part_id")).agg(F.count_distinct("l_suppkey").alias("parents"), F.min("l_suppkey").alias("first_parent"), F.max("l_suppkey").alias("last_parent"))
    return parents.where("parents > 1")


@query("""WITH i AS (SELECT event_id, ts, CASE WHEN user_id % 3 = 0 THEN 'fd-' || user_id || '-' || event_type ELSE 'h-' || substr(sha1(user_id || '|' || event_type || '|' || CAST(ts AS DATE)), 1, 16) END AS identity FROM events)
  SELECT identity, arg_min(event_id, (ts, event_id)) AS event_id, count(*) AS copies FROM i GROUP BY 1""")
def record_identity_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haulmark.streaming.events import identity

    rows = table(spark, sf_dir, "events").select("event_id", "ts", identity().alias("identity"))
    return rows.groupBy("identity").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count(F.lit(1)).alias("copies"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type")
def win_changed_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", before.alias("before"))
    return rows.where(~F.col("before").eqNullSafe(F.col("event_type"))).drop("before")


@query(f"""WITH {STOPS}, c AS (SELECT route_id, station_id, round(sum(travel_s), 4) AS cost FROM stops GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY cost, station_id) AS n, min(cost) OVER (PARTITION BY route_id) AS d0, max(cost) OVER (PARTITION BY route_id) AS dmax, count(*) OVER (PARTITION BY route_id) AS len FROM c)
  SELECT route_id, round(sum(cost - d0) FILTER (n <= 3) + greatest(0, 3 - max(len)) * greatest(1, max(dmax)), 3) AS regret, min(d0) AS best FROM r GROUP BY 1""")
def win_regret_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regret-3 of each route's insertion costs: what the second and third best lose against the best; missing ones count the worst."""
    cost = stops(spark, sf_dir).groupBy("route_id", "station_id").agg(F.round(F.sum("travel_s"), 4).alias("cost"))
    every = W.partitionBy("route_id")
    rows = cost.select("route_id", "cost", F.row_number().over(every.orderBy("cost", "station_id")).alias("n"), F.min("cost").over(every).alias("d0"))
    kept = rows.groupBy("route_id").agg(F.sum(F.when(F.col("n") <= 3, F.col("cost") - F.col("d0"))).alias("lost"), F.max("n").alias("len"), F.max("cost").alias("worst"), F.min("d0").alias("best"))
    missing = F.greatest(F.lit(0), 3 - F.col("len")) * F.greatest(F.lit(1.0), F.col("worst"))
    return kept.select("route_id", F.round(F.col("lost") + missing, 3).alias("regret"), "best")


@query(f"""WITH {STOPS}, {ROUTES}, a AS (SELECT route_id, pos, station_id, abs(station_id - coalesce(lag(station_id) OVER w, 0)) + abs(station_id - coalesce(lead(station_id) OVER w, 0)) AS score, count(*) OVER (PARTITION BY route_id) AS len FROM s WINDOW w AS (PARTITION BY route_id ORDER BY pos)),
  r AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY score DESC, pos) AS n FROM a) SELECT route_id, pos, station_id, score FROM r WHERE n <= greatest(1, len // 3)""")
def win_detour_topthird(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, every = W.partitionBy("route_id").orderBy("pos"), W.partitionBy("route_id")
    rows = stops(spark, sf_dir).withColumn("pos", F.row_number().over(W.partitionBy("route_id").orderBy(*STOP_ORDER)).cast("bigint"))
    me = F.col("station_id")
    score = F.abs(me - F.coalesce(F.lag(me).over(w), F.lit(0))) + F.abs(me - F.coalesce(F.lead(me).over(w), F.lit(0)))
    rows = rows.select("route_id", "pos", "station_id", score.alias("score"), F.count(F.lit(1)).over(every).alias("len"))
    rows = rows.withColumn("n", F.row_number().over(every.orderBy(F.desc("score"), "pos")))
    return rows.where(F.col("n") <= F.greatest(F.lit(1), F.floor(F.col("len") / 3))).select("route_id", "pos", "station_id", "score")


@query(f"""WITH {STOPS}, {ROUTES}, a AS (SELECT route_id, travel_s AS t0, packages AS p0, status AS s0 FROM s WHERE pos = 1)
  SELECT route_id, pos, round(0.01 * abs(travel_s - t0) + CASE WHEN status = s0 THEN -1 ELSE 1 END + 0.1 * abs(packages - p0), 6) AS relatedness, row_number() OVER (PARTITION BY route_id ORDER BY round(0.01 * abs(travel_s - t0) + CASE WHEN status = s0 THEN -1 ELSE 1 END + 0.1 * abs(packages - p0), 6), pos) AS rank FROM s JOIN a USING (route_id)""")
def shaw_relatedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How related each stop is to its route's first: carried over by a window, so no self-join is needed."""
    w = W.partitionBy("route_id").orderBy(*STOP_ORDER)
    first = lambda c: F.first(c).over(w)
    score = 0.01 * F.abs(F.col("travel_s") - first("travel_s")) + F.when(F.col("status") == first("status"), -1).otherwise(1) + 0.1 * F.abs(F.col("packages") - first("packages"))
    rows = stops(spark, sf_dir).select("route_id", F.row_number().over(w).cast("bigint").alias("pos"), F.round(score, 6).alias("relatedness"))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("route_id").orderBy("relatedness", "pos")).cast("bigint"))


@query(f"""WITH {STOPS}, {ROUTES}, c AS (SELECT route_id, pos, part_id, count(*) OVER (PARTITION BY route_id) AS n, {hashing.sql_unit("CAST(route_id AS VARCHAR) || '|rank'")} AS u FROM s)
  SELECT route_id, pos, part_id FROM c WHERE pos - 1 = least(greatest(CAST(floor(pow(u, 3) * n) AS BIGINT), 0), n - 1)""")
def biased_rank_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("route_id").orderBy(*STOP_ORDER)
    u = hashing.stable_unit(F.col("route_id"), F.lit("rank"))
    rows = stops(spark, sf_dir).select("route_id", F.row_number().over(w).cast("bigint").alias("pos"), "part_id", F.count(F.lit(1)).over(W.partitionBy("route_id")).alias("n"))
    return rows.where(F.col("pos") - 1 == F.least(F.greatest(F.floor(F.pow(u, F.lit(3)) * F.col("n")), F.lit(0)), F.col("n") - 1)).select("route_id", "pos", "part_id")


@query(f"""WITH {STOPS}, {ROUTES}, c AS (SELECT route_id, pos, greatest(0, packages - 10) AS w, {hashing.sql_unit("CAST(route_id AS VARCHAR) || '|wheel'")} AS u FROM s), r AS (SELECT *, sum(w) OVER (PARTITION BY route_id ORDER BY pos) AS upto, sum(w) OVER (PARTITION BY route_id) AS total FROM c)
  SELECT route_id, min(pos) AS pick FROM r WHERE upto >= u * total GROUP BY 1""")
def roulette_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = hashing.stable_unit(F.col("route_id"), F.lit("wheel"))
    rows = stops(spark, sf_dir).select("route_id", F.row_number().over(W.partitionBy("route_id").orderBy(*STOP_ORDER)).cast("bigint").alias("pos"), F.greatest(F.lit(0).cast("bigint"), F.col("packages") - 10).alias("w"))
    rows = rows.withColumns({"upto": F.sum("w").over(windows.upto(["route_id"], "pos")), "total": F.sum("w").over(W.partitionBy("route_id"))})
    return rows.where(F.col("upto") >= u * F.col("total")).groupBy("route_id").agg(F.min("pos").alias("pick"))


@query(f"""WITH {POINTS} SELECT point_id, {hashing.sql_unit("CAST(point_id AS VARCHAR) || '|u'")} AS u, CAST(pick AS BIGINT) AS pick FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY round(-ln({hashing.sql_unit("CAST(point_id AS VARCHAR) || '|u'")}) / greatest(point_id % 9, 1), 9), point_id) AS pick FROM points) WHERE pick <= 12""")
def weighted_sample_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weighted sample of twelve of each kind without replacement: the smallest of -ln(u) / weight."""
    u = hashing.stable_unit(F.col("point_id"), F.lit("u"))
    rank = F.round(-F.ln(u) / F.greatest(F.pmod("point_id", F.lit(9)), F.lit(1)), 9)
    return windows.hash_quota(points(spark, sf_dir), ["kind"], rank, ["point_id"], 12).select("point_id", u.alias("u"), "pick")
