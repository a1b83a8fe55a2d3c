"""Aggregations: conditional, pivoted, weighted, distributional, by grouping sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from haulmark.functions import classify, time
from haulmark.operators import aggregates, joins, replay, windows
from haulmark.operators.lineage import settle
from haulmark.sources.tables import LOCATIONS, POINTS, ROADS, STOP_ORDER, STOPS, locations, points, roads, stops, table

from .registry import query

ENVELOPE = f"""{STOPS}, e AS (SELECT station_id, quantile_cont(travel_s, 0.99) AS cap FROM stops GROUP BY station_id), i AS (SELECT s.* FROM stops s JOIN e USING (station_id) WHERE travel_s <= cap),
  d AS (SELECT station_id, quantile_cont(travel_s, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS edges FROM i GROUP BY station_id),
  a AS (SELECT i.*, CAST(len(list_filter(edges[2:10], lambda x: x <= travel_s)) AS INTEGER) AS decile FROM i JOIN d USING (station_id))"""


def enveloped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops inside their station's 99 % travel-time envelope, with the decile of the travel time in it."""
    rows = stops(spark, sf_dir)
    edges = aggregates.enveloped_edges(rows, ["station_id"], "travel_s", 0.99)
    return rows.join(edges, "station_id").where("travel_s <= cap").withColumn("decile", classify.decile(F.col("travel_s"), F.col("edges"))).drop("cap", "edges")


@query(f"""WITH {ENVELOPE}, p AS (SELECT station_id, ship_date, day_type, {", ".join(f"count(*) FILTER (decile = {i}) AS decile_{i}" for i in range(10))} FROM a GROUP BY 1, 2, 3),
  r AS (SELECT station_id, ship_date, day_type, count(*) AS n_stops, count(DISTINCT route_id) AS n_routes FROM stops GROUP BY 1, 2, 3)
  SELECT r.station_id, r.ship_date, r.day_type, n_stops, n_routes, {", ".join(f"coalesce(decile_{i}, 0) AS decile_{i}" for i in range(10))} FROM r LEFT JOIN p USING (station_id, ship_date, day_type)""")
def station_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The structure of station days: stops by travel-time decile inside the station's envelope, beside all stops and routes."""
    rows = stops(spark, sf_dir)
    edges = aggregates.enveloped_edges(rows, ["station_id"], "travel_s", 0.99)
    # a day that isn't known equals no other, as in the SQL's join
    known = F.col("ship_date").isNotNull() & (F.col("travel_s") <= F.col("cap"))
    placed = rows.join(edges, "station_id", "left").select("station_id", "ship_date", "route_id", F.when(known, classify.decile(F.col("travel_s"), F.col("edges"))).alias("decile"))
    dealt = placed.repartition(aggregates.tasks_for(rows.count()), "station_id", "ship_date", "route_id")
    routes = dealt.groupBy("station_id", "ship_date", "route_id").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("decile") == i).alias(f"d{i}") for i in range(10)))
    days = routes.groupBy("station_id", "ship_date").agg(F.sum("n").alias("n_stops"), F.count("route_id").alias("n_routes"), *(F.sum(f"d{i}").alias(f"decile_{i}") for i in range(10)))
    return days.select("station_id", "ship_date", time.day_type(F.col("ship_date")).alias("day_type"), "n_stops", "n_routes", *(f"decile_{i}" for i in range(10)))


@query(f"""SELECT l_suppkey AS station_id, count(*) AS n, count(DISTINCT l_orderkey) AS n_routes, count(DISTINCT l_partkey) AS n_parts, sum(l_quantity) AS quantity, round(sum(l_extendedprice), 2) AS price, max(l_quantity) AS most, min(l_quantity) AS least,
  {aggregates.sql_mean('l_discount', 2)} AS mean_discount, min(l_shipdate) AS first_day, max(l_shipdate) AS last_day, round(sqrt(pow(max(l_quantity) - min(l_quantity), 2) + pow(max(l_discount) - min(l_discount), 2)), 6) AS spread,
  min(l_returnflag) AS first_flag, max(l_linestatus) AS last_status FROM lineitem GROUP BY 1""")
def agg_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fourteen aggregates of each station. Distinct parts are counted apart, so that no row has to be copied for them;
    routes and all else are sums of each station's routes."""
    q, d = F.col("l_quantity"), F.col("l_discount")
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "station_id")
    routes = rows.groupBy("station_id", "l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum(q).alias("quantity"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("price"), F.max(q).alias("most"), F.min(q).alias("least"), F.sum(d.cast("decimal(18,2)")).alias("discount"), F.count(d).alias("n_discount"),
        F.max(d).alias("most_d"), F.min(d).alias("least_d"), F.min("l_shipdate").alias("first_day"), F.max("l_shipdate").alias("last_day"), F.min("l_returnflag").alias("first_flag"), F.max("l_linestatus").alias("last_status"))
    parts = rows.select("station_id", "l_partkey").distinct().groupBy("station_id").agg(F.count("l_partkey").alias("n_parts"))
    every = routes.groupBy("station_id").agg(
        F.sum("n").alias("n"), F.count("l_orderkey").alias("n_routes"), F.sum("quantity").alias("quantity"), F.round(F.sum("price").cast("double"), 2).alias("price"), F.max("most").alias("most"), F.min("least").alias("least"),
        (F.sum("discount").cast("double") / F.sum("n_discount")).alias("mean_discount"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"),
        F.round(F.hypot(F.max("most") - F.min("least"), F.max("most_d") - F.min("least_d")), 6).alias("spread"), F.min("first_flag").alias("first_flag"), F.max("last_status").alias("last_status"))
    return every.join(parts, "station_id")


@query(f"WITH {LOCATIONS} SELECT city_id, count(*) FILTER (kind = 'BUILDING') AS buildings, count(*) FILTER (units > 20) AS large, coalesce(sum(units) FILTER (release_eligible), 0)::BIGINT AS released_units FROM locations GROUP BY 1")
def agg_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locations(spark, sf_dir).groupBy("city_id").agg(
        F.count_if(F.col("kind") == "BUILDING").alias("buildings"), F.count_if(F.col("units") > 20).alias("large"), F.sum(F.when(F.col("release_eligible"), F.col("units")).otherwise(0)).alias("released_units"))


@query(f"WITH {STOPS} SELECT route_id, status, count(*) AS n FROM stops GROUP BY 1, 2")
def agg_group_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stops(spark, sf_dir).groupBy("route_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ENVELOPE} SELECT station_id, {', '.join(f'count(*) FILTER (decile = {i}) AS decile_{i}' for i in range(10))} FROM a GROUP BY 1")
def agg_pivot_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.pivot_counts(enveloped(spark, sf_dir), ["station_id"], "decile", list(range(10)), "decile_")


KINDS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(f"WITH {LOCATIONS} SELECT city_id, {', '.join(f'count(*) FILTER (kind = {k!r}) AS kind_{k}' for k in KINDS)}, sum(units)::BIGINT AS units, {aggregates.sql_mean('balance', 2)} AS mean_balance FROM locations GROUP BY 1")
def agg_group_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    one_hot = (F.count_if(F.col("kind") == k).alias(f"kind_{k}") for k in KINDS)
    return locations(spark, sf_dir).groupBy("city_id").agg(*one_hot, F.sum("units").alias("units"), aggregates.exact_mean("balance", 2).alias("mean_balance"))


@query(f"WITH {POINTS} SELECT kind, count(*) AS weight, {aggregates.sql_mean('x', 3)} AS x, {aggregates.sql_mean('y', 3)} AS y FROM points GROUP BY 1")
def agg_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("weight"), aggregates.exact_mean("x", 3).alias("x"), aggregates.exact_mean("y", 3).alias("y"))


@query(f"""WITH {STOPS}, v AS (SELECT station_id, packages, sum(service_s) AS w FROM stops GROUP BY 1, 2), c AS (SELECT *, sum(w) OVER (PARTITION BY station_id ORDER BY packages) AS upto, sum(w) OVER (PARTITION BY station_id) AS total FROM v)
  SELECT station_id, min(packages) AS median FROM c WHERE upto >= total / 2 GROUP BY 1""")
def agg_weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.weighted_median(stops(spark, sf_dir), ["station_id"], "packages", "service_s")


@query(f"""WITH {STOPS} SELECT day_type, {", ".join(f"round(quantile_cont(travel_s, {q}), 6) AS q{round(q * 100):02d}" for q in (0.0, 0.5, 0.9, 0.95, 0.99, 1.0))} FROM stops GROUP BY 1""")
def agg_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = [0.0, 0.5, 0.9, 0.95, 0.99, 1.0]
    found = aggregates.placed_quantiles(stops(spark, sf_dir), ["day_type"], "travel_s", shares)
    return found.select("day_type", *(F.round(F.col("edges")[i], 6).alias(f"q{round(s * 100):02d}") for i, s in enumerate(shares)))


@query(f"WITH {ENVELOPE} SELECT station_id, CAST(i AS INTEGER) AS decile, round(edges[i + 1], 6) AS edge FROM d, (SELECT unnest(range(0, 11)) AS i)")
def decile_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = aggregates.enveloped_edges(stops(spark, sf_dir), ["station_id"], "travel_s", 0.99)
    return edges.select("station_id", F.posexplode("edges").alias("decile", "edge")).withColumn("edge", F.round("edge", 6))


@query(f"""WITH {LOCATIONS}, o AS (SELECT location_id, kind, CASE WHEN units % 3 <> 0 THEN least(units, 50)::DOUBLE END AS kw FROM locations), m AS (SELECT kind, quantile_cont(kw, 0.5) AS median FROM o GROUP BY kind)
  SELECT location_id, coalesce(kw, median, 11.0::DOUBLE) AS kw, CASE WHEN kw IS NOT NULL THEN 'observed' WHEN median IS NOT NULL THEN 'median' ELSE 'fallback' END AS source FROM o JOIN m USING (kind)""")
def agg_median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = locations(spark, sf_dir).select("location_id", "kind", F.when(F.col("units") % 3 != 0, F.least("units", F.lit(50)).cast("double")).alias("kw"))
    medians = rows.groupBy("kind").agg(F.median("kw").alias("median"))
    source = F.when(F.col("kw").isNotNull(), "observed").when(F.col("median").isNotNull(), "median").otherwise("fallback")
    return rows.join(medians, "kind").select("location_id", F.coalesce("kw", "median", F.lit(11.0)).alias("kw"), source.alias("source"))


@query("SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'status ' || o_orderstatus, count(*) FROM orders GROUP BY 1")
def agg_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both columns' counts of one scan, by grouping sets."""
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus")
    found = orders.groupingSets([[F.col("o_orderpriority")], [F.col("o_orderstatus")]], "o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.coalesce("o_orderpriority", F.concat(F.lit("status "), "o_orderstatus")).alias("value"), "n")


@query("SELECT user_id, count(DISTINCT event_type) AS types, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1")
def agg_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("types"), F.count_distinct(F.to_date("ts")).alias("days"))


LIMITS = [250, 500, 1000, 2000, 5000]


@query(f"""WITH {STOPS}, t AS (SELECT unnest({LIMITS}) AS lim), c AS (SELECT lim, day_type, count(*) FILTER (travel_s <= lim) AS n, count(*) AS every, coalesce(sum(packages) FILTER (travel_s <= lim), 0)::BIGINT AS packages FROM stops, t GROUP BY GROUPING SETS ((lim), (lim, day_type)))
  SELECT CAST(lim AS INTEGER) AS lim, coalesce(day_type, 'all') AS day_type, n, round(n / every, 6) AS share, packages FROM c""")
def agg_threshold_groupingsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage under each threshold, in all and by day type. Thresholds are columns of one aggregate, so rows aren't multiplied by them."""
    x = F.col("travel_s")
    each = [c for t in LIMITS for c in (F.count_if(x <= t).alias(f"n{t}"), F.sum(F.when(x <= t, F.col("packages")).otherwise(0)).alias(f"p{t}"))]
    sets = stops(spark, sf_dir).rollup("day_type").agg(F.count(F.lit(1)).alias("every"), *each)
    rows = F.array(*(F.struct(F.lit(t).alias("lim"), F.col(f"n{t}").alias("n"), F.col(f"p{t}").alias("packages")) for t in LIMITS))
    out = sets.select(F.coalesce("day_type", F.lit("all")).alias("day_type"), "every", F.explode(rows).alias("r"))
    return out.select("r.lim", "day_type", "r.n", F.round(F.col("r.n") / F.col("every"), 6).alias("share"), "r.packages")


@query(f"""WITH {STOPS} SELECT station_id, count(*) AS n, min(travel_s) AS low, round(quantile_cont(travel_s, 0.1), 5) AS q10, round(quantile_cont(travel_s, 0.5), 5) AS q50, round(quantile_cont(travel_s, 0.9), 5) AS q90, round(quantile_cont(travel_s, 0.99), 5) AS q99,
  {aggregates.sql_mean('travel_s', 3)} AS mean, max(travel_s) AS high, round(stddev_pop(travel_s), 5) AS std FROM stops GROUP BY 1""")
def agg_summary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stops(spark, sf_dir).groupBy("station_id").agg(*aggregates.summary("travel_s"), aggregates.exact_mean("travel_s", 3).alias("exact"))
    return found.select("station_id", "n", "low", *(F.round(c, 5).alias(c) for c in ("q10", "q50", "q90", "q99")), F.col("exact").alias("mean"), "high", F.round("std", 5).alias("std"))


@query(f"WITH {STOPS} SELECT status, round(corr(packages, travel_s), 5) AS r, count(*) AS n FROM stops GROUP BY 1")
def agg_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stops(spark, sf_dir).groupBy("status").agg(F.round(F.corr(F.col("packages").cast("double"), F.col("travel_s")), 5).alias("r"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LOCATIONS}, s AS (SELECT city_id, kind, count(*) AS n FROM locations GROUP BY 1, 2), t AS (SELECT *, n / sum(n) OVER (PARTITION BY city_id) AS share FROM s)
  SELECT city_id, round(sum(share * share), 6) AS hhi, round(max(share), 6) AS largest_share, count(*) AS groups FROM t GROUP BY 1""")
def agg_hhi(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aggregates.concentration(locations(spark, sf_dir), ["city_id"], "kind")
    return found.select("city_id", F.round("hhi", 6).alias("hhi"), F.round("largest_share", 6).alias("largest_share"), "groups")


def _w1_sql(keys: str, source: str, value: str, side: str) -> str:
    return f"""v AS (SELECT {keys}, {value} AS value, count(*) FILTER ({side}) AS a, count(*) FILTER (NOT ({side})) AS b FROM {source} GROUP BY {keys}, {value}),
  c AS (SELECT {keys}, sum(a) OVER r / sum(a) OVER e AS fa, sum(b) OVER r / sum(b) OVER e AS fb, lead(value) OVER r - value AS dx FROM v WINDOW r AS (PARTITION BY {keys} ORDER BY value), e AS (PARTITION BY {keys})),
  w AS (SELECT {keys}, sum(abs(fa - fb) * coalesce(dx, 0)) AS w1 FROM c GROUP BY {keys})"""


@query(f"WITH {STOPS}, {_w1_sql('station_id', 'stops', 'packages', 'day_type = $$weekend$$')} SELECT station_id, round(w1, 6) AS w1 FROM w".replace("$$", "'"))
def agg_wasserstein(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stops(spark, sf_dir).select("station_id", "packages", (F.col("day_type") == "weekend").alias("weekend"))
    return aggregates.wasserstein(rows, ["station_id"], "packages", "weekend").select("station_id", F.round("w1", 6).alias("w1"))


@query(f"""WITH {STOPS}, s AS (SELECT n_regionkey AS city, day_type, CASE WHEN packages <= 10 THEN 'small' WHEN packages <= 30 THEN 'medium' ELSE 'large' END AS scale, route_id, packages, travel_s, discount FROM stops JOIN supplier ON station_id = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
  SELECT city, day_type, scale, count(DISTINCT route_id) AS routes, count(*) AS n, round(avg(packages), 6) AS mean_packages, {aggregates.sql_mean('travel_s', 3)} AS mean_travel_s, {aggregates.sql_mean('discount', 2)} AS mean_discount, count(DISTINCT packages) = max(packages) - min(packages) + 1 AS consistent FROM s GROUP BY 1, 2, 3""")
def strata_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("station_id"), F.col("n_regionkey").alias("city"))
    n = F.col("packages")
    rows = stops(spark, sf_dir).join(place, "station_id").withColumn("scale", F.when(n <= 10, "small").when(n <= 30, "medium").otherwise("large"))
    return rows.groupBy("city", "day_type", "scale").agg(
        F.count_distinct("route_id").alias("routes"), F.count(F.lit(1)).alias("n"), F.round(F.avg(n), 6).alias("mean_packages"), aggregates.exact_mean("travel_s", 3).alias("mean_travel_s"),
        aggregates.exact_mean("discount", 2).alias("mean_discount"), (F.count_distinct("packages") == F.max(n) - F.min(n) + 1).alias("consistent"))


@query("""WITH a AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) = 1 AS first_try, event_type <> 'error' AS ok FROM events)
  SELECT user_id, count(*) AS n, round(avg(CASE WHEN first_try THEN ok::INT END), 6) AS first_try_rate, round(avg(ok::INT), 6) AS success_rate, bool_and(value < 300) AS all_in_range, round(avg(CASE WHEN ok THEN (value > 50)::INT END), 6) AS high_given_ok FROM a GROUP BY 1""")
def corpus_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.row_number().over(W.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")) == 1
    rows = table(spark, sf_dir, "events").select("user_id", "value", first.alias("first"), (F.col("event_type") != "error").alias("ok"))
    rate = lambda c, given=None: F.round(F.avg(c.cast("int") if given is None else F.when(given, c.cast("int"))), 6)
    return rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), rate(F.col("ok"), F.col("first")).alias("first_try_rate"), rate(F.col("ok")).alias("success_rate"), F.bool_and(F.col("value") < 300).alias("all_in_range"), rate(F.col("value") > 50, F.col("ok")).alias("high_given_ok"))


@query(f"""WITH {STOPS}, x AS (SELECT station_id, packages, status, day_type FROM stops), {_w1_sql('station_id', 'x', 'packages', 'status = $$R$$')}, m AS (SELECT station_id, status, count(*) AS n FROM x GROUP BY 1, 2), h AS (SELECT station_id, sum(pow(n / t, 2)) AS hhi FROM (SELECT *, sum(n) OVER (PARTITION BY station_id) AS t FROM m) GROUP BY 1)
  SELECT station_id, round(w1, 6) AS radial_w1, round(hhi, 6) AS hhi, n, n >= 20 AND w1 < 15 AND hhi < 0.6 AS gates FROM w JOIN h USING (station_id) JOIN (SELECT station_id, count(*) AS n FROM x GROUP BY 1) USING (station_id)""".replace("$$", "'"))
def family_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stops(spark, sf_dir).select("station_id", "packages", "status", (F.col("status") == "R").alias("returned"))
    w1 = aggregates.wasserstein(rows, ["station_id"], "packages", "returned")
    spread = aggregates.concentration(rows, ["station_id"], "status").select("station_id", "hhi")
    sizes = rows.groupBy("station_id").agg(F.count(F.lit(1)).alias("n"))
    gates = (F.col("n") >= 20) & (F.col("w1") < 15) & (F.col("hhi") < 0.6)
    return w1.join(spread, "station_id").join(sizes, "station_id").select("station_id", F.round("w1", 6).alias("radial_w1"), F.round("hhi", 6).alias("hhi"), "n", gates.alias("gates"))


@query(f"""WITH {ROADS}, c AS (SELECT n_regionkey AS component, sum(length_m) AS length_m, count(DISTINCT u) AS nodes FROM roads JOIN nation ON u = n_nationkey GROUP BY 1), t AS (SELECT *, length_m / sum(length_m) OVER () AS share, nodes / sum(nodes) OVER () AS node_share FROM c)
  SELECT component, length_m, nodes, round(share, 6) AS share, round(node_share, 6) AS node_share, share < 0.15 AS skipped, round(CASE WHEN share >= 0.15 THEN length_m / (SELECT sum(length_m) FROM t WHERE share >= 0.15) END, 6) AS effective_share FROM t""")
def component_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of all, and of what stays when small components are skipped; totals are one row beside the few components."""
    region = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("u"), F.col("n_regionkey").alias("component"))
    sums = roads(spark, sf_dir).join(region, "u").groupBy("component").agg(F.sum("length_m").alias("length_m"), F.count_distinct("u").alias("nodes"))
    every = W.partitionBy(F.lit(1))
    shares = sums.withColumns({"share": F.col("length_m") / F.sum("length_m").over(every), "node_share": F.col("nodes") / F.sum("nodes").over(every)})
    kept = F.when(F.col("share") >= 0.15, F.col("length_m"))
    return shares.select(
        "component", "length_m", "nodes", F.round("share", 6).alias("share"), F.round("node_share", 6).alias("node_share"), (F.col("share") < 0.15).alias("skipped"), F.round(kept / F.sum(kept).over(every), 6).alias("effective_share"))


@query(f"""WITH {STOPS}, s AS (SELECT station_id, day_type, packages AS vmt, 10 + route_id % 60 AS speed FROM stops), b AS (SELECT station_id, speed, sum(vmt / speed) AS vht FROM s GROUP BY 1, 2),
  q AS (SELECT station_id, min(speed) AS q85 FROM (SELECT *, sum(vht) OVER (PARTITION BY station_id ORDER BY speed) AS upto, sum(vht) OVER (PARTITION BY station_id) AS total FROM b) WHERE upto >= 0.85 * total - 1e-9 GROUP BY 1)
  SELECT station_id, round(sum(vmt) / sum(vmt / speed), 6) AS harmonic_kph, q85 FROM s JOIN q USING (station_id) GROUP BY station_id, q85""")
def agg_harmonic_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stops(spark, sf_dir).select("station_id", F.col("packages").alias("vmt"), (10 + F.pmod("route_id", F.lit(60))).alias("speed"))
    hours = F.col("vmt") / F.col("speed")
    bins = rows.groupBy("station_id", "speed").agg(F.sum(hours).alias("vht"))
    run = bins.withColumns({"upto": F.sum("vht").over(W.partitionBy("station_id").orderBy("speed")), "total": F.sum("vht").over(W.partitionBy("station_id"))})
    q85 = run.where(F.col("upto") >= 0.85 * F.col("total") - 1e-9).groupBy("station_id").agg(F.min("speed").alias("q85"))
    return rows.groupBy("station_id").agg(F.round(F.sum("vmt") / F.sum(hours), 6).alias("harmonic_kph")).join(q85, "station_id")


@query(f"""WITH {STOPS} SELECT route_id, CASE WHEN count(DISTINCT station_id) = 1 THEN 'single' ELSE 'multiple' END AS match, list_sort(list_distinct(list(status))) AS statuses, count(DISTINCT station_id) AS n FROM stops GROUP BY 1""")
def collect_list_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    stations = F.size(F.collect_set("station_id"))
    return stops(spark, sf_dir).groupBy("route_id").agg(F.when(stations == 1, "single").otherwise("multiple").alias("match"), F.array_sort(F.collect_set("status")).alias("statuses"), stations.cast("bigint").alias("n"))


@query(f"""WITH {STOPS}, p AS (SELECT route_id, station_id, count(*) AS n, count(DISTINCT status) AS windows, count(*) FILTER (status = 'N') AS missing, sum(packages)::BIGINT AS packages FROM stops GROUP BY 1, 2),
  k AS (SELECT *, CASE WHEN missing > 0 AND missing < n THEN 'mixed' WHEN windows > 1 THEN 'conflicting' ELSE 'single' END AS state FROM p)
  SELECT route_id, count(*) AS stops, sum(packages)::BIGINT AS packages, max(packages) AS most, count(*) FILTER (state = 'single') AS single, count(*) FILTER (state = 'conflicting') AS conflicting, count(*) FILTER (state = 'mixed') AS mixed FROM k GROUP BY 1""")
def agg_two_level_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_stop = stops(spark, sf_dir).groupBy("route_id", "station_id").agg(
        F.count(F.lit(1)).alias("n"), F.size(F.collect_set("status")).alias("windows"), F.count_if(F.col("status") == "N").alias("missing"), F.sum("packages").alias("packages"))
    state = F.when((F.col("missing") > 0) & (F.col("missing") < F.col("n")), "mixed").when(F.col("windows") > 1, "conflicting").otherwise("single")
    kinds = (F.count_if(F.col("state") == k).alias(k) for k in ("single", "conflicting", "mixed"))
    return by_stop.withColumn("state", state).groupBy("route_id").agg(F.count(F.lit(1)).alias("stops"), F.sum("packages").alias("packages"), F.max("packages").alias("most"), *kinds)


@query("""SELECT n_name AS city, o_orderpriority AS carrier, count(*) AS depots, round(sum(o_totalprice), 2) AS total, count(DISTINCT o_custkey) AS customers FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2 ORDER BY depots DESC, city, carrier""")
def agg_carrier_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("city"))
    found = table(spark, sf_dir, "orders").join(place, "o_custkey").groupBy("city", F.col("o_orderpriority").alias("carrier")).agg(
        F.count(F.lit(1)).alias("depots"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.count_distinct("o_custkey").alias("customers"))
    return found.orderBy(F.desc("depots"), "city", "carrier")


@query(f"""WITH {ENVELOPE}, h AS (SELECT station_id, decile, count(*) AS n FROM a GROUP BY 1, 2), t AS (SELECT station_id, decile FROM (SELECT DISTINCT station_id FROM a), (SELECT CAST(unnest(range(0, 10)) AS INTEGER) AS decile))
  SELECT station_id, decile, coalesce(n, 0) AS available, CAST(40 + decile AS BIGINT) AS target, CAST(greatest(0, 40 + decile - coalesce(n, 0)) AS BIGINT) AS deficit FROM t LEFT JOIN h USING (station_id, decile)""")
def capacity_deficit(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = enveloped(spark, sf_dir).groupBy("station_id", "decile").agg(F.count(F.lit(1)).alias("available"))
    target = have.select("station_id").distinct().select("station_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("decile")).withColumn("target", (40 + F.col("decile")).cast("bigint"))
    return joins.fill_left(target, have, ["station_id", "decile"], {"available": 0}).withColumn("deficit", F.greatest(F.lit(0).cast("bigint"), F.col("target") - F.col("available")))


@query("""SELECT coalesce(o_orderstatus, 'all') AS cohort, coalesce(substr(o_orderpriority, 1, 1), 'all') AS scale, count(*) AS views, count(DISTINCT o_custkey) AS families FROM orders GROUP BY ROLLUP (o_orderstatus, substr(o_orderpriority, 1, 1))""")
def plan_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("cohort"), F.substring("o_orderpriority", 1, 1).alias("scale"), "o_custkey")
    found = orders.rollup("cohort", "scale").agg(F.count(F.lit(1)).alias("views"), F.count_distinct("o_custkey").alias("families"))
    return found.na.fill("all", ["cohort", "scale"])


@query(f"""WITH {STOPS}, t AS (SELECT route_id, station_id, sum(travel_s) AS objective, sum(packages)::BIGINT AS served, bool_and(status <> 'R') AS feasible FROM stops GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY feasible DESC, CASE WHEN feasible THEN 0 ELSE -served END, round(objective, 4), station_id) AS n FROM t) SELECT route_id, station_id, feasible, served, round(objective, 4) AS objective FROM r WHERE n = 1""")
def best_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feasible trajectory of the least objective, else that which serves most: one composite key, one aggregate."""
    tries = stops(spark, sf_dir).groupBy("route_id", "station_id").agg(F.round(F.sum("travel_s"), 4).alias("objective"), F.sum("packages").alias("served"), F.bool_and(F.col("status") != "R").alias("feasible"))
    rank = F.struct(~F.col("feasible"), F.when(F.col("feasible"), 0).otherwise(-F.col("served")), "objective", "station_id")
    best = tries.groupBy("route_id").agg(F.min_by(F.struct("station_id", "feasible", "served", "objective"), rank).alias("b"))
    return best.select("route_id", "b.*")


@query(f"""WITH {ROADS}, m AS (SELECT u AS i, v AS j, min(length_m) AS w FROM roads GROUP BY 1, 2) SELECT a.i, count(*) AS n, round(avg(CASE WHEN abs(a.w - b.w) > 1e-9 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS asymmetric_share FROM m a JOIN m b ON a.i = b.j AND a.j = b.i GROUP BY 1""")
def matrix_asymmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = roads(spark, sf_dir).groupBy(F.col("u").alias("i"), F.col("v").alias("j")).agg(F.min("length_m").alias("w"))
    back = m.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("w").alias("back"))
    off = (F.abs(F.col("w") - F.col("back")) > 1e-9).cast("double")
    return m.join(back, ["i", "j"]).groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(off), 6).alias("asymmetric_share"))


#: Distances that may be promoted, and how much larger the one area may be than the other (null: any).
THRESHOLDS, FACTORS = [1, 2, 5, 10, 20, 50, 100], [2.0, 4.0, 10.0, None]


@query(f"""WITH {STOPS}, a AS (SELECT travel_s / 60 AS distance, greatest(packages, part_id % 50 + 1) / least(packages, part_id % 50 + 1) AS factor, packages AS units FROM stops WHERE status <> 'N'),
  t AS (SELECT unnest([1, 2, 5, 10, 20, 50, 100]) AS threshold), f AS (SELECT unnest([2.0::DOUBLE, 4.0::DOUBLE, 10.0::DOUBLE, NULL]) AS area_factor)
  SELECT CAST(threshold AS INTEGER) AS threshold, area_factor, count(*) FILTER (ok) AS n, round(count(*) FILTER (ok) / count(*), 6) AS share, coalesce(sum(units) FILTER (ok), 0)::BIGINT AS units, round(coalesce(sum(units) FILTER (ok), 0) / sum(units), 6) AS unit_share
  FROM (SELECT *, distance <= threshold AND (area_factor IS NULL OR factor <= area_factor) AS ok FROM a, t, f) GROUP BY 1, 2""")
def scenario_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven distances by four area factors: 28 scenarios as columns of one aggregate, then as rows."""
    other = F.pmod("part_id", F.lit(50)) + 1
    rows = stops(spark, sf_dir).where("status <> 'N'").select((F.col("travel_s") / 60).alias("distance"), (F.greatest("packages", other) / F.least("packages", other)).alias("factor"), "packages")
    grid = [(t, f) for t in THRESHOLDS for f in FACTORS]
    passes = lambda t, f: (F.col("distance") <= t) & (F.lit(True) if f is None else F.col("factor") <= f)
    each = [c for k, (t, f) in enumerate(grid) for c in (F.count_if(passes(t, f)).alias(f"n{k}"), F.sum(F.when(passes(t, f), F.col("packages")).otherwise(0)).alias(f"u{k}"))]
    total = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum("packages").alias("all"), *each)
    out = F.array(*(F.struct(F.lit(t).alias("threshold"), F.lit(f).cast("double").alias("area_factor"), F.col(f"n{k}").alias("n"), F.col(f"u{k}").alias("units")) for k, (t, f) in enumerate(grid)))
    out = total.select("rows", "all", F.explode(out).alias("r"))
    return out.select("r.threshold", "r.area_factor", "r.n", F.round(F.col("r.n") / F.col("rows"), 6).alias("share"), "r.units", F.round(F.col("r.units") / F.col("all"), 6).alias("unit_share"))


ROUTES = "s AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY stop_no, part_id, station_id, packages, travel_s, ship_date) AS pos FROM stops)"


@query(f"""WITH {STOPS}, {ROUTES}, a AS (SELECT station_id AS node, pos, lag(station_id) OVER w AS before, lead(station_id) OVER w AS after FROM s WINDOW w AS (PARTITION BY route_id ORDER BY pos))
  SELECT node, before, after, count(*) AS n, round(avg(pos), 6) AS mean_pos FROM a GROUP BY 1, 2, 3""")
def attribute_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haulmark.sources.tables import STOP_ORDER

    w = W.partitionBy("route_id").orderBy(*STOP_ORDER)
    rows = stops(spark, sf_dir).select(F.col("station_id").alias("node"), F.row_number().over(w).alias("pos"), F.lag("station_id").over(w).alias("before"), F.lead("station_id").over(w).alias("after"))
    return rows.groupBy("node", "before", "after").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("pos"), 6).alias("mean_pos"))


@query(f"""WITH RECURSIVE {STOPS}, {ROUTES}, x AS MATERIALIZED (SELECT route_id, pos, station_id AS node, travel_s / 10 AS travel, packages * 1.5::DOUBLE AS energy, status = 'N' AS station, CASE WHEN status = 'N' THEN 0 ELSE demand_cm3 END AS demand,
    CASE WHEN status = 'N' THEN 28800.0::DOUBLE ELSE 30000.0::DOUBLE END AS tw0, CASE WHEN status = 'N' THEN 86400.0::DOUBLE ELSE 31000 + packages * 500.0::DOUBLE END AS tw1, service_s FROM s),
  r(route_id, pos, t, used, load, late, short, kept) AS (SELECT DISTINCT route_id, 0::BIGINT, 28800.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, true FROM x
    UNION ALL SELECT x.route_id, x.pos, greatest(t + travel, tw0) + CASE WHEN station THEN (used + energy) / 100.0::DOUBLE * 3600 ELSE service_s END, CASE WHEN station THEN 0.0::DOUBLE ELSE used + energy END, load + demand,
      late + greatest(0.0::DOUBLE, greatest(t + travel, tw0) - tw1), short + greatest(0.0::DOUBLE, used + energy - 100.0::DOUBLE), kept AND greatest(t + travel, tw0) <= tw1 + 1e-5 AND used + energy <= 100.0::DOUBLE + 1e-5 FROM r JOIN x ON x.route_id = r.route_id AND x.pos = r.pos + 1),
  d AS (SELECT route_id, sum(CAST(travel_s AS DECIMAL(18,3))) AS distance, count(*) AS n, count(*) FILTER (status <> 'N') AS customers FROM stops GROUP BY 1),
  p AS (SELECT o_custkey AS solution_id, route_id, row_number() OVER (PARTITION BY o_custkey ORDER BY route_id) - 1 AS k, d.*, greatest(0.0::DOUBLE, load - 100000) AS load_pen, late AS time_pen, short AS battery_pen, kept AND load <= 100000 + 1e-5 AND customers > 0 AS feasible
    FROM r JOIN d USING (route_id) JOIN orders ON o_orderkey = route_id WHERE pos = n),
  a AS (SELECT solution_id, node, k, station, coalesce(lag(node) OVER w, -1) AS before, coalesce(lead(node) OVER w, -1) AS after FROM x JOIN p USING (route_id) WINDOW w AS (PARTITION BY route_id ORDER BY pos)),
  f AS (SELECT *, count(*) OVER (PARTITION BY node, k, before, after) AS freq FROM a),
  h AS (SELECT solution_id, sum(freq)::BIGINT AS frequency, count(*) FILTER (NOT station) AS customers, count(DISTINCT node) FILTER (NOT station) AS served FROM f GROUP BY 1),
  c AS (SELECT solution_id, count(*) AS routes, sum(n)::BIGINT AS n, CAST(sum(distance) AS DOUBLE) AS distance, CAST(sum(CAST(load_pen AS DECIMAL(18,3))) AS DOUBLE) AS load_pen, CAST(sum(CAST(time_pen AS DECIMAL(18,4))) AS DOUBLE) AS time_pen,
    CAST(sum(CAST(battery_pen AS DECIMAL(18,3))) AS DOUBLE) AS battery_pen, bool_and(feasible) AS feasible FROM p GROUP BY 1),
  t AS (SELECT count(*) AS total FROM a)
  SELECT solution_id, routes, distance, load_pen, time_pen, battery_pen, frequency, round(distance + (0.01::DOUBLE * load_pen + 0.5::DOUBLE * time_pen + 10.0::DOUBLE * battery_pen) + 0.1::DOUBLE * distance * frequency * sqrt(CAST(n * routes AS DOUBLE)) / (1e-10 + total), 4) AS cost,
    CASE WHEN feasible AND served = customers THEN distance ELSE 1e10 END AS feasible_cost FROM c JOIN h USING (solution_id), t""")
def generalized_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cost of a solution, the routes of one customer's orders: distance, penalties for load, lateness and battery,
    and how often its attributes (node, route's place, node before and after, -1 at the depot) occur in all solutions.

    A status of N is a charging station. A leg is that to its stop, as the table has none back to the depot.
    `feasible_cost` is the distance alone, 1e10 for a solution that breaks a limit or serves a node twice.
    """
    rows = stops(spark, sf_dir)
    tasks = aggregates.tasks_for(rows.count())
    stop = F.struct(*STOP_ORDER, (F.col("status") == "N").alias("station"))
    routes = rows.withColumn("stop", stop).repartition(tasks, "route_id").groupBy("route_id").agg(F.array_sort(F.collect_list("stop")).alias("raw"), F.sum(F.col("travel_s").cast("decimal(18,3)")).alias("distance"))

    def visit(x: F.Column) -> F.Column:
        at = lambda station, other: F.when(x["station"], F.lit(station)).otherwise(other)
        n = x["packages"]
        return F.struct((x["travel_s"] / 10).alias("travel_s"), (n * 1.5).cast("double").alias("energy"), at(0.0, (n * 1000).cast("double")).alias("demand"), at(28800.0, F.lit(30000.0)).alias("tw0"),
                        at(86400.0, (31000 + n * 500.0).cast("double")).alias("tw1"), (30 + 2 * n).cast("double").alias("service_s"), x["station"].alias("station"))

    routes = replay.penalties(routes.withColumn("stops", F.transform("raw", visit)), 28800.0, 100000.0)
    home = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("route_id"), F.col("o_custkey").alias("solution_id"))
    nodes = F.transform("raw", lambda x, i: F.struct(x["station_id"].alias("node"), *(F.coalesce(F.get("raw", i + d)["station_id"], F.lit(-1)).alias(c) for c, d in (("before", -1), ("after", 1))), x["station"].alias("station")))
    routes = routes.join(home, "route_id").select("solution_id", "route_id", "distance", "load_pen", "time_pen", "battery_pen", "feasible", nodes.alias("nodes"))
    place = F.row_number().over(W.partitionBy("solution_id").orderBy("route_id")) - 1
    routes = settle(routes.repartition(tasks, "solution_id").withColumn("k", place))

    exact = lambda c, digits: F.sum(F.col(c).cast(f"decimal(18,{digits})")).cast("double").alias(c)
    size = F.size("nodes").cast("bigint")
    costs = routes.groupBy("solution_id").agg(
        F.count(F.lit(1)).alias("routes"), F.sum(size).alias("n"), F.sum("distance").cast("double").alias("distance"), exact("load_pen", 3), exact("time_pen", 4), exact("battery_pen", 3), F.bool_and("feasible").alias("feasible"))
    total = routes.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    attribute = ["node", "k", "before", "after"]
    seen = routes.select("solution_id", "k", F.inline("nodes")).repartition(tasks, *attribute).withColumn("freq", F.count(F.lit(1)).over(W.partitionBy(*attribute)))
    customer = F.when(~F.col("station"), F.col("node"))
    history = seen.repartition(tasks, "solution_id").groupBy("solution_id").agg(F.sum("freq").alias("frequency"), F.count(customer).alias("customers"), F.count_distinct(customer).alias("served"))
    c = F.col
    novelty = 0.1 * c("distance") * c("frequency") * F.sqrt((c("n") * c("routes")).cast("double")) / (1e-10 + F.lit(total))
    cost = c("distance") + (0.01 * c("load_pen") + 0.5 * c("time_pen") + 10.0 * c("battery_pen")) + novelty
    return costs.join(history, "solution_id").select(
        "solution_id", "routes", "distance", "load_pen", "time_pen", "battery_pen", "frequency", F.round(cost, 4).alias("cost"), F.when(c("feasible") & (c("served") == c("customers")), c("distance")).otherwise(1e10).alias("feasible_cost"))


@query(f"""WITH {STOPS}, {ROUTES}, g AS (SELECT route_id, pos, packages, count(*) FILTER (status = 'N') OVER (PARTITION BY route_id ORDER BY pos) AS leg FROM s),
  l AS (SELECT route_id, pos, leg, sum(packages) OVER (PARTITION BY route_id, leg ORDER BY pos)::BIGINT AS energy FROM g) SELECT route_id, max(leg) AS legs, max(energy) AS most, sum(greatest(0, energy - 60))::BIGINT AS penalty FROM l GROUP BY 1""")
def resettable_running_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy since the last station: a running count of stations names the legs, a running sum goes inside each."""
    from haulmark.sources.tables import STOP_ORDER

    legs = windows.sessions(stops(spark, sf_dir).withColumn("at", F.struct(*STOP_ORDER)), ["route_id"], "at", F.col("status") == "N")
    run = legs.withColumn("energy", F.sum("packages").over(windows.upto(["route_id", "session"], "at")))
    return run.groupBy("route_id").agg(F.max("session").alias("legs"), F.max("energy").alias("most"), F.sum(F.greatest(F.lit(0).cast("bigint"), F.col("energy") - 60)).alias("penalty"))


@query(f"""WITH {STOPS}, r AS (SELECT station_id, route_id, sum(2 * travel_s) AS trips, max(travel_s) AS edge FROM stops GROUP BY 1, 2)
  SELECT station_id, {aggregates.sql_mean('trips', 3)} AS mean_sum, round(quantile_cont(trips, 0.5), 4) AS median_sum, max(edge) AS longest FROM r GROUP BY 1""")
def repair_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = stops(spark, sf_dir).groupBy("station_id", "route_id").agg(F.sum(2 * F.col("travel_s")).alias("trips"), F.max("travel_s").alias("edge"))
    return routes.groupBy("station_id").agg(aggregates.exact_mean("trips", 3).alias("mean_sum"), F.round(F.median("trips"), 4).alias("median_sum"), F.max("edge").alias("longest"))
