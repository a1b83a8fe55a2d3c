"""Replay, masks, validation, journals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.functions import text
from haulmark.operators import graphs, journal, quality, replay
from haulmark.sources.tables import LINKS, LOCATIONS, STOP_ORDER, STOPS, locations, roads, stops, table

from .registry import query

ROUTES = "s AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY stop_no, part_id, station_id, packages, travel_s, ship_date) AS pos FROM stops)"


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("packages")
    stop = F.struct(
        F.struct(*STOP_ORDER).alias("at"), (F.col("travel_s") / 10).alias("travel_s"), (n * 1.5).cast("double").alias("energy"), n.cast("double").alias("demand"), F.lit(30000.0).alias("tw0"),
        (31000 + n * 500.0).cast("double").alias("tw1"), "service_s", (F.col("status") == "N").alias("station"))
    return stops(spark, sf_dir).groupBy("route_id").agg(F.array_sort(F.collect_list(stop)).alias("stops"))


@query(f"""WITH RECURSIVE {STOPS}, {ROUTES}, x AS MATERIALIZED (SELECT route_id, pos, travel_s / 10 AS travel, packages * 1.5::DOUBLE AS energy, packages AS demand, 31000 + packages * 500.0::DOUBLE AS tw1, service_s, status = 'N' AS station FROM s),
  r(route_id, pos, t, battery, load, late, empty, over) AS (SELECT DISTINCT route_id, 0::BIGINT, 28800.0::DOUBLE, 100.0::DOUBLE, 120.0::DOUBLE, 0, 0, 0 FROM x
    UNION ALL SELECT x.route_id, x.pos, greatest(t + travel, 30000.0::DOUBLE) + service_s + CASE WHEN station THEN (100.0::DOUBLE - (battery - energy)) / 100.0::DOUBLE * 3600 ELSE 0.0::DOUBLE END, CASE WHEN station THEN 100.0::DOUBLE ELSE battery - energy END, load - demand,
      late + (greatest(t + travel, 30000.0::DOUBLE) > tw1 + 1e-5)::INT, empty + (battery - energy < -1e-5)::INT, over + (load - demand < -1e-5)::INT FROM r JOIN x ON x.route_id = r.route_id AND x.pos = r.pos + 1)
  SELECT route_id, pos AS n, t AS end_s, battery, load, late, empty, over FROM (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY pos DESC) AS last FROM r) WHERE last = 1""")
def route_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.replayed(_routes(spark, sf_dir), 28800.0, 120.0)


@query()
def udtf_route_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same replay stop by stop, for those who want every step: the fold of `route_replay` keeps its states, and a
    table function gives a row for each."""
    return replay.steps(_routes(spark, sf_dir), 28800.0)


@query(f"""WITH {LINKS}, n AS (SELECT n_nationkey AS id, n_nationkey % 4 = 0 AS station, n_nationkey % 7 + 1 AS demand FROM nation), state AS (SELECT id AS u, 40 - id AS battery, 3 + id % 6 AS load, 28800 + id * 2000 AS t FROM n),
  home AS (SELECT u AS v FROM links WHERE v = 0 AND w <= 900), via AS (SELECT DISTINCT l.u AS v FROM links l JOIN n ON l.v = n.id AND n.station JOIN home h ON h.v = l.v WHERE l.w <= 600)
  SELECT l.u, l.v, NOT d.station AND battery * 30 >= w AND load >= demand AND t + w * 10 <= 80000 AND (l.v IN (SELECT v FROM home) OR l.v IN (SELECT v FROM via)) AS allowed FROM links l JOIN state USING (u) JOIN n d ON l.v = d.id""")
def action_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which customers each state may go to: battery, load, time, and a way home, direct or by a station."""
    links = graphs.settle(roads(spark, sf_dir).groupBy("u", "v").agg(F.min("length_m").alias("w")))
    home = links.where("v = 0 AND w <= 900").select(F.col("u").alias("v")).withColumn("direct", F.lit(True))
    station = links.where("v % 4 = 0 AND w <= 600").join(home, "v", "left_semi").select(F.col("u").alias("v")).distinct().withColumn("by_station", F.lit(True))
    u, v, w = F.col("u"), F.col("v"), F.col("w")
    back = F.col("direct").isNotNull() | F.col("by_station").isNotNull()
    ok = (v % 4 != 0) & ((40 - u) * 30 >= w) & (3 + u % 6 >= v % 7 + 1) & (28800 + u * 2000 + w * 10 <= 80000) & back
    return links.join(home, "v", "left").join(station, "v", "left").select("u", "v", ok.alias("allowed"))


@query("""WITH l AS (SELECT count(*) FILTER (l_quantity <= 0) AS a, count(*) FILTER (l_discount < 0 OR l_discount > 0.1) AS b, count(*) FILTER (isnan(l_extendedprice)) AS c, count(*) FILTER (l_shipdate IS NULL) AS d, count(*) FILTER (l_linenumber > 5) AS e, count(*) FILTER (l_tax > 0.07) AS f FROM lineitem)
  SELECT 'quantity_positive' AS rule, a AS violations FROM l UNION ALL SELECT 'discount_range', b FROM l UNION ALL SELECT 'price_finite', c FROM l UNION ALL SELECT 'date_present', d FROM l UNION ALL SELECT 'line_bound', e FROM l UNION ALL SELECT 'tax_bound', f FROM l""")
def dq_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return quality.violations(table(spark, sf_dir, "lineitem"), {
        "quantity_positive": c("l_quantity") > 0, "discount_range": c("l_discount").between(0, 0.1), "price_finite": ~F.isnan("l_extendedprice"), "date_present": c("l_shipdate").isNotNull(),
        "line_bound": c("l_linenumber") <= 5, "tax_bound": c("l_tax") <= 0.07})


#: Columns of a core table of locations, as SQL that both engines read; some rows break each of the rules below.
GATE_COLUMNS = [
    {
        "id": "c_custkey", "city_id": "c_nationkey", "units": "1 + c_custkey % 60", "balance": "c_acctbal", "occupancy": "CASE c_custkey % 9 WHEN 0 THEN 'RES2' WHEN 1 THEN 'RES3A' WHEN 2 THEN 'COM1' WHEN 3 THEN 'RES5' ELSE 'RES1' END",
        "geometry_tier": "CASE c_custkey % 8 WHEN 0 THEN 'G2_near_area' WHEN 1 THEN 'G3_far' ELSE 'G1_containment' END", "unit_tier": "CASE WHEN c_custkey % 11 = 0 THEN 'U4_guess' WHEN c_custkey % 2 = 0 THEN 'U1_record' ELSE 'U2_model' END",
        "match_distance": "CASE WHEN c_custkey % 29 = 0 THEN NULL WHEN c_custkey % 8 = 0 THEN c_custkey % 14 WHEN c_custkey % 31 = 0 THEN 1 ELSE 0 END", "area_factor": "1 + c_custkey % 6",
        "road_distance": "CASE WHEN c_custkey % 37 = 0 THEN NULL ELSE c_custkey % 130 - 1 END", "threshold": "CASE WHEN c_custkey % 41 = 0 THEN 90 ELSE 100 END", "anchor": "CASE c_custkey % 7 WHEN 0 THEN 'node' WHEN 1 THEN 'guess' ELSE 'edge' END",
        "edge_u": "CASE WHEN c_custkey % 43 <> 0 THEN c_custkey % 25 END", "edge_v": "CASE WHEN c_custkey % 47 <> 0 THEN (c_custkey + 1) % 25 END", "edge_key": "CASE WHEN c_custkey % 53 <> 0 THEN 0 END", "active": "c_custkey % 59 = 0",
        "geometry_ok": "CASE WHEN c_custkey % 61 <> 0 THEN c_custkey % 8 <> 1 END", "access_ok": "c_custkey % 10 <> 9", "building": "CASE WHEN c_custkey % 67 <> 0 THEN c_custkey * 3 END",
        "quarantine": "CASE WHEN c_custkey % 71 = 0 THEN 'no footprint' WHEN c_custkey % 3 = 0 THEN '' END", "type_evidence": "CASE WHEN c_custkey % 73 = 0 THEN 'Default value' ELSE 'record' END", "unit_evidence": "CASE WHEN c_custkey % 79 = 0 THEN 'city default' ELSE 'model' END",
        "segment": "c_mktsegment", "x": "c_custkey % 100", "y": "c_custkey % 83",
    },
    {
        "lower": "CASE WHEN id % 13 = 0 THEN units + 1 ELSE greatest(1, units - id % 3) END", "upper": "CASE WHEN id % 17 = 0 THEN NULL WHEN id % 19 = 0 THEN units - 1 ELSE units + id % 5 END",
        "band": "CASE WHEN id % 23 = 0 THEN 'units_99' WHEN units = 1 THEN 'units_1' WHEN units <= 4 THEN 'units_2_4' WHEN units <= 19 THEN 'units_5_19' WHEN units <= 49 THEN 'units_20_49' ELSE 'units_50_plus' END",
        "kind": "CASE WHEN id % 83 = 0 THEN 'villa' WHEN occupancy = 'RES2' THEN 'manufactured' WHEN units = 1 THEN 'single' WHEN units <= 4 THEN 'small' ELSE 'large' END",
        "tier": "CASE WHEN id % 89 = 0 THEN 'G0_U0' ELSE substr(geometry_tier, 1, 2) || '_' || substr(unit_tier, 1, 2) END", "method": "CASE WHEN geometry_tier = 'G2_near_area' THEN 'near' WHEN id % 97 = 0 THEN 'by hand' ELSE 'inside' END",
        "released": "CASE WHEN id % 101 = 0 THEN true ELSE coalesce(geometry_ok, false) AND access_ok END",
    },
]
#: What every row has to meet, then what released rows have to; a rule that is null for a row holds.
ROW_RULES = {
    "inactive": "NOT active", "inside_boundary": "x BETWEEN 0 AND 97 AND y BETWEEN 0 AND 80", "release_is_geometry_and_access": "released = (coalesce(geometry_ok, false) AND access_ok)",
}
CORE_RULES = {
    "kind_known": "kind IN ('manufactured', 'single', 'small', 'large')", "band_known": "band IN ('units_1', 'units_2_4', 'units_5_19', 'units_20_49', 'units_50_plus')",
    "tier_known": "tier IN ('G1_U1', 'G1_U2', 'G2_U1', 'G2_U2')", "geometry_tier_known": "geometry_tier IN ('G1_containment', 'G2_near_area')", "unit_tier_known": "unit_tier IN ('U1_record', 'U2_model')",
    "method_known": "method IN ('inside', 'near')", "distance_there": "match_distance IS NOT NULL AND match_distance >= 0", "inside_is_exact": "geometry_tier <> 'G1_containment' OR (method = 'inside' AND match_distance = 0)",
    "near_is_near": "geometry_tier <> 'G2_near_area' OR (method = 'near' AND match_distance <= 10 AND area_factor <= 4)", "tier_combines": "tier = substr(geometry_tier, 1, 2) || '_' || substr(unit_tier, 1, 2)", "building_there": "building IS NOT NULL",
    "not_quarantined": "coalesce(trim(quarantine), '') = ''", "units_positive": "units >= 1", "lower_bounds": "lower >= 1 AND lower <= units", "upper_above_lower": "upper >= lower", "upper_bounds": "upper >= units",
    "band_of_units": "band = CASE WHEN units = 1 THEN 'units_1' WHEN units <= 4 THEN 'units_2_4' WHEN units <= 19 THEN 'units_5_19' WHEN units <= 49 THEN 'units_20_49' ELSE 'units_50_plus' END",
    "kind_of_units": "kind = CASE WHEN occupancy = 'RES2' THEN 'manufactured' WHEN units = 1 THEN 'single' WHEN units <= 4 THEN 'small' ELSE 'large' END", "type_not_default": "lower(type_evidence) NOT LIKE '%default%'",
    "units_not_default": "lower(unit_evidence) NOT LIKE '%default%'", "residential": "substr(occupancy, 1, 4) IN ('RES1', 'RES2', 'RES3')", "not_institutional": "substr(occupancy, 1, 4) NOT IN ('RES4', 'RES5', 'RES6')", "anchor_known": "anchor IN ('edge', 'node')",
    "edge_whole": "edge_u IS NOT NULL AND edge_v IS NOT NULL AND edge_key IS NOT NULL", "road_there": "road_distance IS NOT NULL AND road_distance >= 0", "road_in_reach": "road_distance <= 100", "threshold_frozen": "threshold = 100",
}
#: The least shares of units that are matched and reached, in a city and in each of its kinds.
SHARES = {"matched": ("geometry_ok", "true", 0.8), "reached": ("released", "coalesce(geometry_ok, false)", 0.88)}
GATE = f"core AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in GATE_COLUMNS[1].items())} FROM (SELECT {', '.join(f'{e} AS {n}' for n, e in GATE_COLUMNS[0].items())} FROM customer))"


@query(f"""WITH {GATE}, v AS (SELECT city_id, {", ".join(f"count(*) FILTER (NOT ({rule})) AS {name}" for name, rule in ROW_RULES.items())}, {", ".join(f"count(*) FILTER (released AND NOT ({rule})) AS {name}" for name, rule in CORE_RULES.items())}, count(*) - count(DISTINCT id) AS id_unique, CAST(count(*) FILTER (released) = 0 AS BIGINT) AS core_there,
    {", ".join(f"CAST(coalesce(sum(units) FILTER ({test} AND {among}), 0) < {least} * sum(units) FILTER ({among}) AS BIGINT) AS {name}" for name, (test, among, least) in SHARES.items())} FROM core GROUP BY 1),
  k AS (SELECT city_id, {", ".join(f"count(*) FILTER ({name}) AS {name}_by_kind" for name in SHARES)} FROM (SELECT city_id, kind, {", ".join(f"coalesce(sum(units) FILTER ({test} AND {among}), 0) < {least} * sum(units) FILTER ({among}) AS {name}" for name, (test, among, least) in SHARES.items())} FROM core GROUP BY 1, 2) GROUP BY 1)
  SELECT city_id, rule, violations FROM (SELECT * FROM v JOIN k USING (city_id)) UNPIVOT (violations FOR rule IN ({", ".join([*ROW_RULES, *CORE_RULES, "id_unique", "core_there", *SHARES, *(f"{n}_by_kind" for n in SHARES)])}))""")
def contract_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate of a city's locations: 36 rules, as counts of rows that break them and of shares that are too low.

    All rules of rows are one aggregate; shares by kind are one over the kinds' sums.
    """
    rows = table(spark, sf_dir, "customer")
    for columns in GATE_COLUMNS:
        own = [] if columns is GATE_COLUMNS[0] else ["*"]
        rows = rows.select(*own, *(F.expr(e).alias(n) for n, e in columns.items()))
    rules = {n: F.expr(r) for n, r in ROW_RULES.items()} | {n: ~F.col("released") | F.expr(r) for n, r in CORE_RULES.items()}
    low = [(F.coalesce(F.sum(F.when(F.expr(f"({test}) AND ({among})"), F.col("units"))), F.lit(0)) < F.sum(F.when(F.expr(among), F.col("units"))) * least).alias(n) for n, (test, among, least) in SHARES.items()]
    by_id = rows.groupBy("city_id", "id").agg(F.count(F.lit(1)).alias("n"), F.count_if("released").alias("released"))
    ids = by_id.groupBy("city_id").agg((F.sum("n") - F.count(F.lit(1))).alias("id_unique"), (F.sum("released") == 0).cast("bigint").alias("core_there"))
    city = rows.groupBy("city_id").agg(*low).select("city_id", *(F.coalesce(F.col(n).cast("bigint"), F.lit(0)).alias(n) for n in SHARES))
    kinds = rows.groupBy("city_id", "kind").agg(*low).groupBy("city_id").agg(*(F.count_if(F.col(n)).alias(f"{n}_by_kind") for n in SHARES))
    wide = ids.join(city, "city_id").join(kinds, "city_id")
    more = wide.unpivot("city_id", [c for c in wide.columns if c != "city_id"], "rule", "violations")
    return quality.violations(rows, rules, ["city_id"]).union(more)


@query("""WITH a AS (SELECT l_suppkey, l_partkey, round(sum(l_extendedprice), 2) AS v FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2), b AS (SELECT l_suppkey, l_partkey, round(sum(l_extendedprice), 2) AS v FROM lineitem WHERE l_linestatus = 'F' OR l_returnflag <> 'A' GROUP BY 1, 2)
  SELECT l_suppkey, count(*) FILTER (a.v IS NOT NULL AND b.v IS NOT NULL) AS n_both, count(*) FILTER (b.v IS NULL) AS n_missing, count(*) FILTER (a.v IS NULL) AS n_extra, count(*) FILTER (abs(a.v - b.v) <= 1e-6) AS n_close, round(max(abs(a.v - b.v)), 2) AS max_error FROM a FULL OUTER JOIN b USING (l_suppkey, l_partkey) GROUP BY 1""")
def recompute_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    sums = lambda test: items.where(test).groupBy("l_suppkey", "l_partkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("v"))
    found = quality.compared(sums("l_returnflag <> 'R'"), sums("l_linestatus = 'F' OR l_returnflag <> 'A'"), ["l_suppkey", "l_partkey"], "v", 1e-6)
    return found.withColumn("max_error", F.round("max_error", 2))


@query("""SELECT source AS city, count(*) AS n, bool_and(quality = 1) AS quality_gate, bool_and(toxic = 0) AS toxic_gate, bool_and(n_chars > 0) AS size_gate, count(*) FILTER (quality = 0) AS blockers, bool_and(quality = 1) AND bool_and(toxic = 0) AND bool_and(n_chars > 0) AS release FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def gate_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    gates = rows.groupBy(F.col("source").alias("city")).agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.col("quality") == 1).alias("quality_gate"), F.bool_and(F.col("toxic") == 0).alias("toxic_gate"), F.bool_and(F.col("n_chars") > 0).alias("size_gate"), F.count_if(F.col("quality") == 0).alias("blockers"))
    return gates.withColumn("release", F.col("quality_gate") & F.col("toxic_gate") & F.col("size_gate"))


@query(f"""WITH {LOCATIONS}, l AS (SELECT 'locations' AS layer, count(*) AS n, count(*) FILTER (release_eligible) AS released FROM locations UNION ALL SELECT 'stations', count(*), count(*) FILTER (s_acctbal > 0) FROM supplier UNION ALL SELECT 'routes', count(*), count(*) FILTER (o_orderstatus <> 'P') FROM orders)
  SELECT layer, n, released, released > 0.5 * n AS gate, CASE WHEN released <= 0.5 * n THEN 'too_few_released' END AS blocker FROM l""")
def layer_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    def layer(df: DataFrame, name: str, gate: F.Column) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(gate).alias("released")).select(F.lit(name).alias("layer"), "n", "released")

    every = layer(locations(spark, sf_dir), "locations", F.col("release_eligible")).union(layer(table(spark, sf_dir, "supplier"), "stations", F.col("s_acctbal") > 0))
    every = every.union(layer(table(spark, sf_dir, "orders"), "routes", F.col("o_orderstatus") != "P"))
    gate = F.col("released") > 0.5 * F.col("n")
    return every.select("*", gate.alias("gate"), F.when(~gate, "too_few_released").alias("blocker"))


@query("""WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '../' || page_id WHEN 1 THEN 'data//' || page_id WHEN 2 THEN 'data/' || page_id || '/x.html' ELSE regexp_replace(url, '^https?:/', '') END AS path FROM pages)
  SELECT page_id, path, len(list_filter(string_split(path, '/'), lambda x: x IN ('', '.', '..'))) > 0 OR contains(path, '\\') AS is_unsafe FROM p""".replace("\\\\", "\\"))
def path_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, name = F.pmod("page_id", F.lit(4)), F.col("page_id").cast("string")
    path = F.when(key == 0, F.concat(F.lit("../"), name)).when(key == 1, F.concat(F.lit("data//"), name)).when(key == 2, F.concat(F.lit("data/"), name, F.lit("/x.html"))).otherwise(F.regexp_replace("url", "^https?:/", ""))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), text.unsafe_path(path).alias("is_unsafe"))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders), b AS (SELECT c_custkey AS id FROM customer) SELECT count(*) FILTER (b.id IS NULL) AS missing, count(*) FILTER (a.id IS NULL) AS extra, count(*) FILTER (a.id IS NULL OR b.id IS NULL) = 0 AS equal FROM a FULL OUTER JOIN b USING (id)""")
def set_equality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.set_equality(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), "id")


@query("""WITH d AS (SELECT DISTINCT o_custkey AS id, o_orderpriority AS contract FROM orders WHERE o_orderstatus IN ('F', 'O')), t AS (SELECT c_custkey AS id, p AS contract FROM customer, (SELECT DISTINCT o_orderpriority AS p FROM orders))
  SELECT id, contract FROM t WHERE (id, contract) NOT IN (SELECT (id, contract) FROM d)""")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks (customer by contract) without a terminal record of the same contract."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("contract"), F.col("o_orderstatus").alias("status"))
    contracts = orders.agg(F.collect_set("contract").alias("c"))  # five of them
    tasks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(1).alias("_one")).join(F.broadcast(contracts.withColumn("_one", F.lit(1))), "_one").select("id", F.explode("c").alias("contract"))
    return journal.pending(tasks, orders, ["id", "contract"], ["F", "O"])


@query("""WITH n AS (SELECT o_custkey AS id, max(o_totalprice) AS value FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) SELECT c_custkey AS id, c_acctbal AS value FROM customer WHERE c_custkey NOT IN (SELECT id FROM n) UNION ALL SELECT id, value FROM n""")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("value"))
    return journal.upsert(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value")), new, ["id"])


@query("""SELECT window_start AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM (SELECT *, time_bucket(INTERVAL 1 DAY, ts) AS window_start FROM events) GROUP BY 1, 2""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the tumbling windows of `streaming.events`; an extension."""
    from haulmark.streaming import events

    return events.tumbling(table(spark, sf_dir, "events"))
