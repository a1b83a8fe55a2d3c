"""Projections, filters and first-match rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.functions import classify, geo, hashing
from haulmark.operators import joins, windows
from haulmark.sources.tables import LOCATIONS, POINTS, STOPS, locations, points, stops, table

from .registry import query

#: kWh a kilometre and battery kWh of the reference vehicle.
KWH_KM, BATTERY_KWH = 0.38910505836575876, 100.0


@query(f"""WITH {LOCATIONS}, p AS (SELECT *, CASE WHEN {hashing.sql_long("CAST(location_id AS VARCHAR) || '|pool'")} % 5 = 0 THEN 'held_out' ELSE 'train' END AS pool FROM locations)
  SELECT location_id, city_id, pool FROM p WHERE pool = 'held_out'""")
def pool_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = F.when(F.pmod(hashing.stable_long(F.col("location_id"), F.lit("pool")), F.lit(5)) == 0, "held_out").otherwise("train")
    return locations(spark, sf_dir).select("location_id", "city_id", pool.alias("pool")).where("pool = 'held_out'")


@query(f"""WITH {STOPS} SELECT station_id, count(*) AS n_all, count(*) FILTER (travel_s <= 5000) AS n_time,
  count(*) FILTER (travel_s <= 5000 AND 2 * travel_s / 60 * {KWH_KM} <= {BATTERY_KWH} * 0.5 + 1e-9) AS n_energy FROM stops GROUP BY station_id""")
def funnel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    in_time = F.col("travel_s") <= 5000
    in_energy = in_time & (2 * F.col("travel_s") / 60 * KWH_KM <= BATTERY_KWH * 0.5 + 1e-9)
    return stops(spark, sf_dir).groupBy("station_id").agg(F.count(F.lit(1)).alias("n_all"), F.count_if(in_time).alias("n_time"), F.count_if(in_energy).alias("n_energy"))


@query(f"""WITH {POINTS}, d AS (SELECT kind, ceil(greatest(sqrt(x * x + y * y), 500) / 500) * 500 AS r FROM points),
  c AS (SELECT kind, radius, count(*) FILTER (r <= radius) AS n FROM d, (SELECT unnest(range(500, 5001, 500)) AS radius) GROUP BY kind, radius)
  SELECT kind, CAST(coalesce(min(radius) FILTER (n >= 15), 5000) AS BIGINT) AS radius, max(n) FILTER (n >= 15) IS NOT NULL AS enough FROM c GROUP BY kind""")
def adaptive_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least radius in steps of 500 with 15 points, else the largest; points are counted by step first."""
    step = F.ceil(F.greatest(F.hypot("x", "y"), F.lit(500.0)) / 500) * 500
    counts = points(spark, sf_dir).groupBy("kind", step.cast("bigint").alias("radius")).agg(F.count(F.lit(1)).alias("n"))
    upto = counts.withColumn("n", F.sum("n").over(windows.upto(["kind"], "radius"))).where("radius <= 5000")
    fits = F.min(F.when(F.col("n") >= 15, F.col("radius")))
    every = counts.select("kind").distinct()
    found = upto.groupBy("kind").agg(fits.alias("radius"))
    return every.join(found, "kind", "left").select("kind", F.coalesce("radius", F.lit(5000)).cast("bigint").alias("radius"), F.col("radius").isNotNull().alias("enough"))


@query(f"""WITH {STOPS} SELECT CASE WHEN status = 'R' THEN 'u0_rejected' WHEN packages < 3 THEN 'u1_few_packages' WHEN discount >= 0.09 THEN 'u2_discount' WHEN travel_s > 9000 THEN 'u3_too_far'
  WHEN day_type = 'weekend' THEN 'u4_weekend' WHEN demand_cm3 > 45000 THEN 'u5_too_large' ELSE 'usable' END AS reason, count(*) AS n, sum(packages)::BIGINT AS packages FROM stops GROUP BY 1""")
def attrition_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = classify.first_match(
        (F.col("status") == "R", "u0_rejected"), (F.col("packages") < 3, "u1_few_packages"), (F.col("discount") >= 0.09, "u2_discount"), (F.col("travel_s") > 9000, "u3_too_far"),
        (F.col("day_type") == "weekend", "u4_weekend"), (F.col("demand_cm3") > 45000, "u5_too_large"), otherwise="usable")
    return stops(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum("packages").alias("packages"))


@query("""WITH t AS (SELECT p_partkey, coalesce(CASE WHEN p_size % 4 = 0 THEN 'no' END, CASE WHEN p_type = 'PROMO' THEN 'private' END, CASE WHEN p_size > 10 THEN 'yes' END) AS access, p_size FROM part)
  SELECT p_partkey, access, CASE WHEN access = 'no' THEN 'excluded' WHEN access = 'private' THEN 'restricted' WHEN access = 'yes' THEN 'core' ELSE 'fallback' END AS tier,
  CASE WHEN access IS NULL THEN 'no_tag' ELSE 'tag_' || access END AS reason, coalesce(access <> 'no', true) AS eligible FROM t""")
def rule_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    access = F.coalesce(F.when(F.col("p_size") % 4 == 0, "no"), F.when(F.col("p_type") == "PROMO", "private"), F.when(F.col("p_size") > 10, "yes"))
    tier = classify.first_match((F.col("access") == "no", "excluded"), (F.col("access") == "private", "restricted"), (F.col("access") == "yes", "core"), otherwise="fallback")
    return table(spark, sf_dir, "part").select("p_partkey", access.alias("access")).select(
        "p_partkey", "access", tier.alias("tier"), F.coalesce(F.concat(F.lit("tag_"), F.col("access")), F.lit("no_tag")).alias("reason"), F.coalesce(F.col("access") != "no", F.lit(True)).alias("eligible"))


@query("""WITH f AS (SELECT p_partkey, regexp_matches(p_name, 'gear|plate') AS retail, p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4') AS carrier, p_type IN ('STANDARD', 'LARGE') AS dispatch,
    p_size > 25 AS explicit, p_type = 'LARGE' OR p_type = 'MEDIUM' AS warehouse, p_retailprice > 950 AS address FROM part)
  SELECT p_partkey, CASE WHEN retail THEN 'C' WHEN carrier AND dispatch THEN 'A' WHEN carrier THEN 'C' WHEN warehouse THEN 'B' ELSE 'C' END AS tier,
  CAST(CASE WHEN retail THEN 0 WHEN carrier AND dispatch THEN 6 + 3 * explicit::INT + 2 * warehouse::INT + address::INT WHEN carrier THEN 1 WHEN warehouse THEN 2 + 2 * explicit::INT + address::INT ELSE 0 END AS INTEGER) AS score FROM f""")
def evidence_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    retail, carrier, dispatch = F.col("p_name").rlike("gear|plate"), F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3", "Brand#4"), F.col("p_type").isin("STANDARD", "LARGE")
    one = lambda c: c.cast("int")
    explicit, warehouse, address = F.col("p_size") > 25, F.col("p_type").isin("LARGE", "MEDIUM"), F.col("p_retailprice") > 950
    graded = lambda tier, score: F.struct(F.lit(tier).alias("tier"), score.cast("int").alias("score"))
    found = classify.first_match(
        (retail, graded("C", F.lit(0))), (carrier & dispatch, graded("A", 6 + 3 * one(explicit) + 2 * one(warehouse) + one(address))), (carrier, graded("C", F.lit(1))),
        (warehouse, graded("B", 2 + 2 * one(explicit) + one(address))), otherwise=graded("C", F.lit(0)))
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("e")).select("p_partkey", "e.tier", "e.score")


#: A ring of our own, in metres.
RING = [(-1500.0, -1200.0), (1700.0, -900.0), (2100.0, 800.0), (300.0, 300.0), (-900.0, 1600.0)]


def _ring_sql() -> str:
    edges = [(a, b) for a, b in zip(RING, [*RING[1:], RING[0]], strict=True) if a[1] != b[1]]
    return " + ".join(f"CAST(({y1} > y) <> ({y2} > y) AND x < ({x2 - x1}) * (y - ({y1})) / ({y2 - y1}) + ({x1}) AS INTEGER)" for (x1, y1), (x2, y2) in edges)


@query(f"WITH {POINTS} SELECT point_id, kind, ({_ring_sql()}) % 2 = 1 AS inside FROM points")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("point_id", "kind", geo.inside_ring(F.col("x"), F.col("y"), RING).alias("inside"))


@query(f"""WITH {POINTS}, b AS (SELECT kind, quantile_cont(x, 0.3) AS x1, quantile_cont(x, 0.7) AS x2, quantile_cont(y, 0.3) AS y1, quantile_cont(y, 0.7) AS y2 FROM points GROUP BY kind)
  SELECT a.kind AS a, b.kind AS b FROM b a JOIN b b ON a.kind < b.kind AND a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2""")
def bbox_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of kinds that meet; one box for each kind, of which there are few."""
    edge = lambda c, q: F.percentile(c, F.lit(q))
    boxes = points(spark, sf_dir).groupBy("kind").agg(edge("x", 0.3).alias("x1"), edge("x", 0.7).alias("x2"), edge("y", 0.3).alias("y1"), edge("y", 0.7).alias("y2"))
    meet = "a.kind < b.kind AND a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2"
    return boxes.alias("a").join(boxes.alias("b"), F.expr(meet)).select(F.col("a.kind").alias("a"), F.col("b.kind").alias("b"))


@query(f"WITH {LOCATIONS} SELECT location_id, kind FROM locations WHERE starts_with(kind, 'HOUSE') OR starts_with(kind, 'FURN')")
def prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locations(spark, sf_dir).where(F.col("kind").startswith("HOUSE") | F.col("kind").startswith("FURN")).select("location_id", "kind")


@query(f"""WITH {STOPS}, g AS (SELECT *, CASE WHEN packages > 40 THEN 'high' WHEN packages > 20 THEN 'medium' END AS confidence FROM stops)
  SELECT station_id, count(*) FILTER (coalesce(confidence = 'high', false) OR discount <= 0.02) AS n_confident, count(*) FILTER (confidence IS NOT NULL AND status <> 'R') AS n_usable,
  count(*) FILTER (coalesce(confidence = 'high', false) AND status = 'N' AND travel_s < 8000) AS n_verified FROM g GROUP BY station_id""")
def evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stops(spark, sf_dir).withColumn("confidence", F.when(F.col("packages") > 40, "high").when(F.col("packages") > 20, "medium"))
    high = F.coalesce(F.col("confidence") == "high", F.lit(False))
    return rows.groupBy("station_id").agg(
        F.count_if(high | (F.col("discount") <= 0.02)).alias("n_confident"), F.count_if(F.col("confidence").isNotNull() & (F.col("status") != "R")).alias("n_usable"),
        F.count_if(high & (F.col("status") == "N") & (F.col("travel_s") < 8000)).alias("n_verified"))


@query("""WITH wanted AS (SELECT DISTINCT l_partkey + CASE WHEN l_partkey % 10 = 0 THEN 1000000000 ELSE 0 END AS id FROM lineitem)
  SELECT id, CASE WHEN id IN (SELECT p_partkey FROM part) THEN 'found' ELSE 'missing' END AS status FROM wanted""")
def semi_anti_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") + F.when(F.col("l_partkey") % 10 == 0, 1000000000).otherwise(0)).alias("id")).distinct()
    have = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return wanted.join(have, "id", "left_semi").withColumn("status", F.lit("found")).union(wanted.join(have, "id", "left_anti").withColumn("status", F.lit("missing")))


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1) % 6 AS shard FROM orders")
def stride_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with the shard that takes each sixth row of the sorted plan."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (-F.col("o_totalprice")).alias("rank"))
    return windows.global_position(rows, ["rank", "o_orderkey"]).select("o_orderkey", F.pmod("position", F.lit(6)).alias("shard"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'reversed' WHEN event_type IN ('click', 'view') THEN 'forward' ELSE 'both' END AS direction,
  CASE WHEN value > 200 THEN 3 WHEN value > 100 THEN 2 WHEN value > 50 THEN 1 ELSE 0 END AS level, CASE WHEN value < 10 THEN NULL ELSE round(value, 2) END AS checked FROM events""")
def case_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id", classify.first_match((kind == "error", "reversed"), (kind.isin("click", "view"), "forward"), otherwise="both").alias("direction"),
        classify.first_match((value > 200, 3), (value > 100, 2), (value > 50, 1), otherwise=0).alias("level"), F.when(value >= 10, F.round(value, 2)).alias("checked"))


@query(f"""WITH {STOPS}, t AS (SELECT route_id, stop_no, part_id, station_id, CASE WHEN packages % 3 = 0 THEN packages + 20 END AS directional, CASE WHEN packages % 2 = 0 THEN packages + 10 END AS generic,
    CASE WHEN status = 'N' THEN 30 END AS mapped FROM stops)
  SELECT route_id, stop_no, part_id, station_id, CAST(coalesce(directional, generic, mapped, 25) AS BIGINT) AS kph,
  CASE WHEN directional IS NOT NULL THEN 'directional' WHEN generic IS NOT NULL THEN 'generic' WHEN mapped IS NOT NULL THEN 'mapped' ELSE 'imputed' END AS provenance FROM t""")
def coalesce_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("packages")
    rows = stops(spark, sf_dir).select(
        "route_id", "stop_no", "part_id", "station_id", F.when(n % 3 == 0, n + 20).alias("directional"), F.when(n % 2 == 0, n + 10).alias("generic"), F.when(F.col("status") == "N", F.lit(30)).alias("mapped"))
    named = ["directional", "generic", "mapped"]
    source = F.coalesce(*(F.when(F.col(c).isNotNull(), c) for c in named), F.lit("imputed"))
    return rows.select("route_id", "stop_no", "part_id", "station_id", F.coalesce(*named, F.lit(25)).cast("bigint").alias("kph"), source.alias("provenance"))


@query(f"""WITH {LOCATIONS}, r AS (SELECT location_id, balance >= 0 AS geometry_ok, units % 4 <> 0 AS anchor_ok, city_id % 5 <> 2 AS trip_ok, units > 55 AS candidate FROM locations)
  SELECT location_id, concat_ws(';', CASE WHEN NOT geometry_ok THEN 'geometry' END, CASE WHEN NOT anchor_ok THEN 'anchor' END, CASE WHEN NOT trip_ok THEN 'round_trip' END, CASE WHEN candidate THEN 'g2' END) AS reasons,
  geometry_ok AND anchor_ok AND trip_ok AS eligible, NOT candidate AND anchor_ok AS default_eligible FROM r""")
def quarantine_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = locations(spark, sf_dir).select(
        "location_id", (F.col("balance") >= 0).alias("g"), (F.col("units") % 4 != 0).alias("a"), (F.col("city_id") % 5 != 2).alias("t"), (F.col("units") > 55).alias("c"))
    g, a, t, c = (F.col(x) for x in "gatc")
    return rows.select("location_id", classify.reasons((~g, "geometry"), (~a, "anchor"), (~t, "round_trip"), (c, "g2")).alias("reasons"), (g & a & t).alias("eligible"), (~c & a).alias("default_eligible"))


@query(f"""WITH {LOCATIONS}, r AS (SELECT location_id, candidate_eligible AS restricted, kind = 'MACHINERY' AS unsupported, balance > -500 AS coord_ok, units % 6 <> 0 AS road_ok FROM locations)
  SELECT location_id, restricted IS DISTINCT FROM true AND NOT unsupported AND coord_ok AND road_ok AS candidate,
  CASE WHEN restricted THEN 'restricted' WHEN unsupported THEN 'mode' WHEN NOT coord_ok THEN 'coordinates' WHEN NOT road_ok THEN 'road' END AS blocker FROM r""")
def eligibility_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    restricted, unsupported, coord_ok, road_ok = F.col("candidate_eligible"), F.col("kind") == "MACHINERY", F.col("balance") > -500, F.col("units") % 6 != 0
    candidate = ~restricted.eqNullSafe(F.lit(True)) & ~unsupported & coord_ok & road_ok
    blocker = classify.first_blocker((restricted, "restricted"), (unsupported, "mode"), (~coord_ok, "coordinates"), (~road_ok, "road"))
    return locations(spark, sf_dir).select("location_id", candidate.alias("candidate"), blocker.alias("blocker"))


@query(f"""WITH {POINTS}, a AS (SELECT point_id, x, y, point_id % 13 AS area FROM points WHERE kind < 5), b AS (SELECT point_id AS other, x AS x2, y AS y2, point_id % 11 AS area2 FROM points WHERE kind >= 5),
  n AS (SELECT point_id, arg_min(other, (sqrt((x - x2) ** 2 + (y - y2) ** 2), other)) AS other FROM a, b GROUP BY point_id),
  d AS (SELECT a.point_id, n.other, round(sqrt((x - x2) ** 2 + (y - y2) ** 2), 6) AS distance, area, area2 FROM a JOIN n USING (point_id) JOIN b ON b.other = n.other)
  SELECT point_id, other, distance, CASE WHEN distance <= 300 AND least(area, area2) > 0 AND greatest(area, area2)::DOUBLE / least(area, area2) <= 4 THEN 'G2' ELSE 'unmatched' END AS tier FROM d""")
def match_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest other row, promoted if it is near and of like area; an area of 0 is like none."""
    every = points(spark, sf_dir).select(F.col("point_id").alias("id"), "kind", "x", "y")
    found = joins.nearest_join(every.where("kind < 5"), every.where("kind >= 5"), 300.0)
    a, b = F.pmod("id", F.lit(13)), F.pmod("other", F.lit(11))
    alike = (F.least(a, b) > 0) & (F.greatest(a, b) / F.least(a, b) <= 4)
    return found.select(F.col("id").alias("point_id"), "other", F.round("distance", 6).alias("distance"), F.when((F.round("distance", 6) <= 300) & F.coalesce(alike, F.lit(False)), "G2").otherwise("unmatched").alias("tier"))
