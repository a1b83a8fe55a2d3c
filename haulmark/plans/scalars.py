"""Scalar functions: text, parsing, hashing, time, geometry, classification."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from haulmark.functions import classify, geo, hashing, text, time
from haulmark.sources.tables import LOCATIONS, LONLAT, POINTS, STOP_ORDER, STOPS, locations, points, stops, table

from .registry import query


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g')) AS normal, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS packed FROM documents")
def fn_normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize(F.col("text")).alias("normal"), text.alnum(F.col("text")).alias("packed"))


@query("""SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) || '|' || trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) || '|' || lower(trim(r_name)) || '|' || substr(lpad(CAST(c_custkey * 37 AS VARCHAR), 9, '0'), 1, 5) AS akey
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def fn_address_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    zipcode = F.lpad((F.col("c_custkey") * 37).cast("string"), 9, "0")
    return rows.select("c_custkey", text.address_key(F.col("c_name"), F.col("n_name"), F.col("r_name"), zipcode).alias("akey"))


@query("SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages")
def fn_slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.slug(F.col("url")).alias("slug"))


@query("""WITH t AS (SELECT p_partkey, p_size AS s, p_size::VARCHAR AS v, (p_size + 3)::VARCHAR AS w, p_size % 8 AS k FROM part)
  SELECT p_partkey, CASE k WHEN 0 THEN v WHEN 1 THEN v || ' MPH' WHEN 2 THEN v || ' mph; ' || w WHEN 3 THEN 'none' WHEN 4 THEN 'signals;' || v || 'km/h' WHEN 5 THEN w || ';0 mph' WHEN 6 THEN '[' || chr(39) || v || ' mph' || chr(39) || ', ' || chr(39) || w || '.5' || chr(39) || ']' END AS tag,
    round(CASE k WHEN 0 THEN s::DOUBLE WHEN 1 THEN s * 1.609344::DOUBLE WHEN 2 THEN least(s * 1.609344::DOUBLE, (s + 3)::DOUBLE) WHEN 6 THEN least(s * 1.609344::DOUBLE, s + 3.5::DOUBLE) END, 6) AS kph,
    CASE k WHEN 0 THEN 'parsed_single' WHEN 1 THEN 'parsed_single' WHEN 2 THEN 'parsed_multivalue_conservative_min' WHEN 6 THEN 'parsed_multivalue_conservative_min' WHEN 5 THEN 'invalid_numeric' WHEN 7 THEN 'missing' ELSE 'non_numeric_or_conditional' END AS status FROM t""")
def fn_parse_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of eight kinds: single, in miles, several, none, conditional, zero, a list, missing."""
    v, w = F.col("p_size").cast("string"), (F.col("p_size") + 3).cast("string")
    kinds = [v, F.concat(v, F.lit(" MPH")), F.concat(v, F.lit(" mph; "), w), F.lit("none"), F.concat(F.lit("signals;"), v, F.lit("km/h")), F.concat(w, F.lit(";0 mph")), F.concat(F.lit("['"), v, F.lit(" mph', '"), w, F.lit(".5']"))]
    tag = F.get(F.array(*kinds), (F.col("p_size") % 8).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", tag.alias("tag"))
    speed = text.speed_tag(F.col("tag"))
    return rows.select("p_partkey", "tag", F.round(speed["kph"], 6).alias("kph"), speed["status"].alias("status"))


@query("""SELECT p_partkey, string_split(p_name, ' ')[1] AS first, len(string_split(p_name, ' ')) AS n, array_to_string(string_split(p_name, ' '), '+') AS joined FROM part""")
def fn_multivalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = F.concat(F.lit("['"), F.replace(F.col("p_name"), F.lit(" "), F.lit("', '")), F.lit("']"))
    tag = F.when(F.pmod("p_partkey", F.lit(2)) == 0, quoted).otherwise(F.replace(F.col("p_name"), F.lit(" "), F.lit(";")))
    rows = table(spark, sf_dir, "part").select("p_partkey", text.multivalue(tag).alias("v"))
    return rows.select("p_partkey", F.get("v", F.lit(0)).alias("first"), F.size("v").cast("bigint").alias("n"), F.array_join("v", "+").alias("joined"))


@query("SELECT l_orderkey AS route_id, string_agg(DISTINCT l_returnflag || l_linestatus, '|' ORDER BY l_returnflag || l_linestatus) AS tags FROM lineitem GROUP BY 1")
def fn_canonical_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("route_id")).agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("v"))
    return rows.select("route_id", text.canonical(F.col("v")).alias("tags"))


@query("""WITH t AS (SELECT p_partkey, list_distinct(regexp_extract_all(p_brand || CASE WHEN p_size % 3 = 0 THEN ' 7' ELSE '' END, '[0-9]+')) AS a, list_distinct(regexp_extract_all(CASE WHEN p_size % 4 = 0 THEN '' ELSE 'I-' || p_size % 20 || ' US ' || 7 END, '[0-9]+')) AS b FROM part)
  SELECT p_partkey, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 'unknown' WHEN list_has_any(a, b) THEN 'exact' ELSE 'conflict' END AS relation FROM t""")
def fn_route_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.concat("p_brand", F.when(F.col("p_size") % 3 == 0, " 7").otherwise(""))
    b = F.when(F.col("p_size") % 4 == 0, "").otherwise(F.concat(F.lit("I-"), (F.col("p_size") % 20).cast("string"), F.lit(" US 7")))
    return table(spark, sf_dir, "part").select("p_partkey", text.route_relation(text.number_tokens(a), text.number_tokens(b)).alias("relation"))


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(upper(p_name), ' '))), ' ') AS tokens, list_contains(string_split(upper(p_name), ' '), 'WIDGET') AS is_widget, list_contains(string_split(upper(p_name), ' '), 'SMALL') AS is_small FROM part""")
def fn_token_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", text.connector_tokens(F.replace(F.col("p_name"), F.lit(" "), F.lit(", "))).alias("t"))
    return rows.select("p_partkey", F.array_join("t", " ").alias("tokens"), F.array_contains("t", "WIDGET").alias("is_widget"), F.array_contains("t", "SMALL").alias("is_small"))


@query("""SELECT event_id, CASE WHEN lower(trim(w)) IN ('1', 'true', 'yes', 'y') THEN true WHEN lower(trim(w)) IN ('0', 'false', 'no', 'n') THEN false END AS flag
  FROM (SELECT event_id, CASE event_type WHEN 'view' THEN ' Yes' WHEN 'click' THEN 'NO ' WHEN 'error' THEN 'maybe' WHEN 'signup' THEN '1' END AS w FROM events)""")
def fn_bool_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    word = F.when(kind == "view", " Yes").when(kind == "click", "NO ").when(kind == "error", "maybe").when(kind == "signup", "1")
    return table(spark, sf_dir, "events").select("event_id", text.tri_bool(word).alias("flag"))


@query("SELECT c_custkey, 'la_' || substr(sha1(c_custkey || '|' || c_name), 1, 16) AS surrogate, 'proj_' || substr(sha1(c_custkey || '|' || printf('%.9f', c_acctbal)), 1, 20) AS projection_id FROM customer")
def fn_surrogate_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", hashing.surrogate("la_", 16, key, F.col("c_name")).alias("surrogate"), hashing.surrogate("proj_", 20, key, F.format_string("%.9f", "c_acctbal")).alias("projection_id"))


@query(f"SELECT o_orderkey, {hashing.sql_long('CAST(o_orderkey AS VARCHAR) || $$|$$ || o_orderpriority')} AS seed, {hashing.sql_unit('CAST(o_orderkey AS VARCHAR)')} AS draw FROM orders".replace("$$", "'"))
def fn_stable_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", hashing.stable_long(F.col("o_orderkey"), F.col("o_orderpriority")).alias("seed"), hashing.stable_unit(F.col("o_orderkey")).alias("draw"))


@query()
def fn_blake2b_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyless BLAKE2b of 8 bytes, which no built-in has: an Arrow batch at a time."""
    @F.pandas_udf("string")
    def blake(values: pd.Series) -> pd.Series:
        return values.map(lambda v: hashlib.blake2b(v.encode(), digest_size=8).hexdigest())

    return table(spark, sf_dir, "orders").select("o_orderkey", blake(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderpriority")).alias("hash"))


@query("SELECT s_suppkey, sha256(concat_ws('|', s_suppkey, s_name, s_nationkey)) AS fingerprint FROM supplier")
def fn_row_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", hashing.fingerprint(F.col("s_suppkey"), F.col("s_name"), F.col("s_nationkey")).alias("fingerprint"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN (p_size // 2) || 's' ELSE (p_size // 2) || 'p5s' END AS label FROM part")
def fn_checkpoint_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.checkpoint_label(F.col("p_size") / 2).alias("label"))


@query("SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base FROM pages")
def fn_basename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.basename(F.col("url")).alias("base"))


@query("""SELECT event_id, CAST(epoch((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AS BIGINT) - CAST(epoch(CAST(CAST(ts AS DATE) AS TIMESTAMP)) AS BIGINT) AS local_s FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)""")
def fn_local_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.date_trunc("second", F.col("ts")).cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", time.local_seconds(ts, "America/New_York", F.to_date("ts")).alias("local_s"))


@query("SELECT o_orderkey, CASE WHEN isodow(o_orderdate) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type, dayname(o_orderdate) AS day_name FROM orders")
def fn_day_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", time.day_type(F.col("o_orderdate")).alias("day_type"), F.date_format("o_orderdate", "EEEE").alias("day_name"))


@query(f"""WITH {STOPS}, w AS (SELECT route_id, max(20000 + packages * 700.0) AS start, min(40000 + packages * 1500.0) AS stop FROM stops GROUP BY 1)
  SELECT route_id, greatest(start, 28800.0::DOUBLE)::DOUBLE AS low, least(stop, 86400.0::DOUBLE)::DOUBLE AS high, start < 28800 OR stop > 86400 AS clipped, greatest(start, 28800) > least(stop, 86400) AS is_empty FROM w""")
def tw_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("packages")
    both = stops(spark, sf_dir).groupBy("route_id").agg(F.max(20000 + n * 700.0).alias("start"), F.min(40000 + n * 1500.0).alias("stop"))
    low, high, clipped = time.clipped_window(F.col("start").cast("double"), F.col("stop").cast("double"))
    return both.select("route_id", low.alias("low"), high.alias("high"), clipped.alias("clipped"), (low > high).alias("is_empty"))


@query("SELECT l_orderkey AS route_id, round((epoch(max(l_shipdate)) - epoch(min(l_shipdate))) / 3600.0::DOUBLE, 6) AS hours, strftime(min(l_shipdate), '%Y-%m-%d') || ' - ' || strftime(max(l_shipdate), '%Y-%m-%d') AS label FROM lineitem GROUP BY 1")
def fn_window_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("route_id")).agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
    label = F.concat_ws(" - ", F.date_format("a", "yyyy-MM-dd"), F.date_format("b", "yyyy-MM-dd"))
    return rows.select("route_id", F.round(time.window_hours(F.col("a").cast("timestamp"), F.col("b").cast("timestamp")), 6).alias("hours"), label.alias("label"))


@query(f"WITH {STOPS} SELECT route_id, stop_no, part_id, station_id, packages, travel_s * 3.6 / (10 + packages) AS seconds, round((10 + packages) / 3.6, 6) AS mps FROM stops")
def fn_travel_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    kph = 10 + F.col("packages")
    return stops(spark, sf_dir).select("route_id", "stop_no", "part_id", "station_id", "packages", time.travel_seconds(F.col("travel_s"), kph).alias("seconds"), F.round(kph / 3.6, 6).alias("mps"))


PATH = f"{POINTS}, o AS (SELECT *, lag(x) OVER w AS xa, lag(y) OVER w AS ya, lead(x) OVER w AS xb, lead(y) OVER w AS yb FROM points WINDOW w AS (PARTITION BY kind ORDER BY point_id)), t AS (SELECT * FROM o WHERE xa IS NOT NULL AND xb IS NOT NULL)"


def _path(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("kind").orderBy("point_id")
    rows = points(spark, sf_dir).select("*", *(f(c).over(w).alias(f"{c}{n}") for c in ("x", "y") for f, n in ((F.lag, "a"), (F.lead, "b"))))
    return rows.where(F.col("xa").isNotNull() & F.col("xb").isNotNull())


@query(f"""WITH {PATH}, d AS (SELECT point_id, ((degrees(atan2(x - xa, y - ya)) + 360) % 360) AS b1, ((degrees(atan2(xb - x, yb - y)) + 360) % 360) AS b2 FROM t), e AS (SELECT point_id, (b2 - b1 + 540) % 360 - 180 AS delta FROM d)
  SELECT point_id, round(delta, 6) AS delta, CASE WHEN abs(delta) <= 30 THEN 0.0::DOUBLE WHEN abs(delta) >= 150 THEN 20.0::DOUBLE WHEN delta > 0 THEN 3.0::DOUBLE ELSE 8.0::DOUBLE END AS penalty_s FROM e""")
def fn_turn_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, xa, ya, xb, yb = (F.col(c) for c in ("x", "y", "xa", "ya", "xb", "yb"))
    delta = geo.turn_delta(geo.bearing(xa, ya, x, y), geo.bearing(x, y, xb, yb))
    return _path(spark, sf_dir).select("point_id", F.round(delta, 6).alias("delta"), geo.turn_penalty_s(delta).alias("penalty_s"))


@query(f"""WITH {PATH}, d AS (SELECT point_id, ((degrees(atan2(x - xa, y - ya)) + 360) % 180) AS a, ((degrees(atan2(xb - x, yb - y)) + 360) % 180) AS b FROM t)
  SELECT point_id, round(least((a - b + 180) % 180, 180 - (a - b + 180) % 180), 6) AS delta FROM d""")
def fn_orientation_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, xa, ya, xb, yb = (F.col(c) for c in ("x", "y", "xa", "ya", "xb", "yb"))
    turn = F.lit(180.0)
    a, b = F.pmod(geo.bearing(xa, ya, x, y), turn), F.pmod(geo.bearing(x, y, xb, yb), turn)
    return _path(spark, sf_dir).select("point_id", F.round(geo.orientation_delta(a, b), 6).alias("delta"))


@query(f"""WITH {STOPS}, s AS (SELECT route_id, stop_no, part_id, packages, 20 + packages % 50 AS legal, 15 + packages % 45 AS ref, {hashing.sql_unit("CAST(route_id AS VARCHAR) || '|' || day_type")} AS u FROM stops)
  SELECT route_id, stop_no, part_id, packages, round(least(legal, greatest(ref * least(greatest(0.6 + 0.6 * u, 0.7), 1.1), 5.0)), 6) AS kph FROM s""")
def road_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speeds of a day: the reference times a drawn and clipped factor, at least 5 km/h, at most the legal speed."""
    n = F.col("packages")
    factor = F.least(F.greatest(0.6 + 0.6 * hashing.stable_unit(F.col("route_id"), F.col("day_type")), F.lit(0.7)), F.lit(1.1))
    kph = F.least((20 + n % 50).cast("double"), F.greatest((15 + n % 45) * factor, F.lit(5.0)))
    return stops(spark, sf_dir).select("route_id", "stop_no", "part_id", "packages", F.round(kph, 6).alias("kph"))


@query(f"""WITH {LOCATIONS} SELECT location_id, CAST(i AS BIGINT) AS ref, CASE WHEN i = 1 THEN 1 - (units % 10) / 10.0::DOUBLE ELSE (units % 10) / 10.0::DOUBLE END AS fraction, round(CASE WHEN i = 1 THEN 1 - (units % 10) / 10.0::DOUBLE ELSE (units % 10) / 10.0::DOUBLE END * (100 + units), 6) AS offset_m FROM locations, (SELECT unnest([0, 1]) AS i)""")
def fn_projection_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a location projects on each directed reference of its road: the reversed one counts from the other end."""
    at = F.pmod("units", F.lit(10)) / 10.0
    refs = F.transform(F.array(F.lit(0), F.lit(1)), lambda r: F.struct(r.cast("bigint").alias("ref"), F.when(r == 1, 1 - at).otherwise(at).alias("fraction")))
    rows = locations(spark, sf_dir).select("location_id", "units", F.explode(refs).alias("r"))
    return rows.select("location_id", "r.ref", "r.fraction", F.round(F.col("r.fraction") * (100 + F.col("units")), 6).alias("offset_m"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice <= 50000 THEN 'low' WHEN o_totalprice <= 150000 THEN 'mid' WHEN o_totalprice <= 300000 THEN 'high' ELSE 'top' END AS band FROM orders")
def fn_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", classify.bands(F.col("o_totalprice"), [50000, 150000, 300000], ["low", "mid", "high", "top"]).alias("band"))


@query(f"""WITH {LOCATIONS} SELECT location_id, CASE WHEN units <= 1 THEN '1' WHEN units <= 4 THEN '2-4' WHEN units <= 9 THEN '5-9' WHEN units <= 19 THEN '10-19' WHEN units <= 49 THEN '20-49' ELSE '50+' END AS band, CASE WHEN units <= 1 THEN 'house' WHEN units <= 4 THEN 'small_apt' WHEN units <= 19 THEN 'mid_apt' ELSE 'large_apt' END AS kind FROM locations""")
def fn_unit_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locations(spark, sf_dir).select("location_id", classify.unit_band(F.col("units")).alias("band"), classify.unit_kind(F.col("units")).alias("kind"))


@query("""WITH t AS (SELECT p_partkey, p_type, p_brand, CASE WHEN p_partkey % 4 <> 0 AND p_brand <> 'Brand#3' THEN CAST(p_size AS DOUBLE) END AS v FROM part), b AS (SELECT p_type, p_brand, median(v) AS m FROM t GROUP BY 1, 2), c AS (SELECT p_type, median(v) AS m FROM t GROUP BY 1), g AS (SELECT median(v) AS m FROM t)
  SELECT p_partkey, coalesce(v, b.m, c.m, g.m) AS value, CASE WHEN v IS NOT NULL THEN 'observed' WHEN b.m IS NOT NULL THEN 'class' WHEN c.m IS NOT NULL THEN 'mode' ELSE 'global' END AS source FROM t JOIN b USING (p_type, p_brand) JOIN c USING (p_type), g""")
def hierarchical_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing values from the narrowest level that has a median; all levels come from one grouping-sets pass."""
    v = F.when((F.pmod("p_partkey", F.lit(4)) != 0) & (F.col("p_brand") != "Brand#3"), F.col("p_size").cast("double"))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", v.alias("v"))
    levels = rows.rollup("p_type", "p_brand").agg(F.median("v").alias("m"), F.grouping_id().alias("level"))
    narrow, wide, every = (levels.where(F.col("level") == k) for k in (0, 1, 3))
    out = rows.join(narrow.select("p_type", "p_brand", F.col("m").alias("m0")), ["p_type", "p_brand"]).join(wide.select("p_type", F.col("m").alias("m1")), "p_type")
    out = out.withColumn("_one", F.lit(1)).join(F.broadcast(every.select(F.lit(1).alias("_one"), F.col("m").alias("m2"))), "_one")  # one row
    source = classify.first_match((F.col("v").isNotNull(), "observed"), (F.col("m0").isNotNull(), "class"), (F.col("m1").isNotNull(), "mode"), otherwise="global")
    return out.select("p_partkey", F.coalesce("v", "m0", "m1", "m2").alias("value"), source.alias("source"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN value ELSE NULL END AS number FROM events""")
def fn_try_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.pmod("event_id", F.lit(4))
    raw = F.when(kind == 0, "n/a").when(kind == 1, F.col("value").cast("string")).when(kind == 2, "NaN").otherwise("Infinity")
    return table(spark, sf_dir, "events").select("event_id", text.try_number(raw).alias("number"))


@query(f"""WITH {STOPS}, s AS (SELECT route_id, list(station_id ORDER BY stop_no, part_id, station_id, packages, travel_s, ship_date) AS r FROM stops GROUP BY 1) SELECT route_id, array_to_string(list_prepend(-1, list_append(r, -1)), '-') AS merged, CAST(len(r) + 2 AS BIGINT) AS n FROM s""")
def fn_merge_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legs that each begin and end at the depot -1 as one sequence, by a fold that drops a doubled depot."""
    rows = stops(spark, sf_dir).groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct(*STOP_ORDER))).alias("s"))
    # a depot before the first stop and after the last: [-1, a], [b], ..., [-1] and [-1]
    legs = F.transform("s", lambda x, i: F.when(i == 0, F.array(F.lit(-1).cast("bigint"), x["station_id"])).otherwise(F.array(x["station_id"])))
    legs = F.array_append(F.array_append(legs, F.array(F.lit(-1).cast("bigint"))), F.array(F.lit(-1).cast("bigint")))
    doubled = lambda acc, r: (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) == -1) & (r[0] == -1)
    merged = F.aggregate(legs, F.array().cast("array<bigint>"), lambda acc, r: F.concat(acc, F.when(doubled(acc, r), F.slice(r, 2, F.size(r))).otherwise(r)))
    return rows.select("route_id", merged.alias("m")).select("route_id", F.array_join(F.transform("m", lambda x: x.cast("string")), "-").alias("merged"), F.size("m").cast("bigint").alias("n"))


@query("SELECT event_id, value, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k, event_type AS kind_name, length(event_type) AS kind_size FROM events")
def struct_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = table(spark, sf_dir, "events").select("event_id", "value", F.from_json("props", "k bigint").alias("props"), F.struct(F.col("event_type").alias("name"), F.length("event_type").cast("bigint").alias("size")).alias("kind"))
    flat = [F.col(f"{f.name}.{g.name}").alias(f"{f.name}_{g.name}") if hasattr(f.dataType, "fields") else F.col(f.name) for f in nested.schema for g in (getattr(f.dataType, "fields", None) or [f])]
    return nested.select(*flat)


@query("SELECT o_orderkey, 0.8::DOUBLE * (o_orderkey % 10 + 1) + CASE WHEN o_custkey % 5 > 0 THEN 0.2::DOUBLE * (o_totalprice / 100000) / (o_custkey % 5) ELSE 0.2::DOUBLE * (o_orderkey % 10 + 1) END AS weight FROM orders")
def adaptive_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses, old = F.pmod("o_custkey", F.lit(5)), F.pmod("o_orderkey", F.lit(10)) + 1
    new = F.when(uses > 0, 0.8 * old + 0.2 * (F.col("o_totalprice") / 100000) / uses).otherwise(0.8 * old + 0.2 * old)
    return table(spark, sf_dir, "orders").select("o_orderkey", new.alias("weight"))


@query("SELECT event_id, round(CASE WHEN value <= 100 THEN 1.0::DOUBLE ELSE exp(-(value - 100) / greatest(1e-12, 40.0::DOUBLE)) END, 6) AS acceptance, round(-value / ln(0.5), 5) AS first_temperature FROM events")
def fn_sa_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    delta = F.col("value") - 100
    accept = F.when(delta <= 0, 1.0).otherwise(F.exp(-delta / F.greatest(F.lit(1e-12), F.lit(40.0))))
    return table(spark, sf_dir, "events").select("event_id", F.round(accept, 6).alias("acceptance"), F.round(-F.col("value") / F.ln(F.lit(0.5)), 5).alias("first_temperature"))


@query(f"""WITH {POINTS}, b AS (SELECT min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2 FROM points)
  SELECT point_id, CAST(least(4, floor((y - y1) / ((y2 - y1) / 5))) * 5 + least(4, floor((x - x1) / ((x2 - x1) / 5))) AS BIGINT) AS zone FROM points, b""")
def zone_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square zoning of 5 by 5 over the extent; the extent is one row beside all others."""
    rows = points(spark, sf_dir)
    box = rows.agg(*(f(c).alias(f"{c}{n}") for c in ("x", "y") for f, n in ((F.min, 1), (F.max, 2))))
    rows = rows.withColumn("_one", F.lit(1)).join(F.broadcast(box.withColumn("_one", F.lit(1))), "_one")
    cell = lambda c: F.least(F.lit(4), F.floor((F.col(c) - F.col(f"{c}1")) / ((F.col(f"{c}2") - F.col(f"{c}1")) / 5)))
    return rows.select("point_id", (cell("y") * 5 + cell("x")).cast("bigint").alias("zone"))


@query(f"""WITH {POINTS}, a AS (SELECT point_id, kind, atan2(y, x) AS angle FROM points), r AS (SELECT kind, arg_min(angle, point_id) AS ref FROM a GROUP BY kind)
  SELECT point_id, round((angle - ref + 4 * pi()) % (2 * pi()), 6) AS sweep FROM a JOIN r USING (kind)""")
def polar_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).withColumn("angle", F.atan2("y", "x"))
    ref = rows.groupBy("kind").agg(F.min_by("angle", "point_id").alias("ref"))
    return rows.join(ref, "kind").select("point_id", F.round(F.pmod(F.col("angle") - F.col("ref"), 2 * F.pi()), 6).alias("sweep"))


@query(f"""WITH {STOPS}, s AS (SELECT route_id, row_number() OVER w AS served, count(*) OVER (PARTITION BY route_id) AS n FROM stops WINDOW w AS (PARTITION BY route_id ORDER BY stop_no, part_id, station_id, packages, travel_s, ship_date)),
  p AS (SELECT *, 1 - pow(1 - served / n, 2.0) AS phi, 1 - pow(1 - (served - 1) / n, 2.0) AS before FROM s) SELECT route_id, served, round(phi, 6) AS potential, round(least(greatest(0.99 * phi - before, -1.0), 1.0), 6) AS shaped FROM p""")
def potential_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Potential 1 - (1 - s/n)^2 of a route's progress, and the clipped discounted difference to the step before."""
    served = F.row_number().over(W.partitionBy("route_id").orderBy(*STOP_ORDER)).cast("bigint")
    rows = stops(spark, sf_dir).select("route_id", served.alias("served"), F.count(F.lit(1)).over(W.partitionBy("route_id")).alias("n"))
    phi = lambda s: 1 - F.pow(1 - s / F.col("n"), F.lit(2.0))
    now, before = phi(F.col("served")), phi(F.col("served") - 1)
    return rows.select("route_id", "served", F.round(now, 6).alias("potential"), F.round(F.least(F.greatest(0.99 * now - before, F.lit(-1.0)), F.lit(1.0)), 6).alias("shaped"))


@query(f"""WITH {LONLAT}, b AS (SELECT min(lon) AS x1, min(lat) AS y1, greatest(max(lon) - min(lon), max(lat) - min(lat), 1e-6) AS scale FROM lonlat) SELECT point_id, round((lon - x1) / scale, 6) AS x, round((lat - y1) / scale, 6) AS y FROM lonlat, b""")
def minmax_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haulmark.sources.tables import lonlat

    rows = lonlat(spark, sf_dir)
    box = rows.agg(F.min("lon").alias("x1"), F.min("lat").alias("y1"), F.greatest(F.max("lon") - F.min("lon"), F.max("lat") - F.min("lat"), F.lit(1e-6)).alias("scale"))
    both = rows.withColumn("_one", F.lit(1)).join(F.broadcast(box.withColumn("_one", F.lit(1))), "_one")  # one row
    return both.select("point_id", F.round((F.col("lon") - F.col("x1")) / F.col("scale"), 6).alias("x"), F.round((F.col("lat") - F.col("y1")) / F.col("scale"), 6).alias("y"))
