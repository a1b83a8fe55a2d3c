"""Scans, formats and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.functions import hashing, text
from haulmark.operators import aggregates, joins, journal, windows
from haulmark.sources import documents, sinks
from haulmark.sources.tables import LOCATIONS, POINTS, ROADS, eligible, locations, points, roads, table

from .registry import query


@query(f"WITH {LOCATIONS} SELECT location_id, city_id, units FROM locations WHERE release_eligible")
def scan_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eligible(locations(spark, sf_dir), "release_eligible", "location_id", "city_id", "units")


@query("""SELECT 'customer' AS kind, c_custkey AS id, c_name AS name FROM customer
  UNION SELECT 'supplier', s_suppkey, s_name FROM supplier
  UNION SELECT 'customer', o_custkey, 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') FROM orders""")
def union_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"))
    seen = table(spark, sf_dir, "orders").select(F.lit("customer").alias("kind"), F.col("o_custkey").alias("id")).distinct()
    c = seen.withColumn("name", F.concat(F.lit("Customer#"), F.lpad(F.col("id").cast("string"), 9, "0")))
    return a.unionByName(b).unionByName(c).distinct()


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sinks.scratch(spark)
    source = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    sinks.write_csv(source, path)
    return spark.read.option("header", True).option("mode", "FAILFAST").schema(source.schema).csv(path)


@query("SELECT event_id, 'k' AS name, CAST(json_extract(props, '$.k') AS BIGINT) AS n FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_map_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.from_json("props", "map<string,bigint>")
    return table(spark, sf_dir, "events").select("event_id", F.explode(props).alias("name", "n"))


@query("SELECT event_id, event_type, value FROM events")
def rs_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sinks.scratch(spark)
    lines = table(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", "event_type", "value")))
    lines.write.option("lineSep", "\x1e").text(path)
    return documents.record_separated_json(spark, path, "event_id bigint, event_type string, value double")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id % 50 <> 0")
def json_line_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sinks.scratch(spark)
    line = F.to_json(F.struct("event_id", "user_id", "event_type"))
    junk = F.pmod("event_id", F.lit(50)) == 0
    table(spark, sf_dir, "events").select(F.when(junk, '{"type": "FeatureCollection",').when(F.pmod("event_id", F.lit(3)) == 0, F.concat(line, F.lit(", "))).otherwise(line)).write.text(path)
    return documents.tolerant_json_lines(spark, path, "event_id bigint, user_id bigint, event_type string", "event_id")


@query("""SELECT p_partkey, p_name, p_type FROM part
  WHERE list_has_any(string_split(p_name, ' '), ['widget', 'bolt']) AND NOT list_has_any(list_append(string_split(p_name, ' '), lower(p_type)), ['small', 'promo'])""")
def tag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("p_name", " ")
    tags = F.array_append(words, F.lower("p_type"))
    drivable = F.arrays_overlap(words, F.array(F.lit("widget"), F.lit("bolt"))) & F.forall(tags, lambda t: ~t.isin("small", "promo"))
    return table(spark, sf_dir, "part").where(drivable).select("p_partkey", "p_name", "p_type")


@query(f"""WITH {POINTS}, b AS (SELECT CAST(floor(min(x) / 2000) AS BIGINT) AS x1, CAST(floor(max(x) / 2000) AS BIGINT) AS x2, CAST(floor(min(y) / 2000) AS BIGINT) AS y1, CAST(floor(max(y) / 2000) AS BIGINT) AS y2 FROM points),
  t AS (SELECT tx, unnest(range(y1, y2 + 1)) AS ty FROM (SELECT unnest(range(x1, x2 + 1)) AS tx, y1, y2 FROM b))
  SELECT tx, ty, tx * 2000.0::DOUBLE AS west, ty * 2000.0::DOUBLE AS south, count(point_id) AS n FROM t LEFT JOIN points ON floor(x / 2000) = tx AND floor(y / 2000) = ty GROUP BY tx, ty""")
def grid_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = points(spark, sf_dir).select(F.floor(F.col("x") / 2000).alias("tx"), F.floor(F.col("y") / 2000).alias("ty"))
    box = at.agg(F.min("tx").alias("x1"), F.max("tx").alias("x2"), F.min("ty").alias("y1"), F.max("ty").alias("y2"))
    tiles = box.select(F.explode(F.expr("sequence(x1, x2)")).alias("tx"), "y1", "y2").select("tx", F.explode(F.expr("sequence(y1, y2)")).alias("ty"))
    sizes = at.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n"))
    return joins.fill_left(tiles, sizes, ["tx", "ty"], {"n": 0}).select("tx", "ty", (F.col("tx") * 2000.0).alias("west"), (F.col("ty") * 2000.0).alias("south"), "n")


@query("""SELECT p_brand, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS name, count(*) AS n, CASE WHEN count(*) = 1 THEN min(p_partkey) END AS resolved,
  CASE WHEN count(*) = 1 THEN 'unique' ELSE 'ambiguous' END AS status FROM part GROUP BY 1, 2""")
def resolve_unique_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    named = table(spark, sf_dir, "part").groupBy("p_brand", text.normalize(F.col("p_name")).alias("name"))
    return named.agg(n.alias("n"), F.when(n == 1, F.min("p_partkey")).alias("resolved"), F.when(n == 1, "unique").otherwise("ambiguous").alias("status"))


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section FROM events""")
def sql_dump_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.when(F.col("event_type") == "signup", F.col("event_id"))
    section = F.last(header, ignorenulls=True).over(windows.upto(["user_id"], "ts", "event_id"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", section.alias("section"))


@query(f"""WITH {ROADS}, m AS (SELECT u AS i, v AS j, min(length_m) AS value FROM roads GROUP BY u, v), keep AS (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 2))
  SELECT i, j, value FROM m WHERE i IN (SELECT * FROM keep) AND j IN (SELECT * FROM keep)""")
def matrix_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = roads(spark, sf_dir).groupBy(F.col("u").alias("i"), F.col("v").alias("j")).agg(F.min("length_m").alias("value"))
    keep = table(spark, sf_dir, "nation").where(F.col("n_regionkey").isin(1, 2)).select(F.col("n_nationkey").alias("i"))
    return matrix.join(keep, "i", "left_semi").join(keep.withColumnRenamed("i", "j"), "j", "left_semi").select("i", "j", "value")


@query(f"""SELECT o_orderkey, position, {hashing.sql_long("CAST(o_orderkey AS VARCHAR)")} % 4 AS shard, position // 1000 AS slice
  FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders WHERE o_orderstatus = 'F')""")
def task_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate")
    placed = windows.global_position(tasks, ["o_orderdate", "o_orderkey"])
    return placed.select("o_orderkey", "position", F.pmod(hashing.stable_long(F.col("o_orderkey")), F.lit(4)).alias("shard"), F.floor(F.col("position") / 1000).alias("slice"))


@query(f"""WITH {LOCATIONS} SELECT city_id, count(*) AS n, count(*) FILTER (release_eligible) AS n_release, count(*) FILTER (default_eligible) AS n_default,
  count(*) FILTER (candidate_eligible) AS n_candidate, count(*) FILTER (candidate_eligible IS NULL) AS n_unknown FROM locations GROUP BY city_id""")
def eligibility_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    gates = [F.count_if(F.col(f"{g}_eligible")).alias(f"n_{g}") for g in ("release", "default", "candidate")]
    return locations(spark, sf_dir).groupBy("city_id").agg(F.count(F.lit(1)).alias("n"), *gates, F.count_if(F.col("candidate_eligible").isNull()).alias("n_unknown"))


#: Signups reset what a user has said before; of one time, the larger event comes later.
LATEST = """WITH r AS (SELECT user_id, max((ts, event_id)) AS reset FROM events WHERE event_type = 'signup' GROUP BY user_id),
  e AS (SELECT events.* FROM events LEFT JOIN r USING (user_id) WHERE event_type <> 'signup' AND (reset IS NULL OR (ts, event_id) > reset))
  SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM e GROUP BY user_id, event_type"""


@query(LATEST)
def journal_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return journal.replayed(rows, ["user_id"], ["event_type"], F.struct("ts", "event_id"), F.col("event_type") == "signup").select("user_id", "event_type", "event_id", "value")


@query(LATEST)
def journal_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a journal of JSON lines whose files all end in a torn line, recovered, replayed, compacted and read again."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    path = sinks.scratch(spark)
    line = rows.select(F.pmod("user_id", F.lit(16)).alias("file"), "us", "event_id", F.to_json(F.struct(*rows.columns)).alias("value"))
    torn = line.groupBy("file").agg(F.max("us").alias("us"), F.max("event_id").alias("event_id")).select("file", (F.col("us") + 1).alias("us"), "event_id", F.lit('{"event_id":17,"user_').alias("value"))
    line.union(torn).repartition("file").sortWithinPartitions("file", "us", "event_id").select("file", "value").write.partitionBy("file").text(path)
    schema = "event_id long, user_id long, event_type string, value double, us long"
    records, _ = journal.recovered(spark, path, schema)
    left = journal.replayed(records, ["user_id"], ["event_type"], F.struct("us", "event_id"), F.col("event_type") == "signup")
    compact = sinks.scratch(spark)
    journal.compacted(left, compact)
    again, _ = journal.recovered(spark, compact, schema)
    return again.select("user_id", "event_type", "event_id", "value")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem) WHERE n = 1""")
def dedup_pk(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.min(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")).alias("x")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(first).select("l_orderkey", "l_linenumber", "x.l_partkey", "x.l_suppkey", "x.l_quantity")


@query("""SELECT DISTINCT c_nationkey AS nation, c_mktsegment AS segment, c_custkey AS source FROM customer
  EXCEPT SELECT c_nationkey, c_mktsegment, c_custkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'""")
def missing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned sources that no urgent record is present for."""
    planned = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("source")).distinct()
    present = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'").select(F.col("o_custkey").alias("source"))
    return planned.join(present, "source", "left_anti")


@query(f"""WITH {POINTS} SELECT CAST(floor(x / 500) AS BIGINT) AS gx, CAST(floor(y / 500) AS BIGINT) AS gy, count(*) AS n, count(*) FILTER (kind < 5) AS n_low, count(*) FILTER (kind >= 5) AS n_high, {aggregates.sql_mean('x', 3)} AS mean_x,
  '{{"gx":' || CAST(floor(x / 500) AS BIGINT) || ',"gy":' || CAST(floor(y / 500) AS BIGINT) || ',"n":' || count(*) || '}}' AS feature FROM points GROUP BY floor(x / 500), floor(y / 500)""")
def grid_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.floor(F.col("x") / 500).alias("gx"), F.floor(F.col("y") / 500).alias("gy")
    low = F.col("kind") < 5
    sizes = points(spark, sf_dir).groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.count_if(low).alias("n_low"), F.count_if(~low).alias("n_high"), aggregates.exact_mean("x", 3).alias("mean_x"))
    return sizes.withColumn("feature", F.to_json(F.struct("gx", "gy", "n")))


@query("""SELECT r_name AS region, count(DISTINCT n_nationkey) AS cities, count(DISTINCT c_custkey) AS locations, count(o_orderkey) AS orders,
  '| ' || r_name || ' | ' || count(DISTINCT n_nationkey) || ' | ' || count(DISTINCT c_custkey) || ' | ' || count(o_orderkey) || ' |' AS row_md
  FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY r_name""")
def appendix_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    # orders are counted by customer, and customers by nation, before the few rows meet
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    by_nation = table(spark, sf_dir, "customer").join(orders, "c_custkey", "left").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
    nations = table(spark, sf_dir, "nation").join(by_nation, "n_nationkey", "left")
    total = table(spark, sf_dir, "region").join(nations, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("region")).agg(
        F.count(F.lit(1)).alias("cities"), F.coalesce(F.sum("c"), F.lit(0)).alias("locations"), F.coalesce(F.sum("n"), F.lit(0)).alias("orders"))
    return total.withColumn("row_md", sinks.markdown_row(*(F.col(c) for c in ("region", "cities", "locations", "orders"))))


@query("SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, sha256(coalesce(text, '')) AS content_sha256 FROM documents")
def content_hash_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length(body).cast("bigint").alias("n_bytes"), F.sha2(body, 256).alias("content_sha256"))


@query()
def file_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and distinct keys of each file of a table; names depend on the folder, so there is no SQL."""
    rows = table(spark, sf_dir, "documents").select("doc_id", text.basename(F.col("_metadata.file_path")).alias("file"))
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_ids"))


@query("""SELECT o_orderstatus AS cohort, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders GROUP BY 1""")
def partitioned_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan written by cohort and read back: the cohort comes from the folders' names."""
    path = sinks.scratch(spark)
    sinks.write_partitioned(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("cohort")), path, "cohort", order=["o_orderkey"])
    return spark.read.parquet(path).groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))
