"""Tables of a data folder, and the logistics views over them.

Every view is a projection (and at most one equi-join) of base tables, so filters and column
choices made on it still reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def require(df: DataFrame, *columns: str) -> DataFrame:
    """`df`, or an error that names the columns that are missing."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def picked(df: DataFrame, **aliases: list[str]) -> DataFrame:
    """Columns by their names here, each from the first of its aliases that `df` has."""
    found = {name: next((c for c in known if c in df.columns), None) for name, known in aliases.items()}
    if missing := [f"{name} ({', '.join(aliases[name])})" for name, c in found.items() if c is None]:
        raise ValueError(f"columns are missing: {'; '.join(missing)}")
    return df.select(*(F.col(c).alias(name) for name, c in found.items()))


def eligible(df: DataFrame, gate: str, *columns: str) -> DataFrame:
    """Rows whose gate is true (null is false), with the columns asked for; the gate itself is read but dropped."""
    return require(df, gate, *columns).where(F.coalesce(F.col(gate).cast("boolean"), F.lit(False))).select(*columns)


#: A total order of a route's stops.
STOP_ORDER = ["stop_no", "part_id", "station_id", "packages", "travel_s", "ship_date"]


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery stops: one for each line item."""
    day = F.to_date("l_shipdate")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("route_id"), F.col("l_linenumber").alias("stop_no"), F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("station_id"),
        day.alias("ship_date"), F.when(F.weekday(day) >= 5, "weekend").otherwise("weekday").alias("day_type"),
        F.col("l_quantity").cast("bigint").alias("packages"), (F.col("l_quantity") * 1000).alias("demand_cm3"), (30 + 2 * F.col("l_quantity")).alias("service_s"),
        (F.col("l_extendedprice") / 10).alias("travel_s"), F.col("l_returnflag").alias("status"), F.col("l_discount").alias("discount"),
    )


STOPS = """stops AS (SELECT l_orderkey AS route_id, l_linenumber AS stop_no, l_partkey AS part_id, l_suppkey AS station_id, CAST(l_shipdate AS DATE) AS ship_date,
  CASE WHEN isodow(l_shipdate) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type, CAST(l_quantity AS BIGINT) AS packages, l_quantity * 1000 AS demand_cm3,
  30 + 2 * l_quantity AS service_s, l_extendedprice / 10 AS travel_s, l_returnflag AS status, l_discount AS discount FROM lineitem)"""


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latent service locations: one for each customer, with units and three gates."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("location_id"), F.col("c_nationkey").alias("city_id"), F.col("c_mktsegment").alias("kind"), F.col("c_acctbal").alias("balance"),
        (1 + F.pmod(key, F.lit(60))).alias("units"), (F.pmod(key, F.lit(10)) != 9).alias("release_eligible"), (F.pmod(key, F.lit(7)) != 3).alias("default_eligible"),
        F.when(F.pmod(key, F.lit(5)) > 0, F.col("c_acctbal") > 0).alias("candidate_eligible"),
    )


LOCATIONS = """locations AS (SELECT c_custkey AS location_id, c_nationkey AS city_id, c_mktsegment AS kind, c_acctbal AS balance, 1 + c_custkey % 60 AS units,
  c_custkey % 10 <> 9 AS release_eligible, c_custkey % 7 <> 3 AS default_eligible, CASE WHEN c_custkey % 5 > 0 THEN c_acctbal > 0 END AS candidate_eligible FROM customer)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in metres: the first two components of the embeddings, on a square of about 10 km."""
    at = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("point_id"), F.col("label").alias("kind"), F.round(at[0].cast("double") * 10000, 3).alias("x"), F.round(at[1].cast("double") * 10000, 3).alias("y"))


POINTS = """points AS (SELECT vec_id AS point_id, label AS kind, round(CAST(embedding[1] AS DOUBLE) * 10000, 3) AS x, round(CAST(embedding[2] AS DOUBLE) * 10000, 3) AS y FROM embeddings)"""


def lonlat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points as longitude and latitude around (-100, 40)."""
    return points(spark, sf_dir).select("point_id", "kind", (F.col("x") / 1000 - 100).alias("lon"), (F.col("y") / 1000 + 40).alias("lat"))


LONLAT = POINTS + ", lonlat AS (SELECT point_id, kind, x / 1000 - 100 AS lon, y / 1000 + 40 AS lat FROM points)"


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed road edges between cities (nations): from a stop's customer to its station, the
    shortest of each order priority as parallel edges. At most 25 * 25 * 5, whatever the data's size."""
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_partkey")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customer, supplier = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = item.join(order, item.l_orderkey == order.o_orderkey).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    joined = joined.where(F.col("c_nationkey") != F.col("s_nationkey"))
    return joined.groupBy(F.col("c_nationkey").alias("u"), F.col("s_nationkey").alias("v"), F.substring("o_orderpriority", 1, 1).cast("int").alias("key")).agg(
        F.min(F.col("l_quantity") * 100 + F.pmod(F.col("l_partkey"), F.lit(97))).alias("length_m"), F.count(F.lit(1)).alias("trips"))


ROADS = """roads AS (SELECT c_nationkey AS u, s_nationkey AS v, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS key, min(l_quantity * 100 + l_partkey % 97) AS length_m, count(*) AS trips
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY 1, 2, 3)"""
#: One edge for each pair: the shortest, of the smallest key.
LINKS = ROADS + ", links AS (SELECT u, v, min(length_m) AS w FROM roads GROUP BY u, v)"


def traded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges (u, v, l_quantity) between customers (even nodes) and suppliers (odd nodes), one for each
    line item: goods go to the customer, returned ones back."""
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_returnflag")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = item.join(order, item.l_orderkey == order.o_orderkey)
    customer, supplier, back = F.col("o_custkey") * 2, F.col("l_suppkey") * 2 + 1, F.col("l_returnflag") == "R"
    return joined.select(F.when(back, customer).otherwise(supplier).alias("u"), F.when(back, supplier).otherwise(customer).alias("v"), "l_quantity")


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of `traded` as (u, v, w), which grow with the data: of parallel ones the least quantity."""
    return traded(spark, sf_dir).groupBy("u", "v").agg(F.min("l_quantity").cast("double").alias("w"))


TRADE = """trade AS (SELECT CASE WHEN l_returnflag = 'R' THEN o_custkey * 2 ELSE l_suppkey * 2 + 1 END AS u, CASE WHEN l_returnflag = 'R' THEN l_suppkey * 2 + 1 ELSE o_custkey * 2 END AS v,
  CAST(min(l_quantity) AS DOUBLE) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def timed_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of `trade` with whole costs: (u, v, w, t), the least quantity and, with that, the least time."""
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("w"), F.pmod("l_partkey", F.lit(97)).cast("bigint").alias("t"), "l_returnflag")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = item.join(order, item.l_orderkey == order.o_orderkey)
    customer, supplier, back = F.col("o_custkey") * 2, F.col("l_suppkey") * 2 + 1, F.col("l_returnflag") == "R"
    edges = joined.select(F.when(back, customer).otherwise(supplier).alias("u"), F.when(back, supplier).otherwise(customer).alias("v"), "w", (F.col("w") * 97 + F.col("t")).alias("x"))
    # t is under 97, so both are one number, which is aggregated without sorting
    return edges.groupBy("u", "v").agg(F.min("w").alias("w"), F.pmod(F.min("x"), F.lit(97)).alias("t"))


TIMED_TRADE = """timed AS (SELECT CASE WHEN l_returnflag = 'R' THEN o_custkey * 2 ELSE l_suppkey * 2 + 1 END AS u, CASE WHEN l_returnflag = 'R' THEN l_suppkey * 2 + 1 ELSE o_custkey * 2 END AS v,
  CAST(min(l_quantity) AS BIGINT) AS w, CAST(arg_min(l_partkey % 97, (l_quantity, l_partkey % 97)) AS BIGINT) AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""
