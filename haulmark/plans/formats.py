"""Formats: dispatch by suffix, dumps, graph documents, schemas, protected writes, reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.sources import documents, sinks
from haulmark.sources.tables import LINKS, LOCATIONS, locations, picked, roads, table

from .registry import query


@query("SELECT 'customer' AS source, column_name FROM (DESCRIBE customer) UNION ALL SELECT 'orders', column_name FROM (DESCRIBE orders)")
def schema_peek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column names from the files' footers; no row is read."""
    names = [(t, c) for t in ("customer", "orders") for c in table(spark, sf_dir, t).columns]
    return spark.createDataFrame(names, "source string, column_name string")


@query("SELECT kind, c_custkey, c_name, c_acctbal FROM customer, (SELECT unnest(['csv', 'geojson', 'json', 'parquet']) AS kind)")
def format_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table written in four formats and read back by the suffix of its path."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    base = sinks.scratch(spark)
    sinks.write_csv(rows, f"{base}/rows.csv")
    rows.write.json(f"{base}/rows.json")
    sinks.write_new(rows, f"{base}/rows.parquet")
    feature = F.concat(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*rows.columns).alias("properties"))), F.lit(","))
    rows.select(feature).write.text(f"{base}/rows.geojson")
    out = None
    for kind in ("csv", "geojson", "json", "parquet"):
        part = documents.read_any(spark, f"{base}/rows.{kind}", "c_custkey long, c_name string, c_acctbal double").select(F.lit(kind).alias("kind"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT 'supplier' AS dump_table, s_suppkey::VARCHAR AS a, s_nationkey::VARCHAR AS b, s_name AS c FROM supplier
  UNION ALL SELECT 'part', p_partkey::VARCHAR, p_size::VARCHAR, p_brand FROM part UNION ALL SELECT 'nation', n_nationkey::VARCHAR, n_regionkey::VARCHAR, n_name FROM nation""")
def sql_dump_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables written as INSERT statements of a hundred tuples, and the tuples routed back to their tables."""
    out = None
    for name, key, more, text in (("supplier", "s_suppkey", "s_nationkey", "s_name"), ("part", "p_partkey", "p_size", "p_brand"), ("nation", "n_nationkey", "n_regionkey", "n_name")):
        line = F.concat(F.lit("("), F.col(key), F.lit(","), F.col(more), F.lit(", '"), F.col(text), F.lit("')"))
        part = table(spark, sf_dir, name).groupBy(F.floor(F.col(key) / 100)).agg(F.array_join(F.collect_list(line), ",\n").alias("body"))
        part = part.select(F.concat(F.lit(f"-- data\nINSERT INTO `{name}` VALUES\n"), "body", F.lit(";\nUNLOCK TABLES;\n(0,0,'none')\n")))
        out = part if out is None else out.union(part)
    path = sinks.scratch(spark)
    out.write.text(path)
    found = documents.sql_dump(spark, path)
    return found.select(F.col("table").alias("dump_table"), *(F.col("values")[i].alias(n) for i, n in enumerate("abc")))


@query(f"WITH {LINKS} SELECT u, v, w AS length_m FROM links")
def graphml_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roads written as GraphML and read back as a table of edges."""
    links = roads(spark, sf_dir).groupBy("u", "v").agg(F.min("length_m").alias("w"))
    edge = F.format_string('<edge source="%d" target="%d"><data key="length">%s</data></edge>', F.col("u"), F.col("v"), F.col("w").cast("string"))
    path = sinks.scratch(spark)
    document = F.concat(F.lit("<graphml><graph>"), F.array_join(F.collect_list(edge), ""), F.lit("</graph></graphml>"))
    links.groupBy("u").agg(document.alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)  # a document is a file
    _, edges = documents.graphml(spark, path)
    return edges.select(F.col("u").cast("int").alias("u"), F.col("v").cast("int").alias("v"), F.try_element_at("data", F.lit("length")).cast("double").alias("length_m"))


@query("SELECT count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high, true AS refused FROM orders")
def protected_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in files of limited rows; a second write to the same place is refused and changes nothing."""
    path = sinks.scratch(spark)
    sinks.write_new(table(spark, sf_dir, "orders").select("o_orderkey"), path, rows_per_file=100_000)
    try:
        sinks.write_new(table(spark, sf_dir, "orders").select("o_orderkey").limit(1), path)
        refused = False
    except AnalysisException:
        refused = True
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"), F.lit(refused).alias("refused"))


@query("SELECT 'customer' AS kind, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier")
def alias_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that name a column differently, each column taken by the first alias that is there."""
    parts = [picked(table(spark, sf_dir, t), id=["site_id", "c_custkey", "s_suppkey"], name=["site_name", "c_name", "s_name"]).select(F.lit(t).alias("kind"), "*") for t in ("customer", "supplier")]
    return parts[0].unionByName(parts[1])


@query("""SELECT n_regionkey AS region, '{"cities":' || count(DISTINCT n_nationkey) || ',"customers":' || count(c_custkey) || ',"region":' || n_regionkey || '}' AS report FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1""")
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of each region as JSON with sorted names."""
    counts = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, sf_dir, "nation").join(counts, "n_nationkey", "left").groupBy(F.col("n_regionkey").alias("region")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("customers"), F.count(F.lit(1)).alias("cities"))
    return sinks.json_report(rows, "region")


@query(f"""WITH {LOCATIONS} SELECT 'locations' AS name, count(*) AS n, CAST(sum(location_id) AS BIGINT) AS keys, true AS reused FROM locations UNION ALL SELECT 'orders', count(*), CAST(sum(o_orderkey) AS BIGINT), true FROM orders UNION ALL SELECT 'stops', count(*), CAST(sum(l_orderkey) AS BIGINT), true FROM lineitem""")
def family_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables published as one family; a second run finds them verified and keeps them."""
    own = {
        "locations": locations(spark, sf_dir).select(F.col("location_id").alias("key"), "city_id", "kind", "units"), "orders": table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey", "o_totalprice"),
        "stops": table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber", "l_quantity"),
    }
    path = sinks.scratch(spark)
    sinks.publish_family(spark, path, own)
    reused = not sinks.publish_family(spark, path, own)
    parts = [df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.sum("key").alias("keys"), F.lit(reused).alias("reused")) for name, df in sinks.family(spark, path).items()]
    return parts[0].union(parts[1]).union(parts[2])
