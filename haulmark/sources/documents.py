"""Document formats read into tables: record-separated JSON, tolerant JSON lines, GraphML, dense matrices."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def record_separated_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of an RFC 7464 text sequence. Empty records are skipped; a record that isn't JSON gives nulls."""
    lines = spark.read.option("lineSep", "\x1e").text(path).select(F.trim(F.regexp_replace("value", r"[\r\n]+$", "")).alias("v"))
    return lines.where("v <> ''").select(F.from_json("v", schema).alias("r")).select("r.*")


def tolerant_json_lines(spark: SparkSession, path: str, schema: str, must: str) -> DataFrame:
    """Objects of lines that may end in commas; lines without the field `must` (brackets, headers, junk) are left out."""
    lines = spark.read.text(path).select(F.regexp_replace(F.rtrim(F.col("value")), ",+$", "").alias("v"))
    return lines.where(F.col("v").startswith("{")).select(F.from_json("v", schema).alias("r")).select("r.*").where(F.col(must).isNotNull())


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, data: map) and edges (u, v, data: map) of GraphML files, by the built-in XML reader."""
    data = "data array<struct<_key:string, _VALUE:string>>"
    values = F.map_from_entries(F.transform(F.coalesce("data", F.expr("array()").cast("array<struct<_key:string,_VALUE:string>>")), lambda d: F.struct(d["_key"], d["_VALUE"])))
    nodes = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, {data}").load(path).select(F.col("_id").alias("node"), values.alias("data"))
    edges = spark.read.format("xml").option("rowTag", "edge").schema(f"_source string, _target string, {data}").load(path)
    return nodes, edges.select(F.col("_source").alias("u"), F.col("_target").alias("v"), values.alias("data"))


def matrices(spark: SparkSession, path: str, rows: int = 1 << 16) -> DataFrame:
    """(file, i, j, value) of square .npy files, a row for each cell, in Arrow batches of `rows` cells."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                m = np.load(io.BytesIO(content.as_buffer()), allow_pickle=False)
                flat = m.ravel().astype(np.float64)
                for start in range(0, flat.size, rows):
                    at = np.arange(start, min(start + rows, flat.size))
                    yield pa.record_batch([pa.array([name] * len(at)), pa.array(at // m.shape[1]), pa.array(at % m.shape[1]), pa.array(flat[at])], ["file", "i", "j", "value"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(cells, "file string, i long, j long, value double")


#: A quoted text of a dump (quotes are doubled or escaped), a tuple with such texts, and a value behind its comma.
QUOTED = r"'(?:[^'\\]++|''|\\.)*+'"
TUPLE, VALUE = rf"\((?:[^'()]++|{QUOTED})*+\)", rf",\s*+({QUOTED}|[^,]*+)"


def sql_dump(spark: SparkSession, path: str) -> DataFrame:
    """(table, values) of the tuples in a SQL dump: values are texts without their quotes and escapes; NULL is null.

    A record is what one INSERT statement brings, so a tuple knows its table without looking back over
    lines; what follows UNLOCK TABLES belongs to none, and what is no tuple is left out. Tuples may share a
    line, and quoted texts may hold commas, quotes, brackets and line ends.
    """
    parts = spark.read.option("lineSep", "INSERT INTO `").text(path)
    named = parts.select(F.regexp_extract("value", r"^(\w+)` VALUES", 1).alias("table"), F.split("value", "\nUNLOCK TABLES")[0].alias("body")).where("table <> ''")
    body = F.regexp_replace("body", r"^\w+` VALUES", "")
    tuples = named.select("table", F.explode(F.regexp_extract_all(body, F.lit(TUPLE), F.lit(0))).alias("one"))
    inner = F.concat(F.lit(","), F.expr("substr(one, 2, length(one) - 2)"))

    def plain(value: Column) -> Column:
        # a line end is written as \\n; of other pairs of escape and character, or of two quotes, the second stays
        text = F.regexp_replace(F.regexp_replace(F.substring(value, F.lit(2), F.length(value) - 2), r"(?<!\\)((?:\\\\)*+)\\n", "$1\n"), r"'(')|\\(.)", "$1$2")
        bare = F.trim(value)
        return F.when(value.startswith("'"), text).when(F.upper(bare) != "NULL", bare)

    return tuples.select("table", F.transform(F.regexp_extract_all(inner, F.lit(VALUE), F.lit(1)), plain).alias("values"))


def read_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table by the suffix of its path: csv with a header, parquet, JSON lines, or GeoJSON features' properties."""
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    if suffix == "csv":
        return spark.read.option("header", True).schema(schema).csv(path)
    if suffix == "parquet":
        return spark.read.schema(schema).parquet(path)
    if suffix in ("json", "jsonl", "ndjson"):
        return spark.read.schema(schema).json(path)
    if suffix == "geojson":
        return tolerant_json_lines(spark, path, f"type string, properties struct<{schema}>", "properties").select("properties.*")
    raise ValueError(f"no reader for .{suffix}: {path}")
