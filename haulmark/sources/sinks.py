"""Writers: protected, partitioned and text outputs, families of tables, and a shared scratch folder for round trips."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from haulmark.operators.lineage import shared_folder


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def write_new(df: DataFrame, path: str, rows_per_file: int = 0) -> None:
    """Parquet that refuses to replace what exists; Spark commits all files or none."""
    df.write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_partitioned(df: DataFrame, path: str, *by: str, order: list[str] | None = None) -> None:
    """A folder for each value of `by`. Rows are rebalanced by it, so that small values become few files and a large
    value several."""
    out = df.hint("rebalance", *by)
    (out.sortWithinPartitions(*by, *order) if order else out).write.mode("errorifexists").partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def markdown_row(*columns: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(c.cast("string") for c in columns)), F.lit(" |"))


def json_report(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, report): each row as a JSON object whose names are sorted."""
    return df.select(*keys, F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("report"))


#: What commits a family: data without it, or of a version that it doesn't name, isn't there.
MANIFEST = "MANIFEST.json"


def _fs(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest of a published family, None where nothing is published."""
    fs, where = _fs(spark, f"{path}/{MANIFEST}")
    return json.loads("".join(r.value for r in spark.read.text(f"{path}/{MANIFEST}").collect())) if fs.exists(where) else None


def _told(df: DataFrame) -> dict:
    """Rows and an order-free hash of a table."""
    every = F.xxhash64(*df.columns)
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(every.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("h")).first()
    return {"rows": row.n, "hash": row.h, "schema": df.schema.json()}


def family(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a published family."""
    found = manifest(spark, path)
    if found is None:
        raise FileNotFoundError(f"no family is published at {path}")
    return {name: spark.read.schema(StructType.fromJson(json.loads(t["schema"]))).parquet(f"{path}/{found['version']}/{name}") for name, t in found["tables"].items()}


def verified(spark: SparkSession, path: str) -> bool:
    """Whether a family is published and its files still hold what the manifest says."""
    found = manifest(spark, path)
    if found is None:
        return False
    try:
        return all({k: v for k, v in _told(df).items() if k != "schema"} == {k: found["tables"][name][k] for k in ("rows", "hash")} for name, df in family(spark, path).items())
    except (AnalysisException, Py4JJavaError, SparkRuntimeException):  # files are gone or broken
        return False


def publish_family(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> bool:
    """All tables or none: written to a folder of their own, read again, and then committed by the manifest alone,
    which is renamed into place. What is published and verified already is kept (False); what is broken is replaced.

    A job that dies in between leaves no manifest, or the one of before, and files that nothing names; the
    next run deletes those.
    """
    if verified(spark, path):
        return False
    version = uuid.uuid4().hex
    for name, df in tables.items():
        write_new(df, f"{path}/{version}/{name}")
    told = {name: _told(spark.read.schema(df.schema).parquet(f"{path}/{version}/{name}")) for name, df in tables.items()}
    _commit(spark, path, {"version": version, "tables": told})
    fs, where = _fs(spark, path)
    for status in fs.listStatus(where):
        if status.isDirectory() and status.getPath().getName() != version:
            fs.delete(status.getPath(), True)
    return True


def _commit(spark: SparkSession, path: str, what: dict) -> None:
    """Put the manifest in place by a rename."""
    fs, new = _fs(spark, f"{path}/{MANIFEST}.{what['version']}")
    out = fs.create(new, True)
    out.write(bytearray(json.dumps(what, sort_keys=True).encode()))
    out.close()
    _, final = _fs(spark, f"{path}/{MANIFEST}")
    if fs.exists(final):  # broken, as it isn't verified
        fs.delete(final, False)
    if not fs.rename(new, final):
        raise OSError(f"the manifest can't be put in place: {path}")
