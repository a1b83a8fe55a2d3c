"""A session for all tests, and the comparison of a query's rows with those of its SQL."""

from __future__ import annotations

import math
import sys
from datetime import date, datetime
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = Path("/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory: pytest.TempPathFactory) -> SparkSession:
    shared = tmp_path_factory.mktemp("shared")
    settings = {
        "spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g",
        "spark.checkpoint.dir": f"file://{shared}", "spark.sql.warehouse.dir": f"file://{shared}/warehouse", "spark.sql.autoBroadcastJoinThreshold": "4m",
    }
    session = SparkSession.builder.master("local[4]").config(map=settings).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(value: object) -> object:
    """A value that compares alike from either engine."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if hasattr(value, "asDict"):
        return plain(tuple(value))
    return value


def rows_of(frame: DataFrame) -> list[tuple]:
    names = sorted(frame.columns)
    return sorted((tuple(plain(r[n]) for n in names) for r in frame.collect()), key=repr)


def database(sf_dir: Path) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = sf_dir / f"{name}.parquet"
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return db


#: Types that hash alike; others must be equal.
KINDS = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "long", "double": "double", "float": "float", "string": "string", "boolean": "boolean", "date": "date", "timestamp": "timestamp", "timestamp_ntz": "timestamp", "binary": "binary"}
DUCK = {"INTEGER": "int", "BIGINT": "long", "DOUBLE": "double", "FLOAT": "float", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp", "BLOB": "binary"}


def sql_rows(db: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[tuple], dict[str, str]]:
    found = db.execute(sql)
    names, kinds = [d[0] for d in found.description], {d[0]: DUCK.get(str(d[1]), str(d[1])) for d in found.description}
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr), kinds
