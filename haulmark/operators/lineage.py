"""Cutting the lineage of loops through the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: What `settle` has written and not yet deleted, and where the frames read from.
_WRITTEN: dict[str, SparkSession] = {}
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one where none is set, which only one machine can share."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/haulmark-shared"


def settle(df: DataFrame) -> DataFrame:
    """`df`, written once to the shared folder and read from there, so that a lost executor loses nothing.

    Sizes and constraints are those of the files. A checkpoint would hand on the estimates of its plan,
    which multiply with every join of a loop.
    """
    spark: SparkSession = df.sparkSession
    path = f"{shared_folder(spark)}/haulmark-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete what `settle` wrote for these frames, once nothing reads them; other frames are left alone."""
    for df in frames:
        if spark := _WRITTEN.pop(path := _PATHS.get(df), None):
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


@atexit.register
def _delete_all() -> None:
    for path, spark in _WRITTEN.items():
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone
            return
