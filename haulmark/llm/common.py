"""What the corpus operators share: tables, shared storage, Arrow text access."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.operators.lineage import shared_folder

#: What `materialize` has written and not yet deleted, and where the frames read from.
_WRITTEN: dict[str, SparkSession] = {}
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Of those that are bucketed, their names in the session's catalog.
_TABLES: dict[str, str] = {}
#: While a table is written: its shuffles go as soon as it stands.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Batches for Python of so many bytes, in a session that says nothing itself.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


class Shared:
    """A broadcast value. It is pickled with its class, so executors need no copy of this package."""

    def __init__(self, spark: SparkSession, value: object) -> None:
        self._sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self) -> object:
        return cloudpickle.loads(self._sent.value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """These settings of the session, and afterwards what was there before."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, unless the session has a size of its own: large ones cost memory outside
    the heap, several times over, in every task."""
    name, size = BATCH
    if name not in spark.conf.getAll:
        spark.conf.set(name, size)


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder and read it back: cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/haulmark-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    with settings(spark, WRITING):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def numbered(df: DataFrame, name: str) -> DataFrame:
    """`df` with a number for each row, written once: numbers that follow from file splits would be
    others in a later scan if executors came or went between."""
    return materialize(df.withColumn(name, F.monotonically_increasing_id()))


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """`df` written once to the shared folder, in buckets of `key`: a join by it with a table that is dealt by the
    same key moves no row of this one. As many buckets as the session has shuffle partitions."""
    spark = df.sparkSession
    name = f"haulmark_{uuid.uuid4().hex}"
    path, n = f"{shared_folder(spark)}/{name}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    _WRITTEN[path] = spark
    _TABLES[path] = name
    with settings(spark, WRITING):
        df.repartition(n, key).write.format("parquet").option("path", path).bucketBy(n, key).saveAsTable(name)
    out = spark.table(name)
    _PATHS[out] = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete what `materialize` wrote for these frames, once nothing reads them."""
    for df in frames:
        if spark := _WRITTEN.pop(path := _PATHS[df], None):
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    if name := _TABLES.pop(path, None):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


@atexit.register
def _delete_all() -> None:
    for path, spark in _WRITTEN.items():
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone
            return


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string column, and the n + 1 offsets of its rows. Nulls are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most `limit` bytes each, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def lower_words(text: str | None) -> list[bytes]:
    """Words of [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; null is empty."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def unused(columns: list[str], *names: str) -> list[str]:
    """`names`, with underscores before those that are among `columns` in any case of letters."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out


#: Counted bytes up to which a frame may be broadcast.
BROADCAST_BYTES = 1 << 24


def few_bytes(frame: DataFrame, row_bytes: int) -> DataFrame:
    """`frame` (written, or cheap to count) with a broadcast hint if it has at most BROADCAST_BYTES:
    `row_bytes` for each row."""
    return frame.hint("broadcast") if frame.count() * row_bytes <= BROADCAST_BYTES else frame


def keep_keys(rows: DataFrame, keys: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """Semi or anti join with materialized `keys`: broadcast where they are counted to be few, else shuffled."""
    return rows.join(few_bytes(keys, 64), on, how)
