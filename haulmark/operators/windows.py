"""Running totals, ranks and splits. Windows are always partitioned by a key; whole-table orders go by
range-partitioned counts instead of one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import settle


def upto(keys: list[str], *order: object) -> W:
    return W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)


def improving(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value is strictly less than all before; `order` is total in a key."""
    before = F.min(value).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("_before", before).where(F.col("_before").isNull() | (F.col(value) < F.col("_before"))).drop("_before")


def take_until(df: DataFrame, keys: list[str], order: list[Column], amount: str, need: float) -> DataFrame:
    """The first rows of each key whose amounts reach `need`."""
    return df.withColumn("running", F.sum(amount).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))).where(F.col("running") - F.col(amount) < need)


def hash_quota(df: DataFrame, cell: list[str], rank: Column, tie: list[str], quota: int) -> DataFrame:
    """At most `quota` rows of each cell, by a hashed rank."""
    order = W.partitionBy(*cell).orderBy(rank, *tie)
    return df.withColumn("pick", F.row_number().over(order).cast("bigint")).where(F.col("pick") <= quota)


def global_position(df: DataFrame, order: list[str | Column], tasks: int | None = None) -> DataFrame:
    """`df` with `position`, 0-based in the whole order.

    Rows are range-partitioned (into the session's number of partitions, or `tasks`), sorted and numbered where
    they lie, and kept once, as another run of the range partitioning could draw its bounds
    elsewhere. The partitions' sizes, a row for each, are run over to give each its first number.
    """
    ranges = df.repartitionByRange(tasks, *order) if tasks else df.repartitionByRange(*order)
    placed = settle(ranges.sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    task, inside = F.shiftright("_id", 33).alias("_task"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(task).agg(F.count(F.lit(1)).alias("_size"))
    first = sizes.select("_task", (F.sum("_size").over(W.orderBy("_task")) - F.col("_size")).alias("_first"))
    numbered = placed.withColumn("_task", task).join(F.broadcast(first), "_task")  # a row for each partition
    return numbered.withColumn("position", (F.col("_first") + inside).cast("bigint")).select(*df.columns, "position")


def sessions(df: DataFrame, keys: list[str], order: str, starts: Column) -> DataFrame:
    """`df` with `session`: how many starts there were up to a row."""
    return df.withColumn("session", F.sum(F.coalesce(starts.cast("int"), F.lit(0))).over(upto(keys, order)).cast("bigint"))
