"""Aggregates that have no single built-in: weighted medians, distribution distances, concentration, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import windows
from .lineage import settle


def pivot_counts(df: DataFrame, keys: list[str], column: str, values: list[object], prefix: str) -> DataFrame:
    """Rows of each key by value, as one column for each of `values`; 0 where there are none. Values are given,
    so no pass over the data is needed to find them, and the schema is fixed."""
    counts = (F.count_if(F.col(column) == v).alias(f"{prefix}{v}") for v in values)
    return df.groupBy(*keys).agg(*counts)


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """(keys, median): the least value at which the running weight is half of the whole or more.

    Equal values are summed before the window, so a key's window holds its distinct values.
    """
    by_value = df.where(F.col(weight) > 0).groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    run = W.partitionBy(*keys).orderBy(value)
    at = by_value.withColumn("_upto", F.sum("_w").over(run)).withColumn("_all", F.sum("_w").over(W.partitionBy(*keys)))
    return at.where(F.col("_upto") >= F.col("_all") / 2).groupBy(*keys).agg(F.min(value).alias("median"))


def wasserstein(df: DataFrame, keys: list[str], value: str, side: str) -> DataFrame:
    """(keys, w1): the area between the two empirical distributions; `side` is true for one of them.

    null if either side is empty. Counts are summed by value first.
    """
    by_value = df.groupBy(*keys, value).agg(F.count_if(F.col(side)).alias("_a"), F.count_if(~F.col(side)).alias("_b"))
    every, run = W.partitionBy(*keys), W.partitionBy(*keys).orderBy(value)
    cdf = by_value.withColumns({
        "_fa": F.sum("_a").over(run) / F.sum("_a").over(every), "_fb": F.sum("_b").over(run) / F.sum("_b").over(every), "_dx": F.lead(value).over(run) - F.col(value)})
    return cdf.groupBy(*keys).agg(F.sum(F.abs(F.col("_fa") - F.col("_fb")) * F.coalesce("_dx", F.lit(0.0))).alias("w1"))


def exact_mean(value: str | Column, digits: int) -> Column:
    """The mean of values of so many decimals. Decimal sums don't depend on the order of rows, so neither does the mean."""
    x = F.col(value) if isinstance(value, str) else value
    return F.sum(x.cast(f"decimal(18,{digits})")).cast("double") / F.count(x)


def sql_mean(value: str, digits: int) -> str:
    """DuckDB SQL of exact_mean."""
    return f"CAST(sum(CAST({value} AS DECIMAL(18,{digits}))) AS DOUBLE) / count({value})"


def concentration(df: DataFrame, keys: list[str], group: str) -> DataFrame:
    """(keys, hhi, largest_share, groups): how a key's rows are spread over groups."""
    sizes = df.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("_n"))
    share = F.col("_n") / F.col("_all")
    sizes = sizes.withColumn("_all", F.sum("_n").over(W.partitionBy(*keys)))
    return sizes.groupBy(*keys).agg(F.sum(share * share).alias("hhi"), F.max(share).alias("largest_share"), F.count(F.lit(1)).alias("groups"))


def quantiles(value: str, *shares: float) -> list[Column]:
    """Exact quantile columns q00, q50, ... of one pass."""
    return [F.percentile(value, F.lit(s)).alias(f"q{round(s * 100):02d}") for s in shares]


def summary(value: str) -> list[Column]:
    x = F.col(value)
    return [F.count(x).alias("n"), F.min(x).alias("low"), *quantiles(value, 0.1, 0.5, 0.9, 0.99), F.avg(x).alias("mean"), F.max(x).alias("high"), F.stddev_pop(x).alias("std")]


#: Rows that `tasks_for` means a task to hold.
DEALT = 1 << 19


def tasks_for(rows: int) -> int:
    """Partitions that so many rows are dealt to. Adaptive plans join partitions by their compressed bytes, of which a
    task's hash maps and sorts take many times the memory; a number that is given stays."""
    return rows // DEALT + 1


def _placed(df: DataFrame, keys: list[str], value: str, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (keys, _v, position) in one order of keys and values, and each key's number of rows and first place."""
    placed = windows.global_position(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v")), [*keys, "_v"], tasks)
    return placed, _sizes(placed, keys)


def _sizes(placed: DataFrame, keys: list[str]) -> DataFrame:
    return settle(placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("position").alias("_first")))


def _edges(placed: DataFrame, sizes: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """(keys, edges) of the first rows of each key that `sizes` tells."""
    asked, at = F.array(*map(F.lit, shares)), F.col("position") - F.col("_first")
    place = lambda s: (F.col("_n") - 1) * s
    found = placed.join(sizes, keys).where(F.exists(asked, lambda s: (at == F.floor(place(s))) | (at == F.ceil(place(s)))))
    found = found.groupBy(*keys, "_n").agg(F.map_from_entries(F.collect_list(F.struct(at.alias("at"), F.col("_v").cast("double").alias("v")))).alias("_m"))

    def edge(share: Column) -> Column:
        h = place(share)
        low, high = F.try_element_at("_m", F.floor(h)), F.try_element_at("_m", F.ceil(h))
        return F.when(low == high, low).otherwise((F.ceil(h) - h) * low + (h - F.floor(h)) * high)

    return found.select(*keys, F.transform(asked, edge).alias("edges"))


def placed_quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """(keys, edges): exact quantiles, interpolated between neighbours, of any number of rows in a key.

    Rows are numbered in one order of keys and values; those at the places asked for are all that a key
    gathers, so no task holds a key's values. Null values don't count, and a key without others has no row.
    """
    return _edges(*_placed(df, keys, value), keys, shares)


DECILES = [i / 10 for i in range(11)]


def decile_edges(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, edges): 11 exact decile edges."""
    return placed_quantiles(df, keys, value, DECILES)


def enveloped_edges(df: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """(keys, cap, edges): a key's exact quantile, and the 11 decile edges of its values up to that, written once.

    Values up to the quantile come first in the order that finds it, so their edges are places in the same order.
    """
    placed, sizes = _placed(df, keys, value, tasks_for(df.count()))
    caps = settle(_edges(placed, sizes, keys, [share]).select(*keys, F.col("edges")[0].alias("cap")))
    inside = _sizes(placed.join(caps, keys).where("_v <= cap"), keys)
    return settle(caps.join(_edges(placed, inside, keys, DECILES), keys))
