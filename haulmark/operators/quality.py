"""Checks of tables: many rules in one pass, gates over them, and comparison of recomputed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, rules: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """(by, rule, violations): how many rows break each rule; a rule that is null for a row holds. One aggregate, then a row for each rule."""
    counts = [F.count_if(~F.coalesce(rule, F.lit(True))).alias(name) for name, rule in rules.items()]
    wide = df.groupBy(*(by or [])).agg(*counts)
    rows = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules))
    return wide.select(*(by or []), F.explode(rows).alias("r")).select(*(by or []), "r.rule", "r.violations")


def compared(a: DataFrame, b: DataFrame, on: list[str], value: str, tolerance: float) -> DataFrame:
    """One row for `on[0]`: cells of both, only of one, within tolerance, and the largest difference."""
    both = a.withColumnRenamed(value, "_a").join(b.withColumnRenamed(value, "_b"), on, "full_outer")
    off = F.abs(F.col("_a") - F.col("_b"))
    return both.groupBy(on[0]).agg(
        F.count_if(off.isNotNull()).alias("n_both"), F.count_if(F.col("_b").isNull()).alias("n_missing"), F.count_if(F.col("_a").isNull()).alias("n_extra"), F.count_if(off <= tolerance).alias("n_close"), F.max(off).alias("max_error"))


def set_equality(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """(missing, extra, equal) of two sets of ids, one row, by an outer join of the distinct ids."""
    both = a.select(on, F.lit(1).alias("_a")).distinct().join(b.select(on, F.lit(1).alias("_b")).distinct(), on, "full_outer")
    missing, extra = F.count_if(F.col("_b").isNull()), F.count_if(F.col("_a").isNull())
    return both.agg(missing.alias("missing"), extra.alias("extra"), ((missing == 0) & (extra == 0)).alias("equal"))
