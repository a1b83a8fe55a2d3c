"""Append-only journals: what is left of them, what may be skipped, what replaces what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import joins
from .lineage import settle


def replayed(log: DataFrame, scope: list[str], key: list[str], order: str | Column, reset: Column) -> DataFrame:
    """The last record of each key since its scope's last reset, by a total `order`; resets themselves are no records."""
    log = log.withColumn("_order", F.col(order) if isinstance(order, str) else order)
    last = log.where(reset).groupBy(*scope).agg(F.max("_order").alias("_reset"))
    kept = log.where(~reset).join(last, scope or F.lit(True), "left").where(F.col("_reset").isNull() | (F.col("_order") > F.col("_reset"))).drop("_reset")
    return joins.last_wins(kept, [*scope, *(k for k in key if k not in scope)], F.col("_order")).drop("_order")


def written(log: DataFrame, path: str, *order: str, files: Column | None = None) -> None:
    """Append the records of `log` to a folder of JSON lines, in order, a file for each task or value of `files`."""
    dealt = log.repartition(files) if files is not None else log
    dealt.sortWithinPartitions(*order).select(F.to_json(F.struct(*log.columns))).write.mode("append").text(path)


def recovered(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Records of a journal's files of JSON lines, with `at`, their place (file, block, line), which orders all of them,
    and the torn ends (file, line, tail).

    The last line of a file may be torn, as a writer may have been stopped inside it; it is left out
    and told. A torn line before the last one of its file means that the journal is broken: an error
    names it. Empty lines don't count. A record must be an object: one that is valid JSON but none is an error too.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    # a task reads a block's lines in their order
    lines = settle(lines.select("value", F.struct("file", "block", F.monotonically_increasing_id().alias("line")).alias("at")).where(F.trim("value") != ""))
    parsed = lines.select("at", "value", F.from_json("value", f"{schema}, _torn string", {"columnNameOfCorruptRecord": "_torn"}).alias("r"))
    whole = F.coalesce(F.col("r._torn").isNull() & F.startswith(F.ltrim("value"), F.lit("{")), F.lit(False))
    torn = settle(parsed.where(~whole).select("at", "value"))
    ends = lines.groupBy("at.file").agg(F.max("at").alias("at")).select("at")
    broken = torn.join(ends, "at", "left_anti").union(torn.where(F.expr("try_parse_json(value) IS NOT NULL"))).agg(F.min("at").alias("at")).first().at
    if broken:
        raise ValueError(f"malformed journal record in {broken.file} (block {broken.block}, line {broken.line})")
    return parsed.where(whole).select("r.*", "at").drop("_torn"), torn.select("at.file", "at.line", F.col("value").alias("tail"))


def compacted(records: DataFrame, path: str) -> None:
    """What is left of a journal as one whole order of JSON lines in a new folder; the old one stays until the caller
    drops it, so a compaction that is stopped loses nothing."""
    fields = [c for c in records.columns if c != "at"]
    records.repartitionByRange("at").sortWithinPartitions("at").select(F.to_json(F.struct(*fields))).write.mode("errorifexists").text(path)


def pending(tasks: DataFrame, done: DataFrame, on: list[str], terminal: list[str], status: str = "status") -> DataFrame:
    """Tasks without a record of the same contract and a terminal status."""
    return tasks.join(done.where(F.col(status).isin(*terminal)).select(*on).distinct(), on, "left_anti")


def upsert(rows: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """`rows` without the keys of `new`, and `new`."""
    return rows.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)
