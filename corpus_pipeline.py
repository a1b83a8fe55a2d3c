"""The corpus pipeline: toxicity, n-gram Jaccard join, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but
the last return the columns of `docs`, whatever they are called. Null and empty texts are clean:
they pass every stage, are alike with nothing and hold no item; very long texts are looked at whole;
null keys and sources are kept; an empty table stays empty. `docs` is read several times by most
stages and has to give the same rows each time, as a table does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.llm import decontam, mixing, ngram_join, sharding, toxicity
from haulmark.llm.common import forget, keep_keys, materialize, numbered, table, unused
from haulmark.llm.queries import ENTROPY_SHARE, SHARD_BYTES, toxicity_model

#: How often the mixture may repeat a source while it has every document once.
REPEATS = 4.0


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go, those at the threshold too; equal texts go or stay together."""
    name, = unused(docs.columns, "kept")
    scored = toxicity.score(docs.select("*", F.struct("*").alias(name)), toxicity_model(spark, sf_dir, docs))
    return scored.where(F.col("predicted") == 0).select(*(F.col(name)[c].alias(c) for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the smallest doc_id, of repeated rows one, of rows without a doc_id
    those that have no other in their group.

    Rows are told apart by their place in the input, so the row that stays of a doc_id is its first.
    """
    columns = docs.columns
    row, at = unused(columns, "row", "at")
    docs = numbered(docs, row)
    found = ngram_join.join(docs.select("text", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("row")).alias(at)), key=at)
    lost = materialize(found.where(F.col(at) != F.col("component_id")).select(F.col(at)["row"].alias(row)))
    return keep_keys(docs, lost, row, "left_anti").select(*columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    name, = unused([*docs.columns, "leak"], "kept")
    found = decontam.search(docs.select("text", F.struct("*").alias(name)), table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("leak.contaminated")).select(*(F.col(name)[c].alias(c) for c in docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mixture asks for, one at least: small sources are repeated, none is cut."""
    name, = unused([*docs.columns, *mixing.ADDED], "kept")
    found = mixing.mix(docs.select("doc_id", "text", "source", F.struct("*").alias(name)), ENTROPY_SHARE, REPEATS, whole=True)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return found.select(name, copies.alias("copy")).select(*(F.col(name)[c].alias(c) for c in docs.columns))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with the shard that they are written to."""
    return sharding.shard(docs, SHARD_BYTES)


STAGES = [
    ("toxicity", toxic),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", decontaminated),
    ("temperature_mixing", mixed),
    ("extendible_sharding", sharded),
]

#: SQL expresses neither the toxicity model nor the BM25 search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)  # written as Parquet and read again
            if before is not None:
                forget(before)
            before = docs
    return docs
