"""The registered queries of the corpus operators, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, lm_score, media, mixing, ngram_join, oracles, recompression, secrets, sharding, spelling, suffix_dedup, tokens, toxicity, whitening
from .common import table

TOKEN_LIMIT = 512
#: Bytes of a shard; small enough for the given tables to have many.
SHARD_BYTES = 1 << 20
#: The mixture's entropy as a share of the sources' most, its size in sizes of the corpus, and how often a source may be repeated.
ENTROPY_SHARE, BUDGET, MAX_REPEATS = 0.9, 1.0, 4.0


def op1_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", F.struct("source", "lang").alias("repo"), F.col("source").alias("owner"))
    found = secrets.scan(docs)
    base = F.filter("spans", lambda s: s["kind"] < 3)

    def counted(kind: int) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{secrets.KINDS[kind]}")

    return found.select(
        "doc_id", *map(counted, range(3)), F.sha2(secrets.joined_spans(base), 256).alias("base_sha256"), secrets.joined_spans(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_copied"),
        *(F.coalesce(F.array_max(F.transform("spans", lambda s: s[f"n_{what}"])), F.lit(0)).cast("long").alias(f"most_{what}") for what in ("owners", "repos")),  # noqa: B023
    )


def op2_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.search(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "leak.*")


def op3_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), SHARD_BYTES).select("doc_id", "n_bytes", "shard", "shard_depth", "shard_part", "shard_bytes")


def op7_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), ENTROPY_SHARE, MAX_REPEATS, BUDGET)
    return mixed.select("doc_id", "source", "n_tokens", F.round("weight", 9).alias("weight"), "copies", "epoch", "block")


def op4_shingle_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op5_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_column(media.encode_column(table(spark, sf_dir, "documents")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def remainder(divisor: int) -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % divisor


def op9_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Model:
    """Learned from the labels of the rows whose remainder by 3 is not 1."""
    return toxicity.fit(toxicity.labelled(docs, table(spark, sf_dir, "labels"), remainder(3) != 1))


def op8_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, sf_dir, docs))
    return scored.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op10_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"), remainder(7) == 2, public_tokenizers.path("piece_bpe_32k.model"))


def op11_repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recompression.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), (F.size("spans") / 2).cast("long").alias("n_spans"))


def op12_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {"op9_repeated_bytes": op9_repeated_bytes, "op4_shingle_components": op4_shingle_components, "op1_secret_ownership": op1_secret_ownership, "op2_benchmark_leaks": op2_benchmark_leaks, "op3_extendible_shards": op3_extendible_shards, "op7_temperature_mix": op7_temperature_mix, "op8_toxic_segments": op8_toxic_segments, "op5_jpeg_media": op5_jpeg_media, "op6_token_counts": op6_token_counts, "op10_lattice_scores": op10_lattice_scores, "op11_repeated_words": op11_repeated_words, "op12_whitened_embeddings": op12_whitened_embeddings, "op13_spelling_variants": op13_spelling_variants}

ORACLES = {
    "op1_secret_ownership": oracles.SECRETS,
    "op3_extendible_shards": oracles.shards(SHARD_BYTES),
    "op7_temperature_mix": oracles.mixture(ENTROPY_SHARE, MAX_REPEATS, BUDGET),
}
