"""The pipeline against its stages worked out one by one in plain Python."""

from __future__ import annotations

from collections import defaultdict

import corpus_pipeline
from conftest import DATA
from pyspark.sql import functions as F

from haulmark.llm import decontam, queries, toxicity
from haulmark.llm.common import table

SF = str(DATA / "sf0.001")


def test_each_stage_takes_effect_and_keeps_clean_documents(spark):
    docs = table(spark, SF, "documents")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    kept, at = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, SF)
        kept[name] = ids(at)
        assert at.count() == len(kept[name])
        assert name == "extendible_sharding" or at.columns == docs.columns
    a, b, c, d, e = (kept[n] for n, _ in corpus_pipeline.STAGES)
    assert ids(docs) >= a >= b >= c >= d == e
    # toxicity: what the model predicts
    scored = toxicity.score(docs, queries.toxicity_model(spark, SF, docs))
    assert a == ids(scored.where("predicted = 0"))
    # one document of each group
    groups = defaultdict(set)
    from test_corpus_operators import linked_groups

    for k, _, component in linked_groups([(r.doc_id, r.text) for r in docs.where(F.col("doc_id").isin(*a)).collect()]):
        groups[component].add(k)
    assert b == {min(g) for g in groups.values()}
    # contaminated ones go
    found = decontam.search(docs.where(F.col("doc_id").isin(*b)), table(spark, SF, "benchmark"))
    assert c == ids(found.where("not leak.contaminated"))
    assert ids(corpus_pipeline.run(spark, SF)) == e


def test_odd_rows_pass_through(spark):
    docs = table(spark, SF, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", "src0", 0), (10**9 + 1, "hello there", "en", "src0", 11), (10**9 + 1, "hello there", "en", "src0", 11)], docs.schema)
    at = odd
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, SF)
    assert sorted((r.doc_id is None, r.text or "") for r in at.select("doc_id", "text").collect())[:2] == [(False, ""), (False, "hello there")]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_columns_may_have_the_names_inside(spark):
    names = "row at kept copy leak verdict score predicted copies epoch block group key node n component_id _row _at _kept".split()
    rows = [(i, f"w{i} " * 20 + "the same words again and again", "en", f"src{i % 3}", 9) for i in range(12)] + [(3, "w3 " * 20 + "the same words again and again", "en", "src0", 9)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = plain.select("*", *(F.lit(f"mine {n}").alias(n) for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, clash, SF)
        assert found.columns == clash.columns
        got = found.collect()
        assert all(r[n] == f"mine {n}" for r in got for n in names)
        assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in stage(spark, plain, SF).collect()), name


def test_a_tiny_source_costs_no_document(spark):
    rows = [(i, "w " * 50, "hot" if i % 2 else f"src{i % 19}") for i in range(760)] + [(1000, "one", "tiny"), (1001, None, "hot"), (1002, "", "src2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {r.doc_id: r["count"] for r in corpus_pipeline.mixed(spark, docs, SF).groupBy("doc_id").count().collect()}
    assert set(taken) == {r[0] for r in rows}
    assert taken[1000] == 4 and max(taken.values()) <= 4
    words = lambda hot: sum(50 * taken[i] for i in range(760) if (i % 2 > 0) == hot)
    assert words(True) == 50 * 380 < words(False)  # the largest source once, smaller ones more often
