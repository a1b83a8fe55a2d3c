"""Whitened embeddings against numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from conftest import DATA

from haulmark.llm import queries, whitening
from haulmark.llm.common import table

SF = str(DATA / "sf0.001")


def expected(vectors: list[list[float]]) -> tuple:
    x = np.floor(256 * np.array(vectors, float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    values, directions = np.linalg.eigh(np.cov(fit.T, bias=True).reshape(x.shape[1], -1))
    values, directions = values[::-1], directions[:, ::-1]
    return n, ((n * x - sums) ** 2).sum(1), (x - sums / n) @ directions / np.sqrt(np.maximum(values, 1e-300)), values / values.sum()


def check(rows: list, vectors: list[list[float]], keys: list, key: str, components: int = 4) -> None:
    n, far, white, explained = expected(vectors)
    assert len(rows) == len(vectors) * components
    for c in range(components):
        mine = sorted((r for r in rows if r.component == c + 1), key=lambda r: (r[key], r.whitened))
        order = sorted(range(len(keys)), key=lambda i: keys[i])
        sign = max((1, -1), key=lambda s: sum(s * w * r.whitened for w, r in zip(white[order, c], mine, strict=True)))
        for i, r in zip(order, mine, strict=True):
            assert (r[key], r.n, r.deviation) == (keys[i], n, far[i])
            assert r.whitened == pytest.approx(sign * white[i, c], abs=1e-8) and r.explained == pytest.approx(explained[c], rel=1e-9)
            assert r.identity_error < 1e-9


def test_of_the_table(spark):
    rows = [r for r in table(spark, SF, "embeddings").collect() if r.embedding is not None and all(v is not None and math.isfinite(v) for v in r.embedding)]
    check(queries.op12_whitened_embeddings(spark, SF).collect(), [r.embedding for r in rows], [r.vec_id for r in rows], "vec_id")


def test_rows_without_usable_vectors_go_and_copies_are_fitted_once(spark):
    rng = np.random.default_rng(3)
    good = [(int(i), [float(v) for v in rng.normal(size=3) * (1, 2, 5)]) for i in range(30)]
    good += [good[0]] * 20
    bad = [(90, None), (91, [1.0, None, 2.0]), (92, [float("nan"), 1.0, 2.0]), (93, [float("inf"), 1.0, 2.0])]
    # the key is called as an added column is
    docs = spark.createDataFrame(good + bad, "component long, v array<double>").withColumnRenamed("component", "whitened").repartition(7)
    got = whitening.whiten(docs, "v", "whitened", 3)
    assert got.columns == ["whitened", "component", "n", "deviation", "_whitened", "explained", "identity_error"]
    renamed = got.withColumnsRenamed({"whitened": "id"}).withColumnRenamed("_whitened", "whitened").collect()
    check(renamed, [v for _, v in good], [k for k, _ in good], "id", 3)


def test_short_constant_huge_and_no_rows(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whiten(frame([(1, [1.0]), (2, [1.0, 0.0]), (3, [2.0, 5.0]), (4, []), (None, [0.0, 1.0])])).collect()
    assert {r.vec_id for r in got} == {1, 2, 3, 4, None} and {r.component for r in got} == {1, 2} and {r.n for r in got} == {4}
    assert whitening.whiten(frame([(1, [3.0, 3.0]), (2, [3.0, 3.0])])).count() == 0
    assert whitening.whiten(frame([])).count() == 0 and whitening.whiten(frame([(1, None)])).count() == 0 and whitening.whiten(frame([(1, []), (2, [])])).count() == 0
    wide = whitening.whiten(frame([(1, [1e300, 0.0]), (2, [0.0, 1.0])])).collect()
    assert all(r.deviation is None and math.isfinite(r.whitened) for r in wide) and len(wide) == 2


def test_deviations_are_exact_beyond_doubles():
    x = np.array([[3, -(1 << 40)], [1 << 41, 7]], np.int64)
    sums = [int(s) for s in x.sum(0)]
    assert whitening.deviations(x, 2, sums) == [sum((2 * int(v) - s) ** 2 for v, s in zip(r, sums, strict=True)) for r in x]
