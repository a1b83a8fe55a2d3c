"""Whitening of embeddings by the singular values of the centred rows.

Entries become whole numbers, so that sums, the rows that are fitted on and deviations are exact.
The fit list has each distinct row once. Its rows, centred by their mean, are a distributed matrix of
Spark's MLlib; `computeSVD` gives all its singular values s and right vectors, from which the
covariance's eigenvalues are s * s / n (the divisor is n, not n - 1). The total variance isn't the sum
of the eigenvalues but comes from the exact deviations of the rows. What the driver gets is bounded by
the number of dimensions: sums, singular values and vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize, small_batches, unused

#: Entries are counted in units of 1 / SCALE.
SCALE = 256
#: The largest whole number that an entry becomes; beyond it entries are cut to it.
MOST = 1 << 62
#: Bound under which sums of products stay inside 64 bits.
SAFE = 1 << 62
EXACT = pa.decimal128(38, 0)


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite."""
    whole = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce(vector.isNotNull() & whole, F.lit(False))


def whole_entries(vector: Column) -> Column:
    """floor(SCALE * c) of each entry c, as a long."""
    most = float(MOST)
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(most)), F.lit(-most))))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _largest(x: np.ndarray) -> int:
    return max((abs(int(v)) for v in (x.max(initial=0), x.min(initial=0))))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """sum((n * x - sums) ** 2) of each row, exactly."""
    bound = n * _largest(x) + max(map(abs, sums), default=0)
    if bound * bound * max(1, len(sums)) < SAFE:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    wide = n * x.astype(object) - np.array(sums, object)
    return (wide**2).sum(1).tolist()


class Model:
    """n, the whole sums, and of each component the direction, the eigenvalue and its share of the variance."""

    def __init__(self, n: int, sums: list[int], directions: np.ndarray, eigenvalues: np.ndarray, explained: np.ndarray, identity_error: float) -> None:
        self.n, self.sums, self.directions, self.eigenvalues, self.explained, self.identity_error = n, sums, directions, eigenvalues, explained, identity_error

    def whitened(self, x: np.ndarray) -> np.ndarray:
        centred = x.astype(float) - np.array([s / self.n for s in self.sums])
        return centred @ self.directions / np.sqrt(self.eigenvalues)


def _sums(fit: DataFrame, dims: int) -> list[int]:
    """The exact sum of each dimension."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dims
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            some = x.sum(0).tolist() if _largest(x) * max(1, len(x)) < SAFE else x.astype(object).sum(0).tolist()
            total = [a + b for a, b in zip(total, some, strict=True)]
        yield pa.record_batch([pa.array(range(dims), pa.int32()), pa.array([Decimal(t) for t in total], EXACT)], ["dim", "s"])

    rows = fit.select("x").mapInArrow(per_batch, "dim int, s decimal(38,0)").groupBy("dim").agg(F.sum("s").alias("s")).collect()
    found = {r.dim: int(r.s) for r in rows}
    return [found.get(i, 0) for i in range(dims)]


def _total_deviation(fit: DataFrame, n: int, sums: list[int]) -> int:
    """The sum of all rows' deviations, exactly."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            total += sum(deviations(_matrix(batch.column(0), len(sums)), n, sums))
        yield pa.record_batch([pa.array([str(total)])], ["total"])

    parts = fit.select("x").mapInArrow(per_batch, "total string")
    wide = parts.agg(F.sum(F.expr("try_cast(total AS decimal(38,0))")).alias("s"), F.count_if(F.expr("try_cast(total AS decimal(38,0)) IS NULL")).alias("wider")).first()
    # one number a task where a sum has over 38 digits
    return int(wide.s or 0) if not wide.wider else sum(int(r.total) for r in parts.collect())


def _identity_error(fit: DataFrame, model: Model) -> float:
    """The largest entry of the whitened fit rows' covariance minus the identity."""
    k = model.directions.shape[1]

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = model.whitened(_matrix(batch.column(0), len(model.sums)))
            first += w.sum(0)
            second += w.T @ w
        yield pa.record_batch([pa.array(range(k + k * k), pa.int32()), pa.array(np.concatenate((first, second.ravel())))], ["at", "s"])

    rows = fit.select("x").mapInArrow(per_batch, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()
    got = np.zeros(k + k * k)
    got[[r["at"] for r in rows]] = [r.s for r in rows]
    mean = got[:k] / model.n
    return float(np.abs(got[k:].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def fit_model(rows: DataFrame, components: int) -> Model | None:
    """The model of the distinct `x` of `rows`, all as long, with so many components at most; None without rows or variance."""
    fit = materialize(rows.select("x").distinct())
    try:
        n, dims = fit.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
        if not n or not dims:
            return None
        sums = _sums(fit, dims)
        total = _total_deviation(fit, n, sums)
        if not total:
            return None
        centred = F.zip_with("x", F.array(*(F.lit(s / n) for s in sums)), lambda a, m: a - m)
        vectors = MLUtils.convertVectorColumnsFromML(fit.select(array_to_vector(centred).alias("v")), "v")
        # all of them: then MLlib solves the Gramian matrix by LAPACK, to double precision, not by iteration
        svd = RowMatrix(vectors, n, dims).computeSVD(dims)
        values, directions = svd.s.toArray(), svd.V.toArray()
        kept = min(components, len(values))
        eigenvalues, directions = values[:kept] ** 2 / n, directions[:, :kept]
        # either sign is right: the entry of the largest size is positive, the same way in each run
        directions = directions * np.where(directions[np.abs(directions).argmax(0), np.arange(kept)] < 0, -1.0, 1.0)
        explained = np.array([float(Decimal(float(e)) * n**3 / total) for e in eigenvalues])
        model = Model(n, sums, directions, eigenvalues, explained, 0.0)
        model.identity_error = _identity_error(fit, model)
        return model
    finally:
        forget(fit)


#: Columns that are added.
ADDED = ["component", "n", "deviation", "whitened", "explained", "identity_error"]


def whiten(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = 4) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): for each row of a usable vector and
    each component from 1, by falling eigenvalue.

    Rows whose vector is null or has a null or non-finite entry are left out; a short vector counts
    as ending in zeros, an empty one as zeros; entries beyond 2**62 units are cut to that. Repeated
    rows are all returned and fitted on once. Null keys stay. A key with the name of an added column
    keeps its name and the added one gets underscores. Equal eigenvalues have directions that are
    not unique; the same ones hold for all rows. Components without variance are left out, so constant
    rows, one row and an empty table give an empty result. A deviation over a long's range is null. Other
    columns are left out, and long texts play no part.
    """
    small_batches(rows.sparkSession)
    kept = rows.select(F.col(key).alias("key"), F.col(vector).alias("v")).where(usable(F.col("v"))).select("key", whole_entries(F.col("v")).alias("x"))
    # short rows end in zeros
    dims = kept.agg(F.max(F.size("x"))).first()[0] or 0
    kept = kept.select("key", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x"))).alias("x"))
    model = fit_model(kept, components)
    kind, names = rows.schema[key].dataType.simpleString(), unused([key], *ADDED)
    schema = f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        out = rows.sparkSession.createDataFrame([], schema)
    else:
        shared = rows.sparkSession.sparkContext.broadcast(model.__dict__)

        def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Model(**shared.value)
            k = len(own.eigenvalues)
            for batch in batches:
                x = _matrix(batch.column(1), len(own.sums))
                far = [d if d < 1 << 63 else None for d in deviations(x, own.n, own.sums)]
                row = np.repeat(np.arange(len(x)), k)
                columns = [
                    batch.column(0).take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(row), own.n)), pa.array(far, pa.int64()).take(pa.array(row)),
                    pa.array(own.whitened(x).ravel()), pa.array(np.tile(own.explained, len(x))), pa.array(np.full(len(row), own.identity_error)),
                ]
                yield pa.record_batch(columns, ["key", *ADDED])

        out = kept.mapInArrow(per_batch, schema)
    return out.select(F.col("key").alias(key), *(F.col(a).alias(b) for a, b in zip(ADDED, names, strict=True)))
