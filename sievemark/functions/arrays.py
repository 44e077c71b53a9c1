"""Column functions on probability, logit and embedding arrays."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(values: Column | str) -> Column:
    return F.aggregate(_col(values), F.lit(0.0), lambda a, v: a + v)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column | str) -> Column:
    """The vector divided by its length, which is taken as at least 1e-12."""
    length = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(_col(v), lambda x: x.cast("double") / length)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-12)) * F.greatest(norm(b), F.lit(1e-12)))


def softmax(logits: Column | str, temperature: float | Column = 1.0) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    top = F.array_max(_col(logits))
    powers = F.transform(_col(logits), lambda z: F.exp((z - top) / t))
    return F.transform(powers, lambda e: e / total(powers))


def argmax(values: Column | str) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(_col(values), F.array_max(_col(values))) - 1).cast("int")


def probability_of(probs: Column | str, label: Column | str) -> Column:
    return F.get(_col(probs), _col(label))


def nll_term(probs: Column | str, label: Column | str, floor: float = 1e-12) -> Column:
    return -F.log(probability_of(probs, label) + F.lit(floor))


def energy(logits: Column | str, temperature: float = 1.0) -> Column:
    """-T · log Σ exp(z / T), shifted by the maximum."""
    t = F.lit(float(temperature))
    top = F.array_max(_col(logits)) / t
    return -t * (top + F.log(total(F.transform(_col(logits), lambda z: F.exp(z / t - top)))))


def prediction_set(probs: Column | str, qhat: float | Column) -> Column:
    """Classes with p ≥ 1 - q̂ and always the top one, most probable first (ties: lower class)."""
    q = qhat if isinstance(qhat, Column) else F.lit(float(qhat))
    top = argmax(probs)
    pairs = F.transform(
        _col(probs), lambda p, i: F.struct((-p).alias("order"), i.cast("int").alias("cls"))
    )
    kept = F.filter(pairs, lambda s: (-s["order"] >= 1.0 - q) | (s["cls"] == top))
    return F.transform(F.array_sort(kept), lambda s: s["cls"])


def ranked_classes(probs: Column | str, floor: float) -> Column:
    """Classes with p ≥ floor, most probable first."""
    pairs = F.transform(
        _col(probs), lambda p, i: F.struct((-p).alias("order"), i.cast("int").alias("cls"))
    )
    return F.transform(
        F.array_sort(F.filter(pairs, lambda s: -s["order"] >= floor)), lambda s: s["cls"]
    )


def candidate_classes(probs: Column | str, members: Column, floor: float = 0.15, limit: int = 3) -> Column:
    """The prediction set when it names several classes, else the likely ones; first three."""
    named = F.when(F.size(members) >= 2, members).otherwise(ranked_classes(probs, floor))
    return F.slice(named, 1, limit)


def trapezoid(y: Column | str, x: Sequence[float]) -> Column:
    """Area under the curve through (x, y), divided by the last x."""
    grid = F.array(*[F.lit(float(v)) for v in x])
    steps = F.transform(
        F.sequence(F.lit(1), F.lit(len(x) - 1)),
        lambda i: (F.get(grid, i) - F.get(grid, i - 1)) * (F.get(_col(y), i) + F.get(_col(y), i - 1)) / 2,
    )
    return total(steps) / F.lit(float(x[-1]))


def to_matrix(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of an Arrow list column as a 2-D float64 array, without Python objects.

    Returns the rows that are not NULL and the mask of those rows in the column; the vectors must
    agree in length.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    present = column.is_valid().to_numpy(zero_copy_only=False)
    known = column.drop_null()
    if len(known) == 0:
        return np.zeros((0, 0)), present
    widths = known.value_lengths().to_numpy(zero_copy_only=False)
    if (widths != widths[0]).any():
        raise ValueError(f"vectors of {widths.min()} to {widths.max()} components in one column")
    flat = known.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(known), -1), present


def spread_out(values: pa.Array, present: np.ndarray) -> pa.Array:
    """Results of the rows that :func:`to_matrix` kept, with NULL for the others."""
    if present.all():
        return values
    at = np.cumsum(present) - 1
    return values.take(pa.array(at, pa.int64(), mask=~present))


def from_matrix(matrix: np.ndarray) -> pa.Array:
    width = matrix.shape[1] if matrix.ndim == 2 else 0
    offsets = np.arange(0, (len(matrix) + 1) * width, width, dtype=np.int32)
    if width == 0:
        offsets = np.zeros(len(matrix) + 1, dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).ravel()))


def linear_scores(vectors: Column | str, weights: np.ndarray, bias: np.ndarray | None = None) -> Column:
    """vectors · weightsᵀ + bias as an array column: one matrix product per Arrow batch.

    ``weights`` has one row per class, so its size is set by the class list, not by the data.
    """
    w = np.asarray(weights, dtype=np.float64)
    b = np.zeros(len(w)) if bias is None else np.asarray(bias, dtype=np.float64)

    @F.arrow_udf("array<double>")
    def scores(v: pa.Array) -> pa.Array:
        x, present = to_matrix(v)
        if not len(x):
            return pa.nulls(len(v), pa.list_(pa.float64()))
        return spread_out(from_matrix(x @ w.T + b), present)

    return scores(_col(vectors))


def quadratic_scores(vectors: Column | str, means: np.ndarray, precision: np.ndarray) -> Column:
    """Smallest dᵀPd over the class means d is measured from (squared distance, no root)."""
    m = np.asarray(means, dtype=np.float64)
    p = np.asarray(precision, dtype=np.float64)

    @F.arrow_udf("double")
    def scores(v: pa.Array) -> pa.Array:
        x, present = to_matrix(v)
        if not len(x):
            return pa.nulls(len(v), pa.float64())
        best = np.full(len(x), np.inf)
        for mean in m:
            d = x - mean
            best = np.minimum(best, np.einsum("ij,jk,ik->i", d, p, d))
        return spread_out(pa.array(best), present)

    return scores(_col(vectors))


def whitened_distance(vectors: Column | str, means: np.ndarray, covariance: np.ndarray) -> Column:
    """Smallest squared Mahalanobis distance to a class mean, without an inverse of the covariance.

    With covariance = LLᵀ the distance is |L⁻¹x - L⁻¹m|²: each Arrow batch is whitened by one product and then
    compared with the whitened means. NULL vectors give NULL.
    """
    lower = np.linalg.cholesky(np.asarray(covariance, dtype=np.float64))
    whiten = np.linalg.solve(lower, np.eye(len(lower)))
    targets = np.asarray(means, dtype=np.float64) @ whiten.T

    @F.arrow_udf("double")
    def scores(v: pa.Array) -> pa.Array:
        x, present = to_matrix(v)
        if not len(x):
            return pa.nulls(len(v), pa.float64())
        z = x @ whiten.T
        best = np.full(len(z), np.inf)
        for target in targets:
            best = np.minimum(best, ((z - target) ** 2).sum(axis=1))
        return spread_out(pa.array(best), present)

    return scores(_col(vectors))
