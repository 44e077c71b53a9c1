"""Operator 11: whitening by an incremental eigendecomposition.

Every partition keeps the spectrum of its centred scatter matrix and takes rows in by rank-one updates: the
new eigenvalues are the roots of the secular equation, components that do not change are deflated first, and
eigenvectors follow Löwner's formula, so they stay orthogonal. A batch of more rows than dimensions is first
turned into as many rows of the same centred scatter (the triangle of its QR); the distance of its mean from
the mean so far is one more update. Two spectra are combined in the same way, one rank-one update for each
eigenpair of the second, in a tree of at most FAN spectra a task. The final basis is refined by
Rayleigh-Ritz: all rows are projected on it, the small matrix of second moments is added up in the same tree
and diagonalised, until the measured covariance of the whitened rows is the identity.

An entry c counts as the integer floor(64 c) + 1000000, so sums are exact. A state is dimensions² numbers
whatever the number of rows; only the last one reaches the driver.

Cases: rows whose vector is null, empty, or holds a null or non-finite entry are dropped, and so are vectors
of another length than most (ties: the shortest). Repeated rows count each; a null id is kept. A component
without variance (at most 1e-12 of the largest) has whitened null, and identity_error is over the others
(null if there is none). ``deviation`` is null where it exceeds a long; ``deviation_wide`` is always exact.
Entries beyond 2^40 raise. An empty table gives an empty table. Other columns are not returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sievemark.session import stored

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
FAN = 16  # states that one task combines
LEAST = 1e-12  # share of the largest variance below which a component has none
EXACT = 1e-9  # identity error at which the refinement ends
ROUNDS = 4
EPS = np.finfo(np.float64).eps
LONG = (1 << 63) - 1

State = tuple[int, np.ndarray, np.ndarray, np.ndarray]  # rows, sums, eigenvalues (rising), eigenvectors (columns)


def _rotated(d: np.ndarray, z: np.ndarray, u: np.ndarray, kept: np.ndarray, tol: float) -> np.ndarray:
    """Turns pairs of nearly equal values so that one of the two no longer takes part; what is left of ``kept``."""
    left = []
    for j in kept:
        if left:
            i = left[-1]
            r = np.hypot(z[i], z[j])
            c, s = z[j] / r, z[i] / r
            if abs((d[j] - d[i]) * c * s) <= tol:
                u[:, i], u[:, j] = c * u[:, i] - s * u[:, j], s * u[:, i] + c * u[:, j]
                d[i], d[j] = c * c * d[i] + s * s * d[j], s * s * d[i] + c * c * d[j]
                z[i], z[j] = 0.0, r
                left.pop()
        left.append(j)
    return np.array(left, np.int64)


def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of diag(d) + z z' for strictly rising d and z without zeros, and the matrix d[k] - root[i] at [i, k].

    Each root is kept as its distance from the nearer pole and bisected on the bits of that distance, so the
    differences to all poles are accurate to the last digits.
    """
    m, square = len(d), z * z
    width = np.append(np.diff(d), square.sum() * (1 + 4 * EPS))
    middle = d + width / 2
    with np.errstate(divide="ignore", over="ignore"):
        left = 1 + (square / (d - middle[:, None])).sum(axis=1) >= 0
        left[-1] = True
        origin = np.where(left, d, np.append(d[1:], 0.0))
        sign = np.where(left, 1.0, -1.0)
        poles = d - origin[:, None]
        high = np.where(np.arange(m) == m - 1, width, width / 2).view(np.int64)
        low = np.zeros(m, np.int64)
        for _ in range(64):
            middle = low + ((high - low) >> 1)
            t = middle.view(np.float64)
            short = sign * (1 + (square / (poles - (sign * t)[:, None])).sum(axis=1)) < 0
            low, high = np.where(short, middle, low), np.where(short, high, middle)
    moved = sign * high.view(np.float64)
    return origin + moved, poles - moved[:, None]


def rank_one(values: np.ndarray, vectors: np.ndarray, column: np.ndarray, weight: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum of vectors diag(values) vectors' + weight column column'."""
    z = np.sqrt(weight) * (vectors.T @ column)
    size = np.sqrt(z @ z)
    if not size > 0:
        return values, vectors
    d, u, z = values.copy(), vectors.copy(), z.copy()
    tol = 8 * EPS * max(d[-1], size * size)
    kept = np.flatnonzero(np.abs(z) * size > tol)
    if len(kept) > 1:
        kept = _rotated(d, z, u, kept, tol)
    if len(kept):
        kept = kept[np.argsort(d[kept], kind="stable")]
        dk, zk = d[kept], z[kept]
        roots, gaps = secular_roots(dk, zk)
        m = len(dk)
        apart = dk[None, :] - dk[:, None]  # [k, i] = d_i - d_k
        low = np.tri(m, k=-1, dtype=bool)
        below = np.where(low, apart, np.column_stack([apart[:, 1:], np.ones(m)]))
        below[:, -1] = 1.0
        exact = np.sign(zk) * np.sqrt(np.abs(np.prod(-gaps.T / below, axis=1)))  # Löwner: z for which the roots are exact
        turn = exact[:, None] / gaps.T
        turn /= np.sqrt((turn * turn).sum(axis=0))
        u[:, kept] = u[:, kept] @ turn
        d[kept] = roots
    order = np.argsort(d, kind="stable")
    return d[order], u[:, order]


def empty_state(size: int) -> State:
    return 0, np.zeros(size, np.int64), np.zeros(size), np.eye(size)


def absorb(state: State, rows: np.ndarray) -> State:
    """``state`` with more integer rows."""
    n, sums, values, vectors = state
    more = rows.sum(axis=0)
    centred = rows - more / len(rows)
    if len(rows) > rows.shape[1]:
        centred = np.linalg.qr(centred, mode="r")
    for row in centred:
        values, vectors = rank_one(values, vectors, row)
    if n:
        values, vectors = rank_one(values, vectors, more / len(rows) - sums / n, n * len(rows) / (n + len(rows)))
    return n + len(rows), sums + more, values, vectors


def combined(a: State, b: State) -> State:
    """The state of the rows of both."""
    if not a[0] or not b[0]:
        return a if a[0] else b
    values, vectors = a[2], a[3]
    for value, vector in zip(b[2], b[3].T, strict=True):
        values, vectors = rank_one(values, vectors, vector, max(value, 0.0))
    values, vectors = rank_one(values, vectors, a[1] / a[0] - b[1] / b[0], a[0] * b[0] / (a[0] + b[0]))
    return a[0] + b[0], a[1] + b[1], values, vectors


def integers(column: pa.ListArray, size: int) -> np.ndarray:
    """floor(64 c), without the shift that no covariance sees."""
    c = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(c) and np.abs(c).max() > 1 << 40:
        raise ValueError("an entry is beyond 2^40 / 64")
    return c.astype(np.int64).reshape(-1, size)


def _tree(rows: DataFrame, merge: Callable[[list[list]], list], name: str) -> list | None:
    """One row of all rows ``(part, ...)``: at most FAN of them meet in a task, round after round."""
    schema, columns = rows.schema, rows.columns
    types = list(to_arrow_schema(schema).types)
    rows = stored(rows, name)
    count = rows.count()

    def run(table: pa.Table) -> pa.Table:
        parts = sorted(zip(*(table.column(c).to_pylist() for c in columns), strict=True))
        made = [parts[0][0] // FAN, *merge([list(p[1:]) for p in parts])]
        return pa.table([pa.array([x], t) for x, t in zip(made, types, strict=True)], names=columns)

    while count > 1:
        rows = stored(rows.groupBy(F.expr(f"part div {FAN}").alias("_g")).applyInArrow(run, schema), name)
        count = rows.count()
    last = rows.first()
    return list(last[1:]) if last else None


def _usable(vectors: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, int]:
    v = F.col(embedding)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = vectors.where(v.isNotNull() & (F.size(v) > 0)).where(good).select(F.col(vec_id).alias("vec_id"), v.alias("v"))
    most = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.where(F.size("v") == (most["size"] if most else 1)), int(most["size"]) if most else 1


def spectrum(rows: DataFrame, size: int) -> State:
    """The state of all rows: spectra of partitions, combined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = empty_state(size)
        for batch in batches:
            if batch.num_rows:
                state = absorb(state, integers(batch.column("v"), size))
        if state[0]:
            made = [TaskContext.get().partitionId(), state[0], state[1].tolist(), state[2].tolist(), state[3].ravel().tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(made, types, strict=True)], names)

    names = ["part", "n", "sums", "values", "vectors"]
    types = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64())]

    def loaded(p: list) -> State:
        return p[0], np.array(p[1], np.int64), np.array(p[2]), np.array(p[3]).reshape(size, size)

    def merge(parts: list[list]) -> list:
        state = loaded(parts[0])
        for p in parts[1:]:
            state = combined(state, loaded(p))
        return [state[0], state[1].tolist(), state[2].tolist(), state[3].ravel().tolist()]

    schema = "part int, n long, sums array<long>, values array<double>, vectors array<double>"
    last = _tree(rows.select("v").mapInArrow(run, schema), merge, "spectra")
    return loaded(last) if last else empty_state(size)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exact: as long, or as Python integers where a long might not hold it."""
    if n * float(max(1, np.abs(x).max(initial=0))) + float(np.abs(sums).max(initial=0)) < 2.0**62:
        return n * x - sums
    return n * x.astype(object) - sums.astype(object)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (_deviations(x, n, sums) / n).astype(np.float64)


def second_moments(rows: DataFrame, size: int, n: int, sums: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The covariance of the centred rows projected on ``basis``, added up over all rows."""
    width = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                y = _centred(integers(batch.column("v"), size), n, sums) @ basis
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.ravel()], pa.list_(pa.float64()))], ["part", "moments"])

    def merge(parts: list[list]) -> list:
        return [np.sum([p[0] for p in parts], axis=0).tolist()]

    last = _tree(rows.select("v").mapInArrow(run, "part int, moments array<double>"), merge, "moments")
    return np.array(last[0]).reshape(width, width) / n


def refined(rows: DataFrame, size: int, state: State) -> tuple[np.ndarray, np.ndarray, float | None, float]:
    """``(variances, basis, identity_error, trace)`` of the leading components, by Rayleigh-Ritz over all rows."""
    n, sums = state[0], state[1]
    basis = np.linalg.qr(state[3][:, ::-1])[0]
    top = min(COMPONENTS, size)
    error = None
    for _ in range(ROUNDS):
        moments = second_moments(rows, size, n, sums, basis)
        values, turn = np.linalg.eigh((moments + moments.T) / 2)
        values, basis = np.maximum(values[::-1], 0.0), np.linalg.qr(basis @ turn[:, ::-1])[0]
        alive = values[:top] > LEAST * values[0]
        if not alive.any():
            return values[:top], basis[:, :top], None, float(values.sum())
        white = basis[:, :top][:, alive] / np.sqrt(values[:top][alive])
        error = float(np.abs(second_moments(rows, size, n, sums, white) - np.eye(white.shape[1])).max())
        if error <= EXACT:
            break
    return values[:top], basis[:, :top], error, float(values.sum())


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(vec_id, component, n, deviation, deviation_wide, whitened, explained, identity_error)``."""
    rows, size = _usable(vectors, vec_id, embedding)
    key = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {key}, component int, n long, deviation long, deviation_wide decimal(38,0), whitened double, explained double, identity_error double"
    rows = stored(rows, "vectors")
    state = spectrum(rows, size)
    if not state[0]:
        return rows.sparkSession.createDataFrame([], schema)
    n, sums = state[0], state[1]
    values, basis, error, trace = refined(rows, size, state)
    top, alive = len(values), values > LEAST * values[0]
    white = basis / np.sqrt(np.where(alive, values, 1.0))
    share = values / trace if trace > 0 else np.zeros(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                away = _deviations(integers(batch.column("v"), size), n, sums)
                w = (away / n).astype(np.float64) @ white
                if away.dtype != object and float(np.abs(away).max()) ** 2 * size > LONG:
                    away = away.astype(object)
                squares = (away * away).sum(axis=1).tolist()
                each = np.repeat(np.arange(len(w)), top)
                fits = pa.array([s if s <= LONG else None for s in squares], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, top + 1, dtype=np.int32), len(w))),
                        pa.array(np.full(len(each), n, np.int64)),
                        fits.take(pa.array(each)),
                        pa.array([Decimal(s) for s in squares], pa.decimal128(38, 0)).take(pa.array(each)),
                        pa.array(w.ravel(), mask=np.tile(~alive, len(w))),
                        pa.array(np.tile(share, len(w))),
                        pa.array([error] * len(each), pa.float64()),
                    ],
                    ["vec_id", "component", "n", "deviation", "deviation_wide", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema)
