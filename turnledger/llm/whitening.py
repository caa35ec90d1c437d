"""Embedding whitening: covariance on Spark, eigenpairs by contour integration, inertia counts as a proof of completeness."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.session import materialize

COMPONENTS = 16
NODES = 8  # quadrature points on the upper half of a contour
PER_CONTOUR = 6  # eigenvalues that one contour should hold
FLOOR = 1e-11
SCALE, SHIFT = 64, 1_000_000


# ---- eigenpairs of a symmetric matrix -----------------------------------------------------------------------------

def count_above(v: np.ndarray, shift: float) -> int:
    """Eigenvalues of ``v`` above ``shift``: the positive inertia of ``v - shift`` by Sylvester's law.

    The factorisation L D L^T takes pivots of one or two rows, each the largest that is left (complete pivoting).
    """
    a = v - shift * np.eye(len(v))
    positive, bound = 0, (1 + np.sqrt(17)) / 8
    while len(a):
        i = int(np.argmax(np.abs(np.diag(a))))
        r, c = np.unravel_index(int(np.argmax(np.abs(a))), a.shape)
        if a[r, c] == 0:
            break
        if abs(a[i, i]) >= bound * abs(a[r, c]):
            rest = np.delete(np.arange(len(a)), i)
            positive += a[i, i] > 0
            a = a[np.ix_(rest, rest)] - np.outer(a[rest, i], a[i, rest]) / a[i, i]
        else:  # a pivot of two rows has one eigenvalue of each sign
            rest = np.delete(np.arange(len(a)), [r, c])
            both = a[np.ix_([r, c], [r, c])]
            positive += 1
            a = a[np.ix_(rest, rest)] - a[np.ix_(rest, [r, c])] @ np.linalg.solve(both, a[np.ix_([r, c], rest)])
    return int(positive)


def _cut(v: np.ndarray, wanted: int, low: float, high: float) -> tuple[float, int]:
    """A shift in a gap of the spectrum with at least ``wanted`` eigenvalues above it, and their number.

    Bisection by inertia counts; eigenvalues that it cannot tell apart go into one interval. ``low`` has at least
    ``wanted`` eigenvalues above it.
    """
    above, close = count_above(v, low), 1e-10 * (high - low)
    while high - low > close:
        middle = (low + high) / 2
        n = count_above(v, middle)
        if n >= wanted:
            low, above = middle, n
        else:
            high = middle
    # ``low`` lies just below the last eigenvalue above it: move down into the gap, away from both its ends.
    for step in (abs(low) * 2.0 ** -k for k in range(1, 50)):
        if count_above(v, low - step) == above:
            return low - step / 2, above
    return low, above


def _project(v: np.ndarray, low: float, high: float, block: np.ndarray) -> np.ndarray:
    """The spectral projector of [low, high] applied to ``block``: Gauss-Legendre points on the circle over it.

    A point and its mirror image add up to twice a real part, so only the upper half is solved.
    """
    points, weights = np.polynomial.legendre.leggauss(NODES)
    centre, radius = (low + high) / 2, (high - low) / 2
    out = np.zeros_like(block)
    for x, w in zip(points, weights):
        turn = np.exp(1j * np.pi / 2 * (1 - x))
        solved = np.linalg.solve((centre + radius * turn) * np.eye(len(v)) - v, block.astype(complex))
        out += w / 2 * np.real(radius * turn * solved)
    return out


def _ritz(v: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rayleigh-Ritz values and vectors, falling, of the subspace that ``block`` spans."""
    basis = np.linalg.qr(block)[0]
    basis = np.linalg.qr(basis)[0]
    small = basis.T @ v @ basis
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return values[::-1], (basis @ vectors)[:, ::-1]


def _inside(v: np.ndarray, low: float, high: float, expected: int, rng: np.random.Generator, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """All ``expected`` eigenpairs in (low, high]: project, Rayleigh-Ritz, repeat until the residuals are at rounding.

    The subspace has room for the eigenvalues near the circle, which the quadrature hardly damps; inertia counts them.
    """
    reach, scale = (high - low) / 2, np.abs(v).sum(axis=0).max()
    size = min(len(v), count_above(v, low - reach) - count_above(v, high + reach) + 4)
    block = rng.standard_normal((len(v), size))
    for _ in range(rounds):
        values, vectors = _ritz(v, _project(v, low, high, block))
        block = vectors
        held = (values > low) & (values <= high)
        residual = np.linalg.norm(v @ vectors[:, held] - vectors[:, held] * values[held], axis=0)
        if held.sum() == expected and residual.max(initial=0) <= 1e-13 * scale:
            break
    if held.sum() != expected:
        raise ArithmeticError(f"{held.sum()} of {expected} eigenvalues found in an interval")
    return values[held], vectors[:, held]


def leading_pairs(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric positive semidefinite matrix, falling, and unit eigenvectors.

    Inertia counts cut the axis into intervals of few eigenvalues each and say how many must be found there; contour
    integration finds them. Eigenvalues below ``FLOOR`` of the largest row sum count as zero and are left out: rounding
    leaves them less than four digits.
    """
    scale = np.abs(v).sum(axis=0).max(initial=0)
    floor = FLOOR * scale
    if scale == 0:
        return np.empty(0), np.empty((len(v), 0))
    top, rng = scale * (1 + 1e-9), np.random.default_rng(7)
    wanted = min(wanted, count_above(v, floor))
    values, blocks, upper, found = [], [], top, 0
    while found < wanted:
        shift, above = _cut(v, min(found + PER_CONTOUR, wanted), floor, upper)
        got, vectors = _inside(v, shift, upper, above - found, rng)
        values.append(got)
        blocks.append(vectors)
        found, upper = above, shift
    # One Rayleigh-Ritz step over all intervals makes the vectors orthogonal across their borders.
    values, vectors = _ritz(v, np.hstack(blocks))
    if count_above(v, upper) != len(values):
        raise ArithmeticError("eigenvalues are missing")
    return values[:wanted], vectors[:, :wanted]


# ---- sums on Spark ------------------------------------------------------------------------------------------------

def whole_numbers(vector: Column) -> Column:
    """``floor(64 c) + 1000000`` of every entry; null where the vector or an entry is null or not finite."""
    good = F.forall(vector, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    return F.when(good, F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _summed(parts: DataFrame, d: int, kind: str) -> list[np.ndarray]:
    """Partial vectors ``(i, values)`` added up by Spark; the driver gets one row for every i."""
    cells = parts.select("i", F.posexplode("values").alias("j", "value")).groupBy("i", "j").agg(F.sum("value").alias("value"))
    rows = cells.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "value"))), lambda c: c["value"]).alias("values"))
    return [np.array(r["values"], kind) for r in rows.orderBy("i").collect()]


def _totals(fit: DataFrame, d: int) -> tuple[int, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d + 1, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), d)
            total += np.append(x.sum(axis=0), len(x))
        yield pa.RecordBatch.from_pydict({"i": [0], "values": [total]}, schema=pa.schema([("i", pa.int32()), ("values", pa.list_(pa.int64()))]))

    total = _summed(fit.mapInArrow(run, "i int, values array<long>"), d + 1, "int64")[0]
    return int(total[-1]), total[:-1]


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (n * x - sums) / n


def _covariance(fit: DataFrame, d: int, n: int, sums: np.ndarray, project: np.ndarray | None = None) -> np.ndarray:
    """Covariance over the fit list, centred before multiplying; of the projected vectors where ``project`` is given.

    Each task adds up its own products, so d rows of d numbers a task are shuffled.
    """
    k = d if project is None else project.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            y = _centred(_matrix(batch.column(0), d), n, sums)
            y = y if project is None else y @ project
            total += y.T @ y
        yield pa.RecordBatch.from_pydict({"i": range(k), "values": list(total)},
                                         schema=pa.schema([("i", pa.int32()), ("values", pa.list_(pa.float64()))]))

    return np.array(_summed(fit.mapInArrow(run, "i int, values array<double>"), k, "float64")) / n


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of every vector on the leading principal components, one row per vector and component.

    Rows whose vector is null, empty, or holds null or non-finite entries are dropped, as are vectors whose length is
    not the most frequent one (of equally frequent lengths, the largest). Entries become whole numbers, and each
    distinct vector counts once in the fit: n vectors with sums S. ``whitened`` is (x - S/n) on the component over the
    root of its eigenvalue; ``deviation`` is the exact sum of (n x - S)^2; ``explained`` the share of the variance;
    ``identity_error`` the largest departure of the whitened fit list's covariance from the identity, measured in a
    pass of its own. Components without variance do not exist and give no rows; neither does an empty table.

    Null and repeated ids are kept, a row each. Other columns are left out. Only sums and the matrix of the
    dimensions reach the driver. Entries and deviations beyond 64 bits raise an error.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), whole_numbers(F.col(vector_col)).alias("x")).where(
        "x is not null and size(x) > 0")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return vectors.sparkSession.createDataFrame([], schema)
    d = common["d"]
    rows = rows.where(F.size("x") == d)
    fit = materialize(rows.select("x").distinct(), "whitening-fit")
    n, sums = _totals(fit, d)
    v = _covariance(fit, d, n, sums)
    v = (v + v.T) / 2
    values, axes = leading_pairs(v, components)
    k = len(values)
    if not k:
        return vectors.sparkSession.createDataFrame([], schema)
    project = axes / np.sqrt(values)
    error = float(np.abs(_covariance(fit, d, n, sums, project) - np.eye(k)).max())
    explained = values / np.trace(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), d)
            apart = n * x - sums
            if len(apart) and d * float(np.abs(apart).max()) ** 2 >= 2.0 ** 63:
                raise OverflowError("a deviation does not fit into 64 bits")
            m = len(x)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n)), pa.array(np.repeat((apart * apart).sum(axis=1), k)),
                pa.array((_centred(x, n, sums) @ project).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
