"""Embedding whitening from a polarisation covariance.

Vectors are put on an integer grid, x = floor(scale * c) + offset.  Squares alone are aggregated,
exactly: for every dimension, and for the sum of every pair of dimensions, the sum of the squared
centred values.  As var(a + b) = var(a) + var(b) + 2 cov(a, b), differences of these variances are
all covariances.  Values are centred before squaring, at the integer nearest to the mean, so they stay
small however many rows there are; the fraction of the mean is put right in exact integers at the
end (sum of (n*u - r)^2 = n^2 * sum of u^2 - n * r^2 with r = sum of u).

The matrix goes to ``eigh`` on the driver.  It holds dim^2 numbers whatever the number of rows;
each task adds up its part of the squares first and sends one row a pair.  Sums travel as two
limbs, so none of them wraps or is rounded.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LIMB = 60
#: A row is left out if scale * c reaches this: doubles beyond it are no longer exact.
_MOST = float(1 << 53)
#: Components whose eigenvalue is not above this share of the largest one are flat.
FLAT = 1e-12


@dataclass(frozen=True)
class Whitening:
    """Fitted transform: ``n`` vectors, integer sums, covariance, eigenvalues (falling) and unit vectors (columns)."""

    n: int
    sums: tuple[int, ...]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    @property
    def flat(self) -> np.ndarray:
        """Components along which the vectors do not vary; they have no whitened value."""
        return ~(self.values > FLAT * max(self.values.max(initial=0.0), 0.0))

    def centred(self, u: np.ndarray) -> np.ndarray:
        """x - S/n of rows of ``_shifted`` values."""
        rest = [float(Fraction(s - self.n * m, self.n)) for s, m in zip(self.sums, self.means)]
        return u.astype(np.float64) - np.array(rest)

    @property
    def means(self) -> list[int]:
        """Integers nearest to the means."""
        return _nearest(self.sums, self.n)

    def whiten(self, u: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            out = self.centred(u) @ self.vectors / np.sqrt(np.maximum(self.values, 0.0))
        out[:, self.flat] = np.nan
        return out


def _nearest(sums: Iterable[int], n: int) -> list[int]:
    return [(2 * s + n) // (2 * n) for s in sums]


def grid(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0, offset: int = 1_000_000) -> DataFrame:
    """(id, x): integer vectors of the rows that take part.

    Left out are null vectors, vectors with null, NaN or infinite entries (or entries that leave the
    exact integers of doubles), and vectors of another length than most have (a tie goes to the
    longer ones); empty vectors as well.  Null and repeated ids stay as they are, other columns go.
    """
    scaled = lambda c: c.cast("double") * F.lit(scale)
    bad = F.exists(F.col("v"), lambda c: c.isNull() | F.isnan(c) | (F.abs(scaled(c)) >= F.lit(_MOST)))
    sound = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)
    lengths = sound.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    kept = sound.where(F.size("v") == F.lit(lengths["length"] if lengths else 0))
    return kept.select("id", F.transform("v", lambda c: F.floor(scaled(c)).cast("long") + F.lit(offset).cast("long")).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten()).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _exact_sum(a: np.ndarray) -> list[int]:
    """Column sums of longs in exact integers."""
    high, low = (a >> 32).sum(axis=0), (a & 0xFFFFFFFF).sum(axis=0)
    return [(int(h) << 32) + int(w) for h, w in zip(high, low)]


def _squares(a: np.ndarray, most: int) -> list[int]:
    """Column sums of squares of longs of at most ``most`` in size, in exact integers."""
    if most * most * max(len(a), 1) < 1 << 63:
        return [int(v) for v in np.einsum("rc,rc->c", a, a)]
    return [int(v) for v in (a.astype(object) ** 2).sum(axis=0)]


def _limbs(value: int) -> tuple[int, int]:
    return value >> _LIMB, value & ((1 << _LIMB) - 1)


def _summed(parts: DataFrame, *keys: str) -> dict[tuple, int]:
    """Exact totals of limb rows; as many as there are keys, which depends on the dimension only."""
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    return {tuple(r[k] for k in keys): (int(r["high"]) << _LIMB) + int(r["low"]) for r in parts.groupBy(*keys).agg(*wide).collect()}


def _sums(points: DataFrame) -> tuple[int, tuple[int, ...]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] = []
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                total = [a + b for a, b in zip(total or [0] * (x.shape[1] + 1), [len(x), *_exact_sum(x)])]
        yield from _limb_rows({(i,): v for i, v in enumerate(total)}, "i")

    found = _summed(points.select("x").mapInArrow(run, "i int, high long, low long"), "i")
    return found.get((0,), 0), tuple(found[(i,)] for i in range(1, len(found)))


def _limb_rows(values: dict[tuple, int], *keys: str) -> Iterator[pa.RecordBatch]:
    if values:
        high, low = zip(*map(_limbs, values.values()))
        columns = [*(pa.array(c, pa.int32()) for c in zip(*values)), pa.array(high, pa.int64()), pa.array(low, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*keys, "high", "low"])


def _square_sums(points: DataFrame, means: list[int]) -> dict[tuple, int]:
    """Sums of squares of u = x - mean for (i, i), and of u_i + u_j for i < j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, int] = {}
        for batch in batches:
            u = _matrix(batch.column(0)) - np.array(means)
            most = 2 * int(np.abs(u).max(initial=0))
            for i in range(u.shape[1]):
                row = [*_squares(u[:, i : i + 1], most), *_squares(u[:, i + 1 :] + u[:, i : i + 1], most)]
                for j, value in enumerate(row, i):
                    total[i, j] = total.get((i, j), 0) + value
        yield from _limb_rows(total, "i", "j")

    return _summed(points.select("x").mapInArrow(run, "i int, j int, high long, low long"), "i", "j")


def polarised_covariance(n: int, sums: tuple[int, ...], squares: dict[tuple, int]) -> np.ndarray:
    """Covariances (divisor n) from the squares of dimensions and of pair sums, each rounded once."""
    d = len(sums)
    rest = [s - n * m for s, m in zip(sums, _nearest(sums, n))]
    # Sum of (n*y - S_y)^2 for a dimension, or for a sum of two.
    centred = {(i, j): n * n * q - n * (rest[i] + (rest[j] if i != j else 0)) ** 2 for (i, j), q in squares.items()}
    out = np.zeros((d, d))
    for (i, j), value in centred.items():
        twice = 2 * value if i == j else value - centred[i, i] - centred[j, j]
        out[i, j] = out[j, i] = float(Fraction(twice, 2 * n**3))
    return out


def fit(points: DataFrame, components: int = 32) -> Whitening | None:
    """Whitening of all ``points`` (as ``grid`` returns them); None if there are none."""
    n, sums = _sums(points)
    if not n:
        return None
    covariance = polarised_covariance(n, sums, _square_sums(points, _nearest(sums, n)))
    values, vectors = np.linalg.eigh(covariance)
    trace = float(np.trace(covariance))
    values, vectors = values[::-1][:components].copy(), vectors[:, ::-1][:, :components].copy()
    return Whitening(n, sums, covariance, values, vectors, np.maximum(values, 0.0) / trace if trace > 0 else np.zeros(len(values)))


def identity_error(points: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, flat components left out."""
    live = np.flatnonzero(~model.flat)
    if not live.size:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((live.size + 1, live.size))
        for batch in batches:
            if batch.num_rows:
                w = model.whiten(_matrix(batch.column(0)) - np.array(model.means))[:, live]
                total += np.vstack([w.T @ w, w.sum(axis=0)])
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    rows = points.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((live.size + 1, live.size))
    for r in rows:
        total[r["i"], r["j"]] = r["v"] / model.n
    return float(np.abs(total[:-1] - np.outer(total[-1], total[-1]) - np.eye(live.size)).max())


def _deviations(u: np.ndarray, model: Whitening) -> pa.Array:
    """Sum over dimensions of (n*x - S)^2 in exact integers; null beyond 38 digits."""
    rest = [s - model.n * m for s, m in zip(model.sums, model.means)]
    most = model.n * int(np.abs(u).max(initial=0)) + max(map(abs, rest))
    if most * most * u.shape[1] < 1 << 63:
        z = model.n * u - np.array(rest)
        return pa.array(np.einsum("rc,rc->r", z, z), pa.int64()).cast(pa.decimal128(38, 0))
    z = model.n * u.astype(object) - np.array(rest, dtype=object)
    return pa.array([Decimal(v) if v < 10**38 else None for v in map(int, (z * z).sum(axis=1))], pa.decimal128(38, 0))


def transform(points: DataFrame, model: Whitening | None, error: float | None = None) -> DataFrame:
    """One row per point and component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    ``whitened`` is null on flat components.  Without a model (no points) the result is empty.
    """
    kind = points.schema["id"].dataType
    columns = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    names = ["id", *(c.split()[0] for c in columns.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model is None:
            return
        k = len(model.values)
        for batch in batches:
            for part in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
                u = _matrix(part.column(1)) - np.array(model.means)
                each, rows = pa.array(np.repeat(np.arange(len(u)), k)), len(u) * k
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(each),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(u))),
                        pa.array(np.full(rows, model.n, np.int64)),
                        _deviations(u, model).take(each),
                        pa.array(model.whiten(u).ravel(), from_pandas=True),
                        pa.array(np.tile(model.explained, len(u))),
                        pa.array(np.full(rows, error if error is not None else 0.0)),
                    ],
                    names=names,
                )

    return points.select("id", "x").mapInArrow(run, f"id {kind.simpleString()}, {columns}")


def whitened(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 32, scale: float = 64.0, offset: int = 1_000_000) -> DataFrame:
    """Fit on all vectors and apply to all of them; see ``grid`` for the rows that take part and ``transform`` for the result.

    Equal vectors get equal rows.  One vector, or only equal ones, have flat components alone:
    whitened null, explained 0, identity_error 0.  An empty table gives an empty one.
    """
    points = grid(vectors, id_col, vec_col, scale, offset)
    model = fit(points, components)
    return transform(points, model, identity_error(points, model) if model else None)
