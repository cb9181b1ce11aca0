"""Embedding whitening by an incremental eigendecomposition.

1. Counts and exact sums per dimension are one aggregate; they fix the mean.
2. Each partition keeps a spectrum (number of vectors, mean, eigenvalues and eigenvectors of the scatter
   about that mean) and takes its vectors in by centred rank-one updates: the new eigenvalues are the roots
   of a secular equation, each between two old ones; entries of the update that are nothing, and equal
   eigenvalues, are deflated first; the new eigenvectors come from an update vector that is computed back
   from the roots, which keeps them orthogonal.
3. Spectra are combined in groups, level by level, by further rank-one updates: one for each eigenvector of
   the smaller one, and one for the difference of the means. A spectrum has d x d numbers, whatever the input.
4. A distributed Rayleigh-Ritz refinement ends it: in one pass over all vectors the covariance is summed in
   the coordinates of the eigenvectors found, where it is nearly diagonal; its own small eigenproblem turns
   the basis the rest of the way. Centring subtracts the whole part of the mean as an integer, so nothing is
   lost to a large offset. The pass is repeated until the turn is within rounding (two passes as a rule).

Only d x d matrices reach the driver. A pass that has to be repeated after a lost executor gives the same
sums up to rounding.

Defined results: rows whose vector is null, or has a null, NaN or infinite entry, are left out; so are
vectors of another length than the most frequent one (of equally frequent ones the longer). An entry is
limited to 2^40 in size before it becomes an integer. Directions without variance (to rounding) have no
whitened value and are left out, so one vector alone, or none, gives an empty table. A deviation beyond a
long counts as the largest long. Repeated ids are rows of their own. Other columns are not carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticktide.llm.clustering import finite
from ticktide.llm.common import col, cut

SCALE, OFFSET, LIMIT = 64, 1_000_000, float(1 << 40)
#: Spectra that one task combines.
FAN = 16
ROWS = 2048
TOP = (1 << 63) - 1
EPS = np.finfo(float).eps
#: Share of the largest eigenvalue up to which a direction counts as without variance.
FLOOR = 1e-10


# --- rank-one updates -----------------------------------------------------------------------------


def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(z2 / (d - x)) = 0 for rising, different d and positive z2.

    Gives the place of the pole next to each root and the root's distance from it, so that differences of
    roots and poles keep their digits. A step fits one pole on either side to the two partial sums
    and their slopes; a step out of the bracket is a bisection instead.
    """
    m = len(d)
    ends = np.append(d[1:], d[-1] + z2.sum())
    gap = ends - d
    left = np.tri(m, dtype=bool)  # poles at or below the root
    apart = d[None, :] - d[:, None]
    middle = 1 + (z2 / (apart - gap[:, None] / 2)).sum(axis=1)
    near_left = middle >= 0
    near_left[-1] = True
    base = np.where(near_left, np.arange(m), np.minimum(np.arange(m) + 1, m - 1))
    delta = d[None, :] - d[base][:, None]
    d1, d2 = np.where(near_left, 0.0, -gap), np.where(near_left, gap, 0.0)
    low = np.where(near_left, 0.0, -gap / 2)
    high = np.where(near_left, np.where(middle >= 0, gap / 2, gap), 0.0)
    low[-1], high[-1] = (0.0, gap[-1] / 2) if middle[-1] >= 0 else (gap[-1] / 2, gap[-1])
    mu = (low + high) / 2
    live = np.arange(m)
    for _ in range(60):
        rest = delta[live] - mu[live][:, None]
        term = z2 / rest
        slope = term / rest
        f = 1 + term.sum(axis=1)
        size = 1 + np.abs(term).sum(axis=1)
        up = f < 0
        low[live] = np.where(up, mu[live], low[live])
        high[live] = np.where(up, high[live], mu[live])
        keep = (np.abs(f) > 8 * EPS * size) & (high[live] - low[live] > 2 * EPS * np.maximum(np.abs(low[live]), np.abs(high[live])))
        if not keep.any():
            break
        live, f, slope = live[keep], f[keep], slope[keep]
        below = np.where(left[live], slope, 0.0).sum(axis=1)
        above = slope.sum(axis=1) - below
        e1, e2 = d1[live] - mu[live], d2[live] - mu[live]
        a = (e1 + e2) * f - e1 * e2 * (below + above)
        b = e1 * e2 * f
        c = f - e1 * below - e2 * above
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            move = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        at = mu[live] + move
        inside = np.isfinite(at) & (at > low[live]) & (at < high[live])
        mu[live] = np.where(inside, at, (low[live] + high[live]) / 2)
    return base, mu


def rank_one(values: np.ndarray, vectors: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of vectors * diag(values) * vectors' + u * u'."""
    z = vectors.T @ u
    norm2 = float(z @ z)
    if norm2 == 0.0:
        return values, vectors
    tiny = 8 * EPS * max(float(np.abs(values).max()), norm2)
    kept = np.flatnonzero(np.abs(z) * np.sqrt(norm2) > tiny)
    near = np.flatnonzero(np.diff(values[kept]) <= tiny)
    if len(near):  # equal eigenvalues: turn the pair until one entry is nothing
        vectors, gone = vectors.copy(), np.zeros(len(kept), dtype=bool)
        for at in near:
            i, j = kept[at], kept[at + 1]
            r = np.hypot(z[i], z[j])
            cos, sin = z[j] / r, z[i] / r
            vi = vectors[:, i] * cos - vectors[:, j] * sin
            vectors[:, j] = vectors[:, i] * sin + vectors[:, j] * cos
            vectors[:, i], z[i], z[j], gone[at] = vi, 0.0, r, True
        kept = kept[~gone]
    if not len(kept):
        return values, vectors
    d = values[kept]
    m = len(kept)
    base, mu = secular_roots(d, z[kept] ** 2)
    roots = d[base] + mu
    # roots less poles, from the distances to the near pole
    apart = mu[:, None] + (d[base][:, None] - d[None, :])
    poles = d[:, None] - d[None, :]
    np.fill_diagonal(poles, 1.0)
    back = np.sqrt(np.abs(np.prod(apart / poles, axis=0))) * np.sign(z[kept])
    turn = back[:, None] / -apart.T
    turn /= np.sqrt(np.square(turn).sum(axis=0))
    out_values, out_vectors = values.copy(), vectors.copy()
    out_values[kept] = roots
    out_vectors[:, kept] = vectors[:, kept] @ turn
    if m < len(values) or (np.diff(out_values) < 0).any():
        order = np.argsort(out_values, kind="stable")
        out_values, out_vectors = out_values[order], out_vectors[:, order]
    return out_values, out_vectors


class Spectrum(NamedTuple):
    """A number of vectors, their mean, and the eigenvalues and eigenvectors of their scatter about it."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, dims: int) -> Spectrum:
        return cls(0, np.zeros(dims), np.zeros(dims), np.eye(dims))

    def add(self, x: np.ndarray) -> Spectrum:
        away, n = x - self.mean, self.n + 1
        values, vectors = rank_one(self.values, self.vectors, away * np.sqrt(self.n / n)) if self.n else (self.values, self.vectors)
        return Spectrum(n, self.mean + away / n, values, vectors)

    def merge(self, other: Spectrum) -> Spectrum:
        if self.n < other.n:
            return other.merge(self)
        if not other.n:
            return self
        values, vectors, n = self.values, self.vectors, self.n + other.n
        for size, direction in zip(other.values, other.vectors.T, strict=True):
            if size > 0:
                values, vectors = rank_one(values, vectors, np.sqrt(size) * direction)
        away = other.mean - self.mean
        values, vectors = rank_one(values, vectors, away * np.sqrt(self.n * (other.n / n)))
        return Spectrum(n, self.mean + away * (other.n / n), values, vectors)


# --- distributed passes ---------------------------------------------------------------------------


def integers(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """Rows (id, x) with x = floor(64 c) + 1,000,000 for the vectors that count, written once, and their length."""
    vector = col(vector_col).cast("array<double>")
    whole = F.transform(vector, lambda c: F.floor(F.greatest(F.least(c, F.lit(LIMIT)), F.lit(-LIMIT)) * SCALE).cast("long") + F.lit(OFFSET))
    kept = cut(df.filter(finite(vector)).select(col(id_col).alias("id"), whole.alias("x")))
    lengths = kept.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    dims = lengths[0]["dims"] if lengths else 0
    return kept.filter(F.size("x") == dims), dims


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, column: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def sums(vectors: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums per dimension; halves of 24 bits keep the partial sums in a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, np.zeros(dims, dtype=np.int64), np.zeros(dims, dtype=np.int64)
        for _, x in _blocks(batches, dims):
            n += len(x)
            low += (x & 0xFFFFFF).sum(axis=0)
            high += (x >> 24).sum(axis=0)
        columns = [np.arange(dims), np.full(dims, n), low, high]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["dim", "n", "low", "high"])

    added = vectors.select("x").mapInArrow(run, "dim long, n long, low long, high long").groupBy("dim")
    rows = sorted(added.agg(F.sum("n").alias("n"), F.sum("low").alias("low"), F.sum("high").alias("high")).collect())
    return rows[0]["n"], [r["low"] + (r["high"] << 24) for r in rows]


class Centre:
    """Vectors less the mean: its whole part is taken off as an integer, the rest as a double."""

    def __init__(self, n: int, totals: list[int]) -> None:
        self.whole = np.array([t // n for t in totals], dtype=np.int64)
        self.rest = np.array([(t % n) / n for t in totals])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest


SPECTRUM = "part long, n long, mean array<double>, eigenvalues array<double>, eigenvectors array<double>"


def _row(part: int, s: Spectrum) -> pa.RecordBatch:
    wide = [pa.array([np.ascontiguousarray(c).ravel()], pa.list_(pa.float64())) for c in (s.mean, s.values, s.vectors)]
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([s.n], pa.int64()), *wide], ["part", "n", "mean", "eigenvalues", "eigenvectors"])


def spectrum(vectors: DataFrame, dims: int, centre: Centre) -> Spectrum:
    """The combined spectrum of all rows, by rank-one updates only."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, part = Spectrum.empty(dims), 0
        for batch, x in _blocks(batches, dims):
            part = batch.column(1)[0].as_py()
            for row in centre(x):
                s = s.add(row)
        if s.n:
            yield _row(part, s)

    def merged(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Spectrum.empty(dims)
        for batch in batches:
            for n, mean, values, flat in zip(*(batch.column(c).to_pylist() for c in ("n", "mean", "eigenvalues", "eigenvectors")), strict=True):
                s = s.merge(Spectrum(n, np.array(mean), np.array(values), np.array(flat).reshape(dims, dims)))
        yield _row(key[0].as_py(), s)

    parts = cut(vectors.select("x", F.spark_partition_id().cast("long").alias("part")).mapInArrow(own, SPECTRUM))
    while parts.count() > 1:
        parts = cut(parts.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part").applyInArrow(merged, SPECTRUM))
    r = parts.first()
    return Spectrum(r["n"], np.array(r["mean"]), np.array(r["eigenvalues"]), np.array(r["eigenvectors"]).reshape(dims, dims))


def gram(vectors: DataFrame, dims: int, centre: Centre, basis: np.ndarray) -> np.ndarray:
    """Sum of y y' over all rows, for y = basis' (x - mean): k x k numbers."""
    k = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for _, x in _blocks(batches, dims):
            y = centre(x) @ basis
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    out = np.zeros((k, k))
    summed = vectors.select("x").mapInArrow(run, "i long, row array<double>").select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j")
    for r in summed.agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"]
    return (out + out.T) / 2


def refined(vectors: DataFrame, dims: int, n: int, centre: Centre, basis: np.ndarray, passes: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Rayleigh-Ritz: eigenvalues (falling) and unit eigenvectors of the covariance from a nearby basis."""
    basis, _ = np.linalg.qr(basis)
    for _ in range(passes):
        small = gram(vectors, dims, centre, basis) / n
        values, turn = np.linalg.eigh(small)
        basis = basis @ turn
        basis, upper = np.linalg.qr(basis)
        basis = basis * np.where(np.diag(upper) < 0, -1.0, 1.0)
        off = np.abs(small - np.diag(np.diag(small))).max()
        if off <= 64 * EPS * np.abs(values).max():
            break
    return values[::-1].copy(), basis[:, ::-1].copy()


class Whitening(NamedTuple):
    """A fitted whitening: of `components` columns, each a unit eigenvector over the root of its eigenvalue."""

    n: int
    totals: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    @property
    def weights(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def fit(vectors: DataFrame, dims: int, components: int) -> Whitening | None:
    """Fits all rows (id, x) of `vectors`; None where there are none. `vectors` is read several times."""
    if not dims or vectors.isEmpty():
        return None
    n, totals = sums(vectors, dims)
    centre = Centre(n, totals)
    found = spectrum(vectors, dims, centre)
    values, basis = refined(vectors, dims, n, centre, found.vectors)
    good = int((values > FLOOR * values[0]).sum()) if values[0] > 0 else 0
    k = min(components, good)
    weights = basis[:, :k] / np.sqrt(values[:k])
    error = float(np.abs(gram(vectors, dims, centre, weights) / n - np.eye(k)).max()) if k else 0.0
    return Whitening(n, totals, values[:k], basis[:, :k], float(values.sum()), error)


def _deviations(x: np.ndarray, n: int, totals: list[int]) -> list[int] | np.ndarray:
    """Exact sums of (n x - S)^2, in longs where they fit for sure."""
    whole = [t // n for t in totals]
    near = x - np.array(whole, dtype=np.int64)
    most = int(np.abs(near).max(initial=0)) + 1
    if x.shape[1] * (most * n) ** 2 <= TOP:
        away = near * n - np.array([t % n for t in totals], dtype=np.int64)
        return np.einsum("ij,ij->i", away, away)
    return [min(sum((int(c) * n - t % n) ** 2 for c, t in zip(row, totals, strict=True)), TOP) for row in near]


def whiten(vectors: DataFrame, dims: int, fitted: Whitening | None) -> DataFrame:
    """Rows (id, component, n, deviation, whitened, explained, identity_error) for rows (id, x)."""
    kind = vectors.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if fitted is None or not len(fitted.values):
        return vectors.sparkSession.createDataFrame([], schema)
    n, totals, k = fitted.n, fitted.totals, len(fitted.values)
    centre, weights, explained, error = Centre(n, totals), fitted.weights, fitted.values / fitted.trace, fitted.identity_error
    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, dims, 1):
            rows = len(x)
            columns = [
                part.column(0).take(pa.array(np.repeat(np.arange(rows), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, n, dtype=np.int64)),
                pa.array(np.repeat(np.array(_deviations(x, n, totals), dtype=np.int64), k)),
                pa.array((centre(x) @ weights).ravel()),
                pa.array(np.tile(explained, rows)),
                pa.array(np.full(rows * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return vectors.select("id", "x").mapInArrow(run, schema)


def whitened(df: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Fits the whitening of all vectors of `df` and applies it to each."""
    vectors, dims = integers(df, id_col, vector_col)
    return whiten(vectors, dims, fit(vectors, dims, components)).withColumnRenamed("id", id_col)
