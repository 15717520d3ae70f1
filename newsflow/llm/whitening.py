"""Whitening of embeddings with a covariance from variances alone (polarisation).

Entries are whole numbers x = floor(SCALE * c) + SHIFT. For every dimension i, and for the sum of every pair of dimensions i < j,
the squares of the centred values are added up exactly:

    Q_i = sum (n x_i - S_i)^2        Q_ij = sum (n (x_i + x_j) - S_i - S_j)^2
    cov(i, j) = (var(x_i + x_j) - var(x_i) - var(x_j)) / 2 = (Q_ij - Q_i - Q_j) / (2 n^3)

Tasks centre on the whole part m of the mean, so squares stay small: with n (x - m) = n x - S + r, 0 <= r < n, the sum of the
squares about the true mean is n^2 sum (x - m)^2 - n r^2, in whole numbers. Nothing is rounded before the division by 2 n^3.
The driver gets numbers per pair of dimensions, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.llm.common import batch

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
# Vectors with an entry of a larger size are dropped like those with non-finite entries: squares of x must fit 38 digits.
MAX_ENTRY = float(1 << 40)
# Centred values up to this size have squares of pair sums that add up in 64 bits over a batch.
SMALL = 1 << 20
# Rows squared in one array step.
STEP_ROWS = 1_024
DECIMAL = pa.decimal128(38, 0)


@dataclass(frozen=True)
class Space:
    """Whitening of vectors of one length: sums per dimension, and the kept components with their eigenvalues, falling."""

    n: int
    sums: list[int]
    vectors: np.ndarray  # a column per component
    values: np.ndarray   # 0 where a component has no variance
    trace: float


def entries(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): whole entries of the vectors that take part, see `whiten`."""
    c = F.transform(F.col(f"`{vector_col}`"), lambda e: e.cast("double"))
    fine = F.forall("c", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) <= MAX_ENTRY))
    x = F.transform("c", lambda e: F.floor(e * SCALE).cast("bigint") + SHIFT)
    return df.select(F.col(f"`{id_col}`").alias("vec_id"), c.alias("c")).where(
        F.col("c").isNotNull() & (F.size("c") > 0) & fine).select("vec_id", x.alias("x"))


def _matrices(b: pa.RecordBatch, column: str = "x") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the vectors of each length in a batch."""
    lists = b.column(column)
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    starts = np.cumsum(lengths) - lengths
    for d in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == d)
        yield rows, flat[starts[rows][:, None] + np.arange(d)]


def _whole(values) -> pa.Array:
    """Whole numbers as decimals, null beyond 38 digits."""
    return pa.array([Decimal(int(v)) if abs(v) < 10 ** 38 else None for v in values], DECIMAL)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, i, n, s): rows and sum of dimension i of the vectors of length d."""
    held: dict[int, list] = {}
    for b in batches:
        for rows, x in _matrices(b):
            n, s = held.get(x.shape[1], (0, 0))
            held[x.shape[1]] = n + len(rows), s + (x - SHIFT).astype(object if np.abs(x).max() >> 40 else np.int64).sum(axis=0).astype(object) + SHIFT * len(rows)
    for d, (n, s) in held.items():
        yield batch(d=pa.array([d] * d, pa.int32()), i=pa.array(range(d), pa.int32()), n=pa.array([n] * d, pa.int64()), s=_whole(s))


def square_sums(c: np.ndarray) -> np.ndarray:
    """Exact sums of c_i^2 (j = i) and of (c_i + c_j)^2 (j > i) over the rows, pair after pair."""
    d = c.shape[1]
    wide = len(c) and np.abs(c).max() >= SMALL
    out = np.zeros(d * (d + 1) // 2, dtype=object)
    for low in range(0, len(c), STEP_ROWS):
        step = np.ascontiguousarray(c[low:low + STEP_ROWS].astype(object if wide else np.int64).T)
        at = 0
        for i in range(d):
            pair = step[i:] + step[i]
            pair[0] = step[i]
            out[at:at + d - i] += (pair * pair).sum(axis=1).astype(object)
            at += d - i
    return out


def _squares(batches: Iterator[pa.RecordBatch], centres: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(d, p, q): sums of squares of centred values by pair number."""
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for _, x in _matrices(b):
            d = x.shape[1]
            held[d] = held.get(d, 0) + square_sums(x - centres[d])
    for d, q in held.items():
        yield batch(d=pa.array([d] * len(q), pa.int32()), p=pa.array(range(len(q)), pa.int64()), q=_whole(q))


def covariances(n: int, sums: list[int], centres: list[int], squares: list[int]) -> tuple[np.ndarray, list[int]]:
    """(covariance matrix, Q_i): `squares` are the sums about `centres`, pair after pair."""
    d = len(sums)
    rest = [s - n * m for s, m in zip(sums, centres)]
    i, j = np.triu_indices(d)
    own = [0] * d
    exact = []
    for a, b, q in zip(i.tolist(), j.tolist(), squares):
        r = rest[a] if a == b else rest[a] + rest[b]
        exact.append(n * n * q - n * r * r)
        if a == b:
            own[a] = exact[-1]
    out = np.zeros((d, d))
    for a, b, q in zip(i.tolist(), j.tolist(), exact):
        # A division of whole numbers in Python rounds once.
        out[a, b] = out[b, a] = q / n ** 3 if a == b else (q - own[a] - own[b]) / (2 * n ** 3)
    return out, own


def fit(whole: DataFrame, components: int = COMPONENTS) -> dict[int, Space]:
    """Whitening by vector length, from rows (vec_id, x). Two aggregates; the driver holds numbers per pair of dimensions."""
    only = whole.select("x")
    found = only.mapInArrow(_sums, "d int, i int, n long, s decimal(38,0)").groupBy("d", "i").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    counts: dict[int, int] = {r["d"]: r["n"] for r in found}
    sums = {d: [0] * d for d in counts}
    for r in found:
        sums[r["d"]][r["i"]] = int(r["s"])
    centres = {d: [s // counts[d] for s in sums[d]] for d in counts}
    arrays = {d: np.array(m, dtype=np.int64) for d, m in centres.items()}
    squares = {d: [0] * (d * (d + 1) // 2) for d in counts}
    for r in only.mapInArrow(lambda b: _squares(b, arrays), "d int, p long, q decimal(38,0)").groupBy("d", "p").agg(
            F.sum("q").alias("q")).collect():
        squares[r["d"]][r["p"]] = int(r["q"])
    out = {}
    for d, n in counts.items():
        cov, _ = covariances(n, sums[d], centres[d], squares[d])
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(-values, kind="stable")[:components]
        values, vectors = values[order], vectors[:, order]
        # Rounding alone gives values of this size.
        values = np.where(values > max(values[0], 0.0) * d * np.finfo(float).eps, values, 0.0)
        out[d] = Space(n, sums[d], vectors, values, float(np.trace(cov)))
    return out


def deviations(x: np.ndarray, space: Space) -> list[int]:
    """Sum over the dimensions of (n x - S)^2 of each row, exact."""
    centre = np.array([s // space.n for s in space.sums], dtype=np.int64)
    rest = np.array([s % space.n for s in space.sums], dtype=object)
    c = x - centre
    largest = (int(np.abs(c).max(initial=0)) + 1) * space.n
    kind = np.int64 if largest * largest * x.shape[1] < 1 << 63 else object
    u = c.astype(kind) * space.n - rest.astype(kind)
    return (u * u).sum(axis=1).tolist()


def projected(x: np.ndarray, space: Space) -> np.ndarray:
    """Whitened components of each row; NaN for components without variance."""
    centre = np.array([s // space.n for s in space.sums], dtype=np.int64)
    rest = np.array([s % space.n / space.n for s in space.sums])
    scale = np.full(len(space.values), np.nan)
    np.divide(1.0, np.sqrt(space.values), out=scale, where=space.values > 0)
    return ((x - centre).astype(np.float64) - rest) @ space.vectors * scale


def _moments(batches: Iterator[pa.RecordBatch], spaces: dict[int, Space]) -> Iterator[pa.RecordBatch]:
    """(d, p, s): sums of the whitened components, then of their products pair after pair, as far as they have variance."""
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for _, x in _matrices(b):
            d = x.shape[1]
            w = projected(x, spaces[d])[:, spaces[d].values > 0]
            i, j = np.triu_indices(w.shape[1])
            held[d] = held.get(d, 0) + np.r_[w.sum(axis=0), (w.T @ w)[i, j]]
    for d, s in held.items():
        yield batch(d=pa.array([d] * len(s), pa.int32()), p=pa.array(range(len(s)), pa.int32()), s=pa.array(s, pa.float64()))


def identity_errors(whole: DataFrame, spaces: dict[int, Space]) -> dict[int, float | None]:
    """By vector length the largest absolute entry of the whitened rows' covariance minus the identity, as measured on all rows."""
    found: dict[int, dict[int, float]] = {d: {} for d in spaces}
    for r in whole.select("x").mapInArrow(lambda b: _moments(b, spaces), "d int, p int, s double").groupBy("d", "p").agg(F.sum("s").alias("s")).collect():
        found[r["d"]][r["p"]] = r["s"]
    out: dict[int, float | None] = {}
    for d, space in spaces.items():
        k = int((space.values > 0).sum())
        s = np.array([found[d].get(p, 0.0) for p in range(k + k * (k + 1) // 2)])
        mean = s[:k] / space.n
        i, j = np.triu_indices(k)
        out[d] = float(np.abs(s[k:] / space.n - mean[i] * mean[j] - (i == j)).max()) if k else None
    return out


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per vector and component.

    Vectors that are null or empty, or hold a null, a non-finite entry or one beyond MAX_ENTRY, are dropped. The others are
    all the fit list; repeated rows and ids count as often as they occur, and null ids stay. Vectors of different lengths
    are spaces of their own, each with its n. Components are numbered from 1 by falling eigenvalue, at most the vector's
    length; those without variance have whitened and identity_error null, and explained is null where nothing varies
    at all. deviation is decimal(38,0), null beyond. Other columns are ignored; an empty table gives an empty result.
    """
    whole = entries(df, id_col, vector_col)
    spaces = fit(whole, components)
    errors = identity_errors(whole, spaces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("vec_id")
            for rows, x in _matrices(b):
                space = spaces[x.shape[1]]
                k, m = len(space.values), len(rows)
                explained = space.values / space.trace if space.trace > 0 else np.full(k, np.nan)
                error = errors[x.shape[1]]
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(np.repeat(rows, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, space.n)), _whole(deviations(x, space)).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(projected(x, space).ravel(), from_pandas=True), pa.array(np.tile(explained, m), from_pandas=True),
                    pa.array([error] * (m * k), pa.float64())],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = df.schema[id_col].dataType.simpleString()
    return whole.mapInArrow(
        run, f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
