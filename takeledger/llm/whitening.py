"""Embedding whitening: leading eigenpairs by spectrum slicing, then every row projected and scaled.

Spark counts, sums and multiplies the centred vectors; what reaches the driver is one covariance
matrix. There the eigenvalues are isolated by inertia: a symmetric factorisation L D Lᵀ of V - sI
has as many positive pivots as V has eigenvalues above s. Rayleigh quotient iteration takes an
isolated eigenvalue to double precision, and counts on both sides of it certify its number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takeledger.llm.common import settled
from takeledger.llm.vectors import integer_vectors, slices

#: Components that are returned.
COMPONENTS = 4
_EPS = np.finfo(np.float64).eps


# ---- the spectrum of one matrix ---------------------------------------------------------------

def count_above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of v exceed the shift: the positive pivots of L D Lᵀ = v - shift * I.

    Pivots are chosen over the whole rest of the matrix; where its largest entry is off the
    diagonal by far, a block of two rows is the pivot, which has one eigenvalue of either sign.
    """
    a = v - shift * np.eye(len(v))
    above = 0
    while len(a):
        diagonal = np.abs(np.diag(a))
        i = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diag(a)))
        p, q = np.unravel_index(int(off.argmax()), off.shape)
        largest = off[p, q]
        if max(diagonal[i], largest) == 0:
            return above
        if diagonal[i] >= 0.6404 * largest:  # (1 + sqrt 17) / 8 bounds the growth of the entries
            pivot, rest = a[i, i], np.delete(np.arange(len(a)), i)
            above += int(pivot > 0)
            column = a[rest, i]
            a = a[np.ix_(rest, rest)] - np.outer(column, column) / pivot
        else:
            pair, rest = [p, q], np.delete(np.arange(len(a)), [p, q])
            above += 1
            columns = a[np.ix_(rest, pair)]
            a = a[np.ix_(rest, rest)] - columns @ np.linalg.solve(a[np.ix_(pair, pair)], columns.T)
        a = (a + a.T) / 2
    return above


def _isolated(v: np.ndarray, wanted: int) -> list[tuple[float, float, int, int]]:
    """Intervals (low, high, above, inside), from the top: each holds one eigenvalue, or several
    that rounding can't tell apart; together they hold the `wanted` largest."""
    reach = float(np.abs(v).sum(axis=1).max()) * (1 + 1e-12) + _EPS
    finest = 4 * _EPS * reach
    out, stack = [], [(-reach, reach, 0, len(v))]
    while stack:
        low, high, above, inside = stack.pop()
        if inside == 0 or above >= wanted:
            continue
        if inside == 1 or high - low <= finest:
            out.append((low, high, above, inside))
            continue
        middle = (low + high) / 2
        upper = min(max(count_above(v, middle) - above, 0), inside)
        stack += [(low, middle, above + upper, inside - upper), (middle, high, above, upper)]
    return out


def _solved(v: np.ndarray, shift: float, x: np.ndarray) -> np.ndarray:
    """(v - shift * I)⁻¹ x, the shift moved by a hair where the matrix is singular."""
    scale = float(np.abs(v).max()) + _EPS
    for step in range(60):
        try:
            y = np.linalg.solve(v - shift * np.eye(len(v)), x)
            if np.isfinite(y).all():
                return y
        except np.linalg.LinAlgError:
            pass
        shift += (step + 1) * _EPS * scale
    return x


def _one(v: np.ndarray, low: float, high: float, above: int) -> tuple[float, np.ndarray]:
    """The eigenpair of the single eigenvalue inside (low, high], the one after `above` others."""
    rng = np.random.default_rng(11)
    norm = float(np.abs(v).sum(axis=1).max()) + _EPS
    start = rng.standard_normal(len(v))
    while True:
        x = start / np.linalg.norm(start)
        for _ in range(2):  # towards the interval's eigenvector before the quotient takes over
            x = _solved(v, (low + high) / 2, x)
            x /= np.linalg.norm(x)
        best = (np.inf, 0.0, x)
        for _ in range(20):
            value = float(x @ v @ x)
            left = float(np.linalg.norm(v @ x - value * x))
            if left >= best[0] * 0.5 and best[0] < 1e-8 * norm:
                break
            best = min(best, (left, value, x), key=lambda b: b[0])
            if left <= _EPS * norm:
                break
            x = _solved(v, value, x)
            x /= np.linalg.norm(x)
        left, value, x = best
        margin = max(2 * left, 8 * _EPS * norm)
        if low - margin <= value <= high + margin and left < 1e-8 * norm and count_above(v, value - margin) >= above + 1 and count_above(v, value + margin) <= above:
            return value, x
        if high - low <= 4 * _EPS * norm:
            return value, x
        middle = (low + high) / 2  # the quotient went to another pair: halve and begin again
        low, high = (middle, high) if count_above(v, middle) > above else (low, middle)


def _cluster(v: np.ndarray, shift: float, inside: int) -> list[tuple[float, np.ndarray]]:
    """Orthonormal pairs of eigenvalues that rounding can't tell apart, by block inverse iteration."""
    x = np.random.default_rng(12).standard_normal((len(v), inside))
    for _ in range(4):
        x = np.linalg.qr(_solved(v, shift, np.linalg.qr(x)[0]))[0]
    return [(float(x[:, i] @ v @ x[:, i]), x[:, i]) for i in range(inside)]


def leading_pairs(v: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors.

    Vectors are columns, orthogonal to each other; the largest entry of each is positive.
    """
    scale = float(np.abs(v).max(initial=0)) or 1.0
    v, values, vectors = v / scale, [], []
    for low, high, above, inside in _isolated(v, min(wanted, len(v))):
        pairs = [_one(v, low, high, above)] if inside == 1 else _cluster(v, (low + high) / 2, inside)
        for value, x in pairs:
            for _ in range(2):
                for y in vectors:
                    x = x - (y @ x) * y
                x = x / np.linalg.norm(x)
            values.append(value)
            vectors.append(x * (1 if x[np.abs(x).argmax()] > 0 else -1))
    order = np.argsort(-np.array(values), kind="stable")[:wanted]
    return np.array(values)[order] * scale, np.array(vectors).reshape(len(values), len(v))[order].T


# ---- sums over all rows -----------------------------------------------------------------------

@dataclass
class Whitening:
    """What the fit list says: its size n, sums S, the leading pairs, and how white it becomes."""

    width: int
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def sound(self) -> np.ndarray:
        """Components that have variance beyond rounding: only these can be scaled."""
        return self.values > self.width * _EPS * max(self.trace, 0.0)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        scale = np.where(self.sound, np.sqrt(np.where(self.sound, self.values, 1.0)), np.nan)
        return (x - self.mean) @ self.vectors / scale


def _sums(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * width
        for _, x in slices(batches, width):
            # halves of the entries, so that no sum of a slice leaves 64 bits
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            total = [t + (int(h) << 32) + int(lo) for t, h, lo in zip(total, high, low)]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(map(str, total), pa.string())], names=["i", "s"])

    return run


def _products(width: int, of):
    """The sums of products of the rows of `of(x)` and its plain sums, as (i, j, v); j = -1: sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, plain = None, None
        for _, x in slices(batches, width):
            y = of(x)
            total, plain = (y.T @ y, y.sum(axis=0)) if total is None else (total + y.T @ y, plain + y.sum(axis=0))
        if total is None:
            return
        i, j = np.triu_indices(len(total))
        k = np.arange(len(plain))
        columns = [np.concatenate((i, k)), np.concatenate((j, np.full(len(k), -1))), np.concatenate((total[i, j], plain))]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.float64())], names=["i", "j", "v"])

    return run


def _gathered(rows: DataFrame, width: int, size: int, of) -> tuple[np.ndarray, np.ndarray]:
    """size x size sums of products and the sums: tasks add their rows, Spark adds the tasks."""
    out, plain = np.zeros((size, size)), np.zeros(size)
    for i, j, v in rows.mapInArrow(_products(width, of), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        if j < 0:
            plain[i] = v
        else:
            out[i, j] = out[j, i] = v
    return out, plain


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors (x, width) of integer_vectors; None where there is none.

    Only vectors of one width have a covariance: the width that most distinct vectors have (of
    several the largest). Passes over the distinct vectors: sums, centred products, whiteness.
    """
    listed = settled(vectors.select("x", "width").distinct(), "fit-list")
    widths = listed.groupBy("width").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if widths is None:
        return None
    width, n = widths
    rows = listed.filter(F.col("width") == width).select("x")
    found = dict(rows.mapInArrow(_sums(width), "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())
    sums = [int(found[i]) for i in range(width)]
    mean = np.array([s / n for s in sums])
    products, _ = _gathered(rows, width, width, lambda x: x - mean)
    covariance = products / n
    values, directions = leading_pairs(covariance, components)
    model = Whitening(width, n, sums, values, directions, float(np.trace(covariance)))
    keep = np.flatnonzero(model.sound)
    if len(keep):
        white, plain = _gathered(rows, width, len(keep), lambda x: model.whiten(x)[:, keep])
        model.identity_error = float(np.abs(white / n - np.outer(plain / n, plain / n) - np.eye(len(keep))).max())
    return model


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """sum((n * x - S)^2) of each row, exact; None where it is beyond a long.

    64-bit products wrap, which is exact for every total below 2^63: a sum in floating point says
    which rows are below, and the few beside the bound are taken in Python's integers.
    """
    near = ((x.astype(np.float64) * n - np.array(sums, dtype=np.float64)) ** 2).sum(axis=1)
    with np.errstate(over="ignore"):
        low = [s & 0xFFFFFFFFFFFFFFFF for s in sums]
        d = x.view(np.uint64) * np.uint64(n) - np.array(low, dtype=np.uint64)
        wrapped = (d * d).sum(axis=1)
    out: list[int | None] = [int(v) for v in wrapped]
    for i in np.flatnonzero(~(near < 9.2e18)):
        exact = sum((n * int(c) - s) ** 2 for c, s in zip(x[i], sums))
        out[i] = exact if exact < 2**63 else None
    return out


def _whitened(model: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        explained = pa.array([float(v) / model.trace if model.trace > 0 else None for v in model.values], pa.float64())
        for ids, x in slices(batches, model.width):
            white = model.whiten(x).reshape(-1)
            rows = np.repeat(np.arange(len(x)), k)
            part = np.tile(np.arange(k), len(x))
            columns = [
                ids.take(pa.array(rows)), pa.array(part + 1, pa.int32()), pa.array(np.full(len(rows), model.n), pa.int64()), pa.array(deviations(x, model.n, model.sums), pa.int64()).take(pa.array(rows)),
                pa.array(white, pa.float64(), mask=np.isnan(white)), explained.take(pa.array(part)), pa.array([model.identity_error] * len(rows), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whitened(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every row and component.

    Rows whose vector is null or empty, holds a null or non-finite entry, or has another width than
    most distinct vectors, are left out; an empty table gives no rows. Repeated rows come as often
    as they are and count once in the fit; null ids stay null; extra columns are ignored. Vectors
    of fewer entries than `components` have as many components as entries. A component without
    variance (all vectors alike, or dependent entries) has null whitened values, and identity_error
    is null where no component has any; a deviation beyond a long is null.
    """
    vectors = integer_vectors(rows, id_col, vector)
    model = fit(vectors, components)
    schema = "k long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("k", id_col)
    return vectors.filter(F.col("width") == model.width).mapInArrow(_whitened(model), schema).withColumnRenamed("k", id_col)
