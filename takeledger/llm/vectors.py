"""Vectors of integers for the exact operators: floor(256 * component), packed, as arrays in tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of a unit: x = floor(SCALE * component).
SCALE = 256
#: Up to this absolute value, squared distances of some hundred components fit 64 bits.
SMALL = 1 << 26
_LONG = np.iinfo(np.int64)
#: What an entry is stored in: the least of these that holds all entries of the vector.
_STORED = (np.int8, np.int16, np.int32, np.int64)


def floors(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * value) as int64; beyond the range of long the nearest end of it."""
    with np.errstate(over="ignore"):
        f = np.floor(values * SCALE)
    out = np.clip(f, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
    out[f >= 2.0**63] = _LONG.max
    return out


def _packed(x: np.ndarray) -> list[bytes]:
    """Rows as bytes: the size of an entry, then the entries; equal rows give equal bytes."""
    out = [b""] * len(x)
    low, high = x.min(axis=1), x.max(axis=1)
    left = np.ones(len(x), dtype=bool)
    for kind in _STORED:
        fits = left & (low >= np.iinfo(kind).min) & (high <= np.iinfo(kind).max)
        head, rows = bytes([np.dtype(kind).itemsize]), x[fits].astype(kind)
        for i, row in zip(np.flatnonzero(fits), rows):
            out[i] = head + row.tobytes()
        left &= ~fits
    return out


def unpacked(raw: list[bytes], width: int) -> np.ndarray:
    """The rows (int64) of packed vectors of that width."""
    out = np.empty((len(raw), width), dtype=np.int64)
    sizes = np.fromiter((r[0] for r in raw), dtype=np.int64, count=len(raw))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        out[at] = np.frombuffer(b"".join(raw[i][1:] for i in at), dtype=f"<i{size}").reshape(-1, width)
    return out


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, lists = b.column(0), b.column(1)
        offsets = lists.offsets.to_numpy()
        values = lists.values.to_numpy(zero_copy_only=False)  # nulls become NaN
        sizes = np.diff(offsets)
        bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
        sound = (sizes > 0) & (bad[offsets[1:]] == bad[offsets[:-1]]) & ~np.asarray(lists.is_null())
        rows, packed, widths = [], [], []
        for width in np.unique(sizes[sound]):
            at = np.flatnonzero(sound & (sizes == width))
            x = floors(values[offsets[at][:, None] + np.arange(width)])
            rows.append(at)
            packed += _packed(x)
            widths += [int(width)] * len(at)
        take = pa.array(np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64))
        yield pa.RecordBatch.from_arrays([ids.take(take), pa.array(packed, pa.binary()), pa.array(widths, pa.int32())], names=["k", "x", "width"])


def integer_vectors(rows: DataFrame, id_col: str, vector: str | Column) -> DataFrame:
    """(k, x, width) of every row whose vector is neither null nor empty and holds only finite numbers.

    x is floor(256 * component) of each component as a double, packed. Ids may be null or repeat.
    """
    vector = F.col(vector) if isinstance(vector, str) else vector
    listed = rows.select(F.col(id_col).cast("long").alias("k"), vector.cast("array<double>").alias("v")).filter("v is not null")
    return listed.mapInArrow(_integers, "k long, x binary, width int")


def slices(batches: Iterator[pa.RecordBatch], width: int, most: int = 4096) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The id column and the integers of packed vectors, at most `most` rows at once."""
    for b in batches:
        for at in range(0, b.num_rows, most):
            part = b.slice(at, most)
            yield part.column("k") if "k" in part.schema.names else None, unpacked(part.column("x").to_pylist(), width)
