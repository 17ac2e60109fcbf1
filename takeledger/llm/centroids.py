"""Centroid clustering in exact integers; the nearest centroid by the threshold algorithm.

Each dimension has the list of centroids sorted by their value in it. From a vector's own value a
list is walked outward, nearest first; a centroid that appears in any list for the first time gets
its exact distance. What no list has shown yet is at least as far as the frontiers together: the
walk ends when the sum of their squared distances strictly exceeds the best exact distance, so
that centroids as near as the best are all seen and the smallest number wins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takeledger.llm.common import settled
from takeledger.llm.vectors import SMALL, integer_vectors, slices, unpacked

#: Components of a vector, centroids, and rounds of assigning and moving.
WIDTH, CENTROIDS, ROUNDS = 64, 40, 5
#: Vectors walked at once, and pairs of a vector and a centroid whose distances are taken at once.
VECTORS, PAIRS = 2048, 16384


class Lists:
    """Centroids and, for each dimension, their numbers in the order of their values."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable")
        self.values = np.take_along_axis(centroids, self.order, axis=0)


def _distances(x: np.ndarray, c: np.ndarray, row: np.ndarray, number: np.ndarray) -> np.ndarray:
    out = [((x[row[at : at + PAIRS]] - c[number[at : at + PAIRS]]) ** 2).sum(axis=1) for at in range(0, len(row), PAIRS)]
    return np.concatenate(out) if out else np.zeros(0, dtype=x.dtype)


def nearest(x: np.ndarray, lists: Lists) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row, its squared distance, and how many distances were taken.

    Entries too large for 64-bit squares are taken as Python's integers.
    """
    c, order, values = lists.centroids, lists.order, lists.values
    if max(int(np.abs(x).max(initial=0)), -int(x.min(initial=0)), int(abs(c).max(initial=0))) > SMALL or c.dtype == object:
        x, c, values = x.astype(object), c.astype(object), values.astype(object)
    n, width = x.shape
    k = len(c)
    best, number = np.full(n, None if x.dtype == object else np.iinfo(np.int64).max), np.full(n, k)
    seen = np.zeros((n, k), dtype=bool)
    # right: the first place of each list whose value is not below the vector's own
    right = np.empty((n, width), dtype=np.int64)
    for d in range(width):
        right[:, d] = np.searchsorted(values[:, d], x[:, d], "left")
    left = right - 1
    active, dims, taken = np.arange(n), np.arange(width), 0
    for _ in range(k):
        lo, hi, own = left[active], right[active], x[active]
        below = np.where(lo >= 0, own - values[np.maximum(lo, 0), dims], -1)
        beyond = np.where(hi < k, values[np.minimum(hi, k - 1), dims] - own, -1)
        down = (beyond < 0) | ((below >= 0) & (below <= beyond))
        shown = order[np.where(down, lo, hi), dims]
        front = np.where(down, below, beyond)
        left[active] -= down
        right[active] += ~down
        fresh = np.zeros((len(active), k), dtype=bool)
        fresh[np.arange(len(active))[:, None], shown] = True
        fresh &= ~seen[active]
        seen[active] |= fresh
        row, which = np.nonzero(fresh)
        row = active[row]
        far = _distances(x, c, row, which)
        taken += len(row)
        # rows and numbers rise, so the first of the least distances of a row is its smallest number
        if len(row):
            first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            least = np.minimum.reduceat(far, first)
            hit = far == np.repeat(least, np.diff(np.append(first, len(row))))
            at = np.flatnonzero(hit)
            at = at[np.concatenate(([True], row[at][1:] != row[at][:-1]))]
            r, f, w = row[at], far[at], which[at]
            empty = number[r] == k
            better = empty.copy()
            rest = ~empty
            better[rest] = (f[rest] < best[r[rest]]) | ((f[rest] == best[r[rest]]) & (w[rest] < number[r[rest]]))
            best[r[better]], number[r[better]] = f[better], w[better]
        active = active[~((front * front).sum(axis=1) > best[active]).astype(bool)]
        if not len(active):
            break
    return number, best, taken


def _partial_sums(centroids: list[list[int]], width: int):
    """Of each task (cluster, dimension, sum, n): the sums of the vectors nearest to a centroid."""
    lists = Lists(_matrix(centroids, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        total, count = [[0] * width for _ in range(k)], np.zeros(k, dtype=np.int64)
        for _, x in slices(batches, width, VECTORS):
            number, _, _ = nearest(x, lists)
            count += np.bincount(number, minlength=k)
            for c in np.unique(number):
                mine = x[number == c]
                # halves of the entries, so that no sum of a slice leaves 64 bits
                high, low = (mine >> 32).sum(axis=0), (mine & 0xFFFFFFFF).sum(axis=0)
                total[c] = [t + (int(h) << 32) + int(lo) for t, h, lo in zip(total[c], high, low)]
        held = np.flatnonzero(count)
        columns = [np.repeat(held, width), np.tile(np.arange(width), len(held)), [str(s) for c in held for s in total[c]], np.repeat(count[held], width)]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64())], names=["cluster", "d", "s", "n"])

    return run


def _matrix(centroids: list[list[int]], width: int) -> np.ndarray:
    large = any(abs(v) > SMALL for c in centroids for v in c)
    return np.array(centroids, dtype=object if large else np.int64).reshape(-1, width)


def _assigned(centroids: list[list[int]], width: int):
    lists = Lists(_matrix(centroids, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in slices(batches, width, VECTORS):
            number, far, _ = nearest(x, lists)
            fits = [int(f) if f < 2**63 else None for f in far]
            yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int32()), pa.array(fits, pa.int64())], names=["k", "cluster", "distance"])

    return run


def moved(rows: DataFrame, centroids: list[list[int]], width: int) -> list[list[int]]:
    """One round: every centroid at the floor of its vectors' mean; empty ones stay."""
    summed = rows.mapInArrow(_partial_sums(centroids, width), "cluster int, d int, s string, n long").groupBy("cluster", "d")
    out = [list(c) for c in centroids]
    for c, d, s, n in summed.agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect():
        out[c][d] = int(s) // n
    return out


def clustered(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", width: int = WIDTH, centroids: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of `width`.

    Components become floor(256 * component). Centroids start as the vectors with the smallest
    sha256 of `2:<id>` (of rows that repeat an id the one with the smallest packed vector first;
    null ids last) and move `rounds` times. Vectors that are null, of another width, or hold null
    or non-finite components have no row; an empty table gives none, and fewer vectors than
    `centroids` are as many centroids. Repeated rows each count; extra columns are ignored. A
    distance or inertia beyond a long is null.

    What reaches the driver is the centroids and, each round, width x centroids sums.
    """
    spark = rows.sparkSession
    kept = settled(integer_vectors(rows, id_col, vector).filter(F.col("width") == width).select("k", "x"), "vectors")
    seed = F.sha2(F.concat(F.lit("2:"), F.col("k").cast("string")), 256)
    start = kept.select(seed.alias("h"), "x").orderBy(F.asc_nulls_last("h"), "x").limit(centroids).collect()
    schema = "k long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not start:
        return spark.createDataFrame([], schema).withColumnRenamed("k", id_col)
    at = unpacked([bytes(r.x) for r in start], width).tolist()
    for _ in range(rounds):
        at = moved(kept, at, width)
    found = settled(kept.mapInArrow(_assigned(at, width), "k long, cluster int, distance long"), "assigned")
    wide = F.sum(F.col("distance").cast("decimal(38,0)"))
    whole = found.groupBy("cluster").agg(F.when(F.count("distance") == F.count("*"), wide).alias("s")).collect()
    fits = lambda s: int(s) if s is not None and s < 2**63 else None
    total = fits(None if any(r.s is None for r in whole) else sum(int(r.s) for r in whole))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    # at most as many rows as there are centroids
    facts = spark.createDataFrame([(r.cluster, fits(r.s), total, digests[r.cluster]) for r in whole], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(F.col("k").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
