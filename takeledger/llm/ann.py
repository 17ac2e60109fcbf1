"""Approximate nearest neighbours by shifted space-filling curves."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from takeledger.llm.common import settled, with_value

#: Curves, projected dimensions of each, and bits of a coordinate.
CURVES, DIMENSIONS, BITS = 24, 6, 10
#: Vectors that the projections and the grid are fitted to, at most.
FIT_ROWS = 5000
#: Queries whose exact neighbours set the reach, at most, and the share of these to be met.
SAMPLE, TARGET = 128, 0.96
#: The least reach: places of a curve on either side of a query.
LEAST = 32
#: Places of a block of a curve, and queries that are held against a block at once.
BLOCK, QUERIES = 4096, 4096
#: Candidates of a query that are scored again exactly, for each neighbour wanted.
FINALISTS = 4


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of grid cells (rows x dimensions, each below 2**bits).

    Gray-code form: for every bit from the highest, coordinates are reflected or exchanged with
    the first one; then the bits are interleaved.
    """
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    top = np.uint64(1) << np.uint64(bits - 1)
    q = top
    while q > 1:
        low = q - np.uint64(1)
        for i in range(n):
            high = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & low
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ swap)
        q >>= np.uint64(1)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - np.uint64(1)), turn)
        q >>= np.uint64(1)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return key.view(np.int64)


@dataclass
class Grid:
    """Projections (curves x width x dimensions) and the grid (low, extent, shift) of each."""

    planes: np.ndarray
    low: np.ndarray
    extent: np.ndarray
    shifts: np.ndarray


def fitted(sample: np.ndarray, curves: int, dimensions: int) -> Grid:
    """Random directions drawn by the sample's own spread, and a grid over most of the sample.

    A curve's directions are combinations of the principal directions, each in proportion to its
    deviation: where the vectors lie in few dimensions, the curves see these.
    """
    rng = np.random.default_rng(17)
    width = sample.shape[1]
    k = min(dimensions, width)
    spread, axes = np.linalg.eigh(sample.T @ sample / max(len(sample), 1))
    weight = axes * np.sqrt(np.maximum(spread, 0) + 1e-12)
    planes = np.stack([np.linalg.qr(weight @ rng.standard_normal((width, k)))[0] for _ in range(curves)])
    places = np.einsum("nw,cwk->cnk", sample, planes)
    low, high = np.quantile(places, (0.01, 0.99), axis=1) if len(sample) else np.zeros((2, curves, k))
    return Grid(planes, low, np.maximum(high - low, 1e-12), rng.random((curves, k)))


def keys_of(unit: np.ndarray, grid: Grid, bits: int) -> np.ndarray:
    """Hilbert keys of unit vectors on every curve (rows x curves)."""
    out = []
    for planes, low, extent, shift in zip(grid.planes, grid.low, grid.extent, grid.shifts):
        # three quarters of the grid hold the sample; where they lie in it is the curve's shift
        cells = np.clip((unit @ planes - low) / extent * 0.75 + shift * 0.25, 0, 1 - 1e-9)
        out.append(hilbert_keys((cells * (1 << bits)).astype(np.int64), bits))
    return np.stack(out, axis=1)


def _units(column, width: int) -> np.ndarray:
    v = np.array([np.asarray(x, dtype=np.float64) for x in column]).reshape(-1, width)
    v = v / np.abs(v).max(axis=1, keepdims=True, initial=1e-300)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _keyed(grid: Grid, width: int, bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            unit = _units(b["v"], width)
            yield pd.DataFrame({"k": b["k"].to_numpy(), "v": [x.tobytes() for x in unit.astype(np.float16)], "keys": list(keys_of(unit, grid, bits))})

    return run


def _ranked(keyed: DataFrame, parts: int) -> DataFrame:
    """Rows with their place in each curve's order: sorted by ranges, then counted range by range."""
    spread = keyed.select("k", F.posexplode("keys").alias("curve", "key"))
    sorted_rows = settled(spread.repartitionByRange(parts, "curve", "key", "k").sortWithinPartitions("curve", "key", "k").withColumn("part", F.spark_partition_id()), "curves")
    sizes = sorted_rows.groupBy("curve", "part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("skip", F.sum("n").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("curve", "part", F.coalesce("skip", F.lit(0)).alias("skip"))
    local = F.row_number().over(Window.partitionBy("curve", "part").orderBy("key", "k")) - 1
    return sorted_rows.withColumn("local", local).join(F.broadcast(before), ["curve", "part"]).select("k", "curve", (F.col("skip") + F.col("local")).alias("place"))


def _top(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Indices of the n largest scores, ties to the smaller id."""
    at = np.arange(len(scores))
    if len(scores) > 4 * n:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - n)[len(scores) - n])
    return at[np.lexsort((ids[at], -scores[at]))][:n]


def _window(width: int, reach: int, keep: int):
    """A block of a curve, then queries near it, to each query's best rows in its window there."""

    def vectors(column) -> np.ndarray:
        return np.frombuffer(b"".join(column), dtype=np.float16).reshape(-1, width).astype(np.float32)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            left = left.sort_values("place")
            rows, ids, places = vectors(left["v"]), left["k"].to_numpy(), left["place"].to_numpy()
            asked, own, at = vectors(right["v"]), right["k"].to_numpy(), right["place"].to_numpy()
            low, high = np.searchsorted(places, at - reach), np.searchsorted(places, at + reach, "right")
            for q, a, b, vector in zip(own, low, high, asked):
                # rounded, as equal rows may differ in the last bits by their place in the product
                scores = np.round(rows[a:b] @ vector, 5)
                best = _top(scores, ids[a:b], keep)
                out.append((np.full(len(best), q), ids[a:b][best], scores[best].astype(np.float64)))
        q, c, score = map(np.concatenate, zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pd.DataFrame({"q": q, "c": c, "score": score})

    return run


def _against(asked: np.ndarray, names: np.ndarray, width: int, top: int):
    """Each sampled query's best rows of every batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            near, ids = _units(b["v"], width) @ asked.T, b["k"].to_numpy()
            near[ids[:, None] == names[None, :]] = -np.inf
            for j, q in enumerate(names):
                best = _top(near[:, j], ids, top)
                best = best[np.isfinite(near[best, j])]
                yield pd.DataFrame({"q": np.full(len(best), q), "c": ids[best], "score": near[best, j]})

    return run


def _exact(width: int):
    """Cosines of pairs of vectors, in the same order of operations for every pair."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            score = (_units(b["a"], width) * _units(b["b"], width)).sum(axis=1)
            yield pd.DataFrame({"q": b["q"], "c": b["c"], "score": score})

    return run


def needed_reach(distinct: DataFrame, placed: DataFrame, is_query: str, width: int, top: int, target: float) -> int:
    """The least reach in which the sampled queries meet `target` of their exact neighbours.

    At most SAMPLE queries, chosen by hash, are held against all rows; the distance of a
    neighbour is its least distance in places on any curve.
    """
    sample = distinct.filter(is_query).orderBy(F.xxhash64("k"), "k").limit(SAMPLE).select("k", "v").toPandas()
    if sample.empty:
        return LEAST
    near = distinct.select("k", "v").mapInPandas(_against(_units(sample["v"], width), sample["k"].to_numpy(), width, top), "q long, c long, score double")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))
    pairs = near.withColumn("rank", place).filter(F.col("rank") <= top).select("q", "c").toPandas()
    if pairs.empty:
        return LEAST
    ids = distinct.sparkSession.createDataFrame([(int(x),) for x in np.union1d(pairs["q"], pairs["c"])], "k long")
    at = placed.join(F.broadcast(ids), "k").select("k", "curve", "place").toPandas().pivot(index="k", columns="curve", values="place")
    apart = np.abs(at.loc[pairs["q"]].to_numpy() - at.loc[pairs["c"]].to_numpy()).min(axis=1)
    return max(LEAST, int(np.sort(apart)[min(len(apart), int(np.ceil(target * len(apart)))) - 1]))


def nearest(vectors: DataFrame, is_query: str, top: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", reach: int | None = None, target: float = TARGET, curves: int = CURVES, dimensions: int = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """(query_id, rank, vec_id, score): the `top` rows of largest cosine found for each query row.

    Different vectors stand on several Hilbert curves of projections, each with its own shift of
    the grid. A query's window are the `reach` places on either side of its own on every curve;
    the best of all windows are scored again exactly. Without a reach the least one is taken in
    which sampled queries meet `target` of their exact neighbours: near vectors that cluster need
    few places whatever the table's size, vectors without structure need most of the table.
    `reach` = all rows is exact. is_query: SQL condition on the id column. Equal vectors share a
    place, and their ids compete in the end; ties go to the smaller id; a query is no candidate
    of its own.

    Vectors that are null, zero, of another length than most, or with null or non-finite
    components take no part, as rows with a null id don't; of rows that repeat an id one takes
    part. Fewer rows than `top` are all returned; an empty table gives no rows. Curve orders are
    range-partitioned; a task holds one block of BLOCK places and at most about QUERIES queries.
    """
    spark = vectors.sparkSession
    asked = is_query.replace(id_col, "k")
    rows = vectors.select(vectors[id_col].cast("long").alias("k"), vectors[vector_col].cast("array<double>").alias("v")).filter("k is not null and v is not null")
    # x - x is zero for finite numbers only
    rows = rows.filter("forall(v, x -> x is not null and x - x = 0) and exists(v, x -> x <> 0)").groupBy("k").agg(F.min("v").alias("v"))
    rows = settled(rows.withColumn("asked", F.expr(asked)), "rows")
    width = rows.agg(F.mode(F.size("v"), deterministic=True)).first()[0] or 1
    rows = rows.filter(F.size("v") == width)
    distinct = settled(rows.groupBy("v").agg(F.min("k").alias("k"), F.count("*").alias("n"), F.max("asked").alias("asked")), "distinct")
    counts = distinct.agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.count_if("asked").alias("asked")).first()
    total = counts["rows"]
    sample = distinct.orderBy(F.xxhash64("v", "k")).limit(FIT_ROWS).select("v").toPandas()
    grid = fitted(_units(sample["v"], width), curves, dimensions)
    keyed = settled(distinct.mapInPandas(_keyed(grid, width, bits), "k long, v binary, keys array<long>"), "keyed")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = settled(_ranked(keyed, parts), "placed")
    if reach is None:
        reach = needed_reach(distinct, placed, "asked", width, top, target)
    reach = min(reach, max(total, 1))
    # queries that reach a block, where they are many, are dealt over slices that each see the block
    slices = 1 + int(counts["asked"] * min(1.0, (2 * reach + BLOCK) / max(total, 1))) // QUERIES
    held = placed.join(keyed.select("k", "v"), "k")
    fresh = [F.col(c).alias(c) for c in ("k", "v", "curve", "place")]  # as columns of their own on either side
    blocks = held.select(*fresh, F.floor(F.col("place") / BLOCK).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    low = F.floor(F.greatest(F.lit(0), F.col("place") - reach) / BLOCK)
    high = F.floor(F.least(F.lit(max(total - 1, 0)), F.col("place") + reach) / BLOCK)
    questions = held.join(distinct.filter("asked").select("k"), "k", "left_semi").select(*fresh, F.explode(F.sequence(low, high)).alias("block"), F.pmod(F.xxhash64("k"), F.lit(slices)).cast("int").alias("slice"))
    by = ["curve", "block", "slice"]
    found = blocks.groupBy(*by).cogroup(questions.groupBy(*by)).applyInPandas(_window(width, reach, FINALISTS * top), "q long, c long, score double")
    # the row with the query's own vector stands in every window, whatever the order of equal scores
    near = found.groupBy("q", "c").agg(F.max("score").alias("score"))
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.col("q") == F.col("c")), F.desc("score"), "c"))
    near = near.withColumn("at", best).filter(F.col("at") <= FINALISTS * top).select("q", "c")
    pairs = near.join(distinct.select(F.col("k").alias("q"), F.col("v").alias("a")), "q").join(distinct.select(F.col("k").alias("c"), F.col("v").alias("b")), "c")
    scored = pairs.mapInPandas(_exact(width), "q long, c long, score double")
    # of equal vectors one more id than wanted: the query's own may be among them
    order = F.row_number().over(Window.partitionBy("v").orderBy("k"))
    firsts = rows.withColumn("at", order).filter(F.col("at") <= top + 1).join(distinct.select("v", F.col("k").alias("c")), "v").select("c", "k")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "k"))
    lists = scored.join(firsts, "c").withColumn("at", place).filter(F.col("at") <= top + 1)
    lists = lists.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("at", "k", "score"))).alias("list"))
    whose = with_value(rows.filter("asked"), distinct.select("v", F.col("k").alias("q"), "n"), "v", counts["n"] or 0).select("k", "q")
    answers = with_value(whose, lists.join(distinct.select(F.col("k").alias("q"), "n"), "q"), "q", counts["n"] or 0)
    own = F.slice(F.filter("list", lambda x: x["k"] != F.col("k")), 1, top)
    ranked = answers.select(F.col("k").alias("query_id"), F.posexplode(own).alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.k").alias("vec_id"), F.col("x.score").alias("score"))
