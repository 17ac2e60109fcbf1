"""What the corpus operators share: reading tables, held-out marks, shared folders, text as bytes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch: bounds what a Python worker holds of long texts at once.
BATCH_ROWS = 2048

_U64 = np.uint64


def tuned(spark: SparkSession) -> SparkSession:
    """The session with Arrow batches of BATCH_ROWS rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: Column, parts: int) -> Column:
    """crc32 of the key's text modulo `parts`; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts


#: Folders written since a `temporary` scope began.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir, which the driver and all executors see.

    Where the setting is absent (tests, local mode) a folder under the warehouse is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if (written := _WRITTEN.get()) is not None:
        written.append(path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared storage that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """All folders that are written inside go at its end: what is kept has to be written before
    the scope begins to be its own, by `settled_at` a path from outside."""
    token = _WRITTEN.set([])
    try:
        yield
    finally:
        for path in _WRITTEN.get() or []:
            discard(spark, path)
        _WRITTEN.reset(token)


def settled_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage, survives lost executors."""
    return settled_at(df, shared_folder(df.sparkSession, name))


#: Keys that stand out of the others are at most this many; they may be broadcast.
HOT_KEYS = 20_000


def with_value(rows: DataFrame, values: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with values, which has one row a key and in `n` how many of `rows` hold it.

    total: the rows, or more. A key that holds over total / HOT_KEYS of them (and over a thousand)
    is hot: there are at most HOT_KEYS, so these go to where the rows are and only the rows of
    other keys are dealt by key. No key's rows have to fit one task.
    """
    bound = max(1000, total // HOT_KEYS)
    hot = F.broadcast(values.filter(F.col("n") > bound).drop("n"))
    cold = rows.join(hot.select(key), key, "left_anti").join(values.filter(F.col("n") <= bound).drop("n"), key)
    return rows.join(hot, key).unionByName(cold)


def local_path(uri: str) -> str:
    """The mounted path of a file: URI, for memory-mapping; other schemes can't be mapped."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"memory-mapped models need a mounted shared folder, not {uri}")
    return uri


# ---- text as arrays -------------------------------------------------------------------------

def joined_bytes(texts: list[str | None], gap: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, each followed by `gap` newlines, and the start of each text.

    Null is the empty text; a lone surrogate becomes '?'.
    """
    parts = [(t or "").encode("utf-8", "replace") for t in texts]
    starts = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum(np.fromiter((len(p) + gap for p in parts), dtype=np.int64, count=len(parts)), out=starts[1:])
    tail = b"\n" * gap
    return np.frombuffer(tail.join(parts) + tail if parts else b"", dtype=np.uint8), starts


def _tables() -> tuple[np.ndarray, np.uint64, np.uint64]:
    rng = np.random.default_rng(20240201)
    base = 0x9E3779B97F4A7C15
    return rng.integers(1, 2**64, 256, dtype=np.uint64), _U64(base), _U64(pow(base, -1, 2**64))


BYTE_CODE, _BASE, _INVERSE = _tables()
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept for the worker's next batch."""
    if not _POWERS or len(_POWERS["up"]) <= n:
        size = 1 << max(16, int(n).bit_length())
        with np.errstate(over="ignore"):
            for key, b in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, b, dtype=np.uint64)
                steps[0] = 1
                _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U64(32))) * _U64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> _U64(32))) * _U64(0xD6E8FEB86659FD93)
        return h ^ (h >> _U64(32))


#: Bytes per slice when prefix sums are taken, so that the power tables stay small.
_SLICE = 1 << 19


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run data[starts[i]:ends[i]]; runs are sorted and disjoint."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            at = int(starts[i])
            j = max(i + 1, int(np.searchsorted(ends, at + _SLICE, "right")))
            upto = int(ends[j - 1])
            up, down = _powers(upto - at)
            prefix = np.zeros(upto - at + 1, dtype=np.uint64)
            np.cumsum(BYTE_CODE[data[at:upto]] * up[: upto - at], out=prefix[1:])
            s = starts[i:j] - at
            out[i:j] = (prefix[ends[i:j] - at] - prefix[s]) * down[s]
            i = j
    return mixed(out)


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal True runs of a boolean array."""
    edge = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _word_bytes() -> np.ndarray:
    flags = np.zeros(256, dtype=bool)
    flags[128:] = True
    for lo, hi in (("0", "9"), ("A", "Z"), ("a", "z")):
        flags[ord(lo) : ord(hi) + 1] = True
    return flags


#: ASCII letters and digits and every byte of a non-ASCII character belong to words.
WORD_BYTE = _word_bytes()


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words of all texts in order, and each text's first index (n + 1)."""
    data, starts = joined_bytes([t.lower() if t else t for t in texts])
    s, e = runs_of(WORD_BYTE[data])
    return run_hashes(data, s, e), np.searchsorted(s, starts)


def shingle_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every n consecutive words of a text, and each text's first index (n + 1).

    A text of fewer than n words, but at least one, has one shingle: all its words.
    """
    counts = np.diff(first)
    with np.errstate(over="ignore"):
        k = _U64(0xA0761D6478BD642F)
        total = max(0, len(words) - n + 1)
        h = np.zeros(total, dtype=np.uint64)
        for t in range(n):
            h = h * k + words[t : t + total]
        h = mixed(h)
        ends = np.repeat(first[1:], counts)
        whole = np.flatnonzero(np.arange(total) + n <= ends[:total])
        owner = np.repeat(np.arange(len(counts)), counts)
        short = np.flatnonzero((counts > 0) & (counts < n))
        few = np.empty(len(short), dtype=np.uint64)
        for i, d in enumerate(short):
            x = _U64(counts[d])
            for w in words[first[d] : first[d + 1]]:
                x = x * k + w
            few[i] = x
    of = np.concatenate((owner[whole], short))
    order = np.argsort(of, kind="stable")
    sizes = np.bincount(of, minlength=len(counts)) if len(of) else np.zeros(len(counts), dtype=np.int64)
    at = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(sizes, out=at[1:])
    return np.concatenate((h[whole], mixed(few)))[order], at


#: Bytes of text taken into arrays at once.
CHUNK_BYTES = 6_000_000


def chunks(texts: list[str | None], most: int = CHUNK_BYTES):
    """Slices of the list with about `most` characters each; a longer text stands alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > at and size + n > most:
            yield slice(at, i)
            at, size = i, 0
        size += n
    if at < len(texts):
        yield slice(at, len(texts))


def as_texts(column) -> list[str | None]:
    """A pandas column's strings; whatever stands for null becomes None."""
    return [t if isinstance(t, str) else None for t in column]
