"""Arrays that tasks pass on as blobs by part, and sorted shards that workers memory-map."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd

_U64 = np.uint64


def pack6(h: np.ndarray) -> bytes:
    """48-bit values as 6 bytes each."""
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack6(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


def short(h: np.ndarray) -> np.ndarray:
    """The 48-bit form of word hashes that bigrams are made of."""
    return h >> _U64(16)


def range_part(h: np.ndarray, parts: int) -> np.ndarray:
    """The part of each 48-bit word hash: equal ranges, so that parts are sorted runs."""
    return ((h >> _U64(16)) * _U64(parts) >> _U64(32)).astype(np.int64)


def blob_rows(frames: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(frames, columns=["part", "blob"])


def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list[bytes]]]:
    """The blobs of one part after the other; rows are sorted by part."""
    part, blobs = None, []
    for b in batches:
        for p, raw in zip(b["part"], b["blob"]):
            if p != part and blobs:
                yield part, blobs
                blobs = []
            part = p
            blobs.append(raw)
    if blobs:
        yield part, blobs


def save(folder: str, name: str, **arrays: np.ndarray) -> None:
    """Arrays as files of the shared folder; each appears whole, a repeated task writes the same."""
    for key, a in arrays.items():
        temporary = os.path.join(folder, f".{name}.{key}.{uuid.uuid4().hex}")
        np.save(temporary, a)
        os.replace(temporary + ".npy", os.path.join(folder, f"{name}.{key}.npy"))


_MAPPED: dict[str, np.ndarray] = {}


def mapped(folder: str, name: str, key: str) -> np.ndarray:
    """A file's array, memory-mapped once per worker; an absent part is empty."""
    path = os.path.join(folder, f"{name}.{key}.npy")
    if path not in _MAPPED:
        _MAPPED[path] = np.load(path, mmap_mode="r") if os.path.exists(path) else np.zeros(0, dtype=np.uint64)
    return _MAPPED[path]
