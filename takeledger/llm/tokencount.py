"""Token counts: byte-level BPE with rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from takeledger.llm.common import chunks

#: The split pattern of byte-level BPE vocabularies of this family.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Counts of distinct pre-tokens that a worker remembers; beyond it the memory starts anew.
REMEMBERED = 500_000
#: Bytes of distinct pre-tokens merged at once.
MERGE_BYTES = 4_000_000


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class RankMerger:
    """Counts the symbols that survive BPE merging, for many byte sequences at once.

    Every round takes in each sequence the adjacent pair of lowest rank and merges all its
    occurrences, leftmost first where they overlap; sequences without a mergeable pair are done.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.base = np.array([vocab[c] for c in byte_letters()], dtype=np.int64)
        self.width = max(vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], dtype=np.int64)
        ids = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.none = len(keys)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), np.append(ids, -1)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split = regex.compile(SPLIT)
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.known: dict[str, int] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or self.none."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], self.none)

    def merged_sizes(self, parts: list[bytes]) -> np.ndarray:
        """Symbols left of each non-empty byte sequence."""
        done = np.zeros(len(parts), dtype=np.int64)
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        sym = self.base[np.frombuffer(b"".join(parts), dtype=np.uint8)]
        seq = np.repeat(np.arange(len(parts)), sizes)
        rank = np.full(len(sym), self.none, dtype=np.int64)  # of the pair that begins here
        inner = np.flatnonzero(seq[:-1] == seq[1:])
        rank[inner] = self.ranks(sym[inner], sym[inner + 1])
        while len(sym):
            first = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            count = np.diff(np.append(first, len(seq)))
            low = np.minimum.reduceat(rank, first)
            ended = low == self.none
            if ended.any():
                done[seq[first[ended]]] = count[ended]
                going = np.repeat(~ended, count)
                sym, seq, rank = sym[going], seq[going], rank[going]
                low, count = low[~ended], count[~ended]
                if not len(sym):
                    break
            hit = rank == np.repeat(low, count)
            where = np.flatnonzero(hit)
            # of overlapping occurrences (a run of equal symbols) every second one merges
            start = np.concatenate(([True], (where[1:] != where[:-1] + 1) | (seq[where[1:]] != seq[where[:-1]])))
            run = np.maximum.accumulate(np.where(start, np.arange(len(where)), 0))
            where = where[(np.arange(len(where)) - run) % 2 == 0]
            sym[where] = self.made[rank[where]]
            keep = np.ones(len(sym), dtype=bool)
            keep[where + 1] = False
            moved = np.cumsum(keep) - 1
            sym, seq, rank = sym[keep], seq[keep], rank[keep]
            now = moved[where]
            redo = np.unique(np.concatenate((now, now[now > 0] - 1)))
            last = (redo + 1 >= len(seq)) | (seq[np.minimum(redo + 1, len(seq) - 1)] != seq[redo])
            rank[redo[last]] = self.none
            redo = redo[~last]
            rank[redo] = self.ranks(sym[redo], sym[redo + 1])
        return done

    def learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > REMEMBERED:
            self.known = {}
        new = [w for w in words if w not in self.known]
        raw = [w.encode("utf-8", "replace") for w in new]
        at, size = 0, 0
        for i, b in enumerate(raw):
            size += len(b)
            if size >= MERGE_BYTES or i + 1 == len(raw):
                self.known.update(zip(new[at : i + 1], self.merged_sizes(raw[at : i + 1]).tolist()))
                at, size = i + 1, 0

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; null is empty, an added special string in a text is one token."""
        tokens, specials = [], []
        for t in texts:
            pieces = self.at_special.split(t) if t and self.at_special else [t or ""]
            specials.append(len(pieces) - 1)
            found = self.split.findall(pieces[0])
            for piece in pieces[1:]:
                found += self.split.findall(piece)
            tokens.append(found)
        self.learn(set().union(*tokens))
        known = self.known
        return [s + sum(map(known.__getitem__, found)) for s, found in zip(specials, tokens)]


_MERGERS: dict[str, RankMerger] = {}


def merger(path: str) -> RankMerger:
    """One per worker process: the tables are read once and pre-token counts are remembered."""
    if path not in _MERGERS:
        _MERGERS[path] = RankMerger(path)
    return _MERGERS[path]


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row of docs, without a shuffle.

    path: a byte-level BPE vocabulary file that each worker can open. Null and empty texts have
    0 bytes and 0 tokens; repeated rows are counted each; other columns are ignored; an empty
    table gives no rows. Memory is bounded by an Arrow batch, the pre-tokens of a slice of it of
    a few megabytes (a longer text stands alone), and REMEMBERED pre-tokens.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = merger(path)
        for b in batches:
            texts = [t if isinstance(t, str) else None for t in b["t"]]
            n = np.array([c for part in chunks(texts) for c in m.counts(texts[part])], dtype=np.int64)
            size = np.fromiter((len(t.encode("utf-8", "replace")) if t else 0 for t in texts), dtype=np.int64, count=len(texts))
            yield pd.DataFrame({id_col: b["k"], "n_bytes": size, "n_tokens": n, "over_limit": n > limit})

    picked = docs.select(docs[id_col].alias("k"), docs[text_col].alias("t"))
    return picked.mapInPandas(counted, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
