"""Interpolated modified Kneser-Ney bigram model: counted in Spark, memory-mapped by workers."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takeledger.llm.common import as_texts, chunks, joined_bytes, local_path, mixed, run_hashes, runs_of, settled, shared_folder
from takeledger.llm.shards import blob_rows, gathered, mapped, pack6, range_part, save, short, unpack6

#: Tokens that a task counts before it passes its counts on.
RUN_TOKENS = 3_000_000
#: Characters of texts that are scored at once.
SCORED_BYTES = 3_000_000
#: A word is hot if it has a part's share of tokens over this number; its bigrams are spread.
HOT_SHARE = 4

_U64 = np.uint64
END, START = _U64(0x517CC1B727220A95), _U64(0x2545F4914F6CDD1D)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def token_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all texts (words, then an end each), the hash before each, and text starts.

    ASCII letters are folded to lower case; words are what white space (0x20, 0x09-0x0D) parts.
    """
    data, starts = joined_bytes(texts)
    data = _LOWER[data]
    s, e = runs_of(~_SPACE[data])
    words = run_hashes(data, s, e)
    first = np.searchsorted(s, starts)
    counts = np.diff(first)
    at = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts + 1, out=at[1:])
    tokens = np.full(int(at[-1]), END, dtype=np.uint64)
    tokens[np.arange(len(words)) + np.repeat(np.arange(len(counts)), counts)] = words
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[at[:-1]] = START
    return tokens, before, at


# ---- bigrams as keys -------------------------------------------------------------------------

def pair_part(u: np.ndarray, w: np.ndarray, parts: int, hot: np.ndarray) -> np.ndarray:
    """The part of each bigram: its first word's, but hot first words are spread by the second."""
    spread = np.isin(u, hot) if len(hot) else np.zeros(len(u), dtype=bool)
    return np.where(spread, range_part(w, parts), range_part(mixed(u) >> _U64(16), parts))


def pair_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A 48-bit key in the upper bits, the lower 16 left for a count."""
    with np.errstate(over="ignore"):
        return mixed(u * _U64(0x9E3779B97F4A7C15) + w) & ~_U64(0xFFFF)


# ---- counting -------------------------------------------------------------------------------

def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and the sums of the values for each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate((np.ones(1, dtype=bool), keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[at], *[np.add.reduceat(v[order], at, dtype=v.dtype) if len(at) else v[:0] for v in values]


def _count_words(parts: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def flush() -> pd.DataFrame:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(range_part(short(keys), parts), np.arange(parts + 1))
            return blob_rows([(p, np.int64(hi - lo).tobytes() + keys[lo:hi].tobytes() + n[lo:hi].astype(np.uint32).tobytes()) for p, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if hi > lo])

        for b in batches:
            texts = as_texts(b["t"])
            for part in chunks(texts):
                held.append(token_hashes(texts[part])[0])
                size += len(held[-1])
                if size >= RUN_TOKENS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def _merge_words(folder: str, parts: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, blobs in gathered(batches):
            keys, counts = [], []
            for raw in blobs:
                n = int(np.frombuffer(raw[:8], dtype=np.int64)[0])
                keys.append(np.frombuffer(raw, dtype=np.uint64, count=n, offset=8))
                counts.append(np.frombuffer(raw, dtype=np.uint32, count=n, offset=8 + 8 * n).astype(np.uint64))
            h, c = _summed(np.concatenate(keys), np.concatenate(counts))
            save(folder, f"words-{part}", h=h, c=c)
            total = int(c.sum())
            heavy = np.flatnonzero(c * _U64(HOT_SHARE * parts) >= total)
            yield pd.DataFrame({"tokens": [total], "distinct": [len(h)], "hot": [short(h[heavy]).view(np.int64)], "counts": [c[heavy].astype(np.int64)]})

    return run


def _count_pairs(parts: int, hot: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def flush() -> pd.DataFrame:
            u = np.concatenate([x[0] for x in held])
            w = np.concatenate([x[1] for x in held])
            key = pair_key(u, w)
            key, index, n = np.unique(key, return_index=True, return_counts=True)
            u, w = u[index], w[index]
            part = pair_part(u, w, parts, hot)
            order = np.lexsort((u, part))
            u, w, n, part = u[order], w[order], n[order].astype(np.uint32), part[order]
            cuts = np.searchsorted(part, np.arange(parts + 1))
            out = []
            for p, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                if hi > lo:
                    own = u[lo:hi]
                    new = np.flatnonzero(np.concatenate((np.ones(1, dtype=bool), own[1:] != own[:-1])))
                    times = np.diff(np.append(new, hi - lo)).astype(np.uint32)
                    sizes = np.array([len(new), hi - lo], dtype=np.int64)
                    out.append((p, sizes.tobytes() + times.tobytes() + n[lo:hi].tobytes() + pack6(own[new]) + pack6(w[lo:hi])))
            return blob_rows(out)

        for b in batches:
            texts = as_texts(b["t"])
            for part in chunks(texts):
                tokens, before, _ = token_hashes(texts[part])
                held.append((short(before), short(tokens)))
                size += len(tokens)
                if size >= RUN_TOKENS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def _merge_pairs(folder: str, parts: int):
    """Bigram shards; counts of counts, and what they say of first and second words, as rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, blobs in gathered(batches):
            us, ws, ns = [], [], []
            for raw in blobs:
                few, many = np.frombuffer(raw[:16], dtype=np.int64)
                at = 16 + 4 * few
                times = np.frombuffer(raw, dtype=np.uint32, count=few, offset=16)
                ns.append(np.frombuffer(raw, dtype=np.uint32, count=many, offset=at).astype(np.uint64))
                at += 4 * many
                us.append(np.repeat(unpack6(raw[at : at + 6 * few]), times))
                ws.append(unpack6(raw[at + 6 * few :]))
            u, w, n = np.concatenate(us), np.concatenate(ws), np.concatenate(ns)
            key = pair_key(u, w)
            order = np.argsort(key, kind="stable")
            key = key[order]
            at = np.flatnonzero(np.concatenate((np.ones(1, dtype=bool), key[1:] != key[:-1])))
            key, n = key[at], np.add.reduceat(n[order], at)
            u, w = u[order[at]], w[order[at]]
            big = np.flatnonzero(n >= _U64(0xFFFF))
            save(folder, f"pairs-{part}", k=key | np.minimum(n, _U64(0xFFFF)), bigk=key[big], bign=n[big])
            of = [int((n == _U64(k)).sum()) for k in (1, 2, 3, 4)]
            one = np.ones(len(n), dtype=np.uint32)
            heads = _summed(u, *[(n == _U64(k)).astype(np.uint32) for k in (1, 2)], (n >= _U64(3)).astype(np.uint32), n)
            tails = _summed(w, one)
            out = []
            for kind, (word, *values) in (("head", heads), ("tail", tails)):
                cuts = np.searchsorted(range_part(word, parts), np.arange(parts + 1))
                for p, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                    if hi > lo:
                        out.append((p, kind, pack6(word[lo:hi]) + b"".join(v[lo:hi].tobytes() for v in values)))
            yield pd.DataFrame(out, columns=["part", "kind", "blob"]).assign(counts=[of] + [None] * (len(out) - 1))

    return run


def _merge_vocabulary(folder: str, discounts: tuple[float, ...]):
    """Word shards: count, continuations, back-off weight and total of each word as a context."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, blobs in gathered(batches):
            heads, tails = [[], [], [], [], []], [[], []]
            for raw in blobs:
                kind, raw = raw[:4], raw[4:]
                width = 26 if kind == b"head" else 10
                n = len(raw) // width
                if kind == b"head":
                    heads[0].append(unpack6(raw[: 6 * n]))
                    for i in range(3):
                        heads[1 + i].append(np.frombuffer(raw, dtype=np.uint32, count=n, offset=6 * n + 4 * n * i).astype(np.float64))
                    heads[4].append(np.frombuffer(raw, dtype=np.uint64, count=n, offset=18 * n).astype(np.float64))
                else:
                    tails[0].append(unpack6(raw[: 6 * n]))
                    tails[1].append(np.frombuffer(raw, dtype=np.uint32, count=n, offset=6 * n).astype(np.float64))
            empty = [np.zeros(0, dtype=np.uint64), *[np.zeros(0)] * 4]
            word, n1, n2, n3, total = _summed(*[np.concatenate(x) for x in heads]) if heads[0] else empty
            tail, times = _summed(*[np.concatenate(x) for x in tails]) if tails[0] else empty[:2]
            h, c = np.array(mapped(folder, f"words-{part}", "h")), np.array(mapped(folder, f"words-{part}", "c")).astype(np.float64)
            if int(range_part(short(np.array([START])), _PARTS[folder])[0]) == part:
                at = int(np.searchsorted(h, START))
                h, c = np.insert(h, at, START), np.insert(c, at, 0.0)
            out = np.zeros((4, len(h)), dtype=np.float32)
            for row, keys, values in ((1, tail, [times]), (2, word, [n1 * discounts[0] + n2 * discounts[1] + n3 * discounts[2], total])):
                at = np.minimum(np.searchsorted(keys, short(h)), max(len(keys) - 1, 0))
                hit = keys[at] == short(h) if len(keys) else np.zeros(len(h), dtype=bool)
                for i, v in enumerate(values):
                    out[row + i, hit] = v[at[hit]]
            gamma = np.divide(out[2], out[3], out=np.ones(len(h), dtype=np.float32), where=out[3] > 0)
            wide = c.max(initial=0) >= 2**32
            save(folder, f"voc-{part}", h=h, c=c.astype(np.uint64 if wide else np.uint32), cont=out[1].astype(np.uint32), gamma=gamma, total=out[3])
            yield pd.DataFrame({"counts": [[int((times == k).sum()) for k in (1, 2, 3, 4)]], "over": [int((times >= 3).sum())], "pairs": [int(times.sum())]})

    return run


_PARTS: dict[str, int] = {}


def discounts_of(n: list[int]) -> tuple[float, float, float]:
    """Discounts for counts of one, two and three or more from counts of counts."""
    n1, n2, n3, n4 = (max(x, 1) for x in n)
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.1), k + 0.9) for k, d in enumerate(found))


@dataclass
class Model:
    folder: str
    parts: int
    hot: np.ndarray
    tokens: int
    distinct: int
    pair_discounts: tuple[float, ...]
    word_discounts: tuple[float, ...]
    word_rest: float  # mass that the continuation counts leave to words never seen
    pairs: int

    def words(self, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """c, continuations, back-off weight and total of sorted distinct word hashes."""
        out = [np.zeros(len(h)), np.zeros(len(h)), np.ones(len(h)), np.zeros(len(h))]
        cuts = np.searchsorted(range_part(short(h), self.parts), np.arange(self.parts + 1))
        for p, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            keys = mapped(self.folder, f"voc-{p}", "h") if hi > lo else ()
            if len(keys):
                at = np.minimum(np.searchsorted(keys, h[lo:hi]), len(keys) - 1)
                hit = keys[at] == h[lo:hi]
                for o, name in zip(out, ("c", "cont", "gamma", "total")):
                    o[lo:hi][hit] = mapped(self.folder, f"voc-{p}", name)[at[hit]]
        return tuple(out)

    def pair_counts(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Counts of bigrams given as 48-bit hashes."""
        key = pair_key(u, w)
        part = pair_part(u, w, self.parts, self.hot)
        order = np.lexsort((key, part))
        key, out = key[order], np.zeros(len(u))
        cuts = np.searchsorted(part[order], np.arange(self.parts + 1))
        for p, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            kept = mapped(self.folder, f"pairs-{p}", "k") if hi > lo else ()
            if not len(kept):
                continue
            at = np.minimum(np.searchsorted(kept, key[lo:hi]), len(kept) - 1)
            got = kept[at]
            n = np.where((got & ~_U64(0xFFFF)) == key[lo:hi], got & _U64(0xFFFF), _U64(0)).astype(np.float64)
            for i in np.flatnonzero(n == 0xFFFF):
                n[i] = mapped(self.folder, f"pairs-{p}", "bign")[np.searchsorted(mapped(self.folder, f"pairs-{p}", "bigk"), key[lo + i])]
            out[order[lo:hi]] = n
        return out

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base score and score of each text."""
        tokens, before, at = token_hashes(texts)
        vocabulary, where = np.unique(np.concatenate((tokens, before)), return_inverse=True)
        word, context = where[: len(tokens)], where[len(tokens) :]
        c, cont, gamma, total = self.words(vocabulary)
        unknown = 1.0 / (self.distinct + 1)
        if self.pairs:
            cut = np.choose(np.minimum(cont, 3).astype(np.int64), (0.0, *self.word_discounts))
            lower = (cont - cut) / self.pairs + self.word_rest * unknown
        else:
            lower = np.full(len(vocabulary), unknown)
        pair, back = np.unique(context * np.int64(len(vocabulary)) + word, return_inverse=True)
        u, w = pair // len(vocabulary), pair % len(vocabulary)
        n = self.pair_counts(short(vocabulary[u]), short(vocabulary[w]))
        cut = np.choose(np.minimum(n, 3).astype(np.int64), (0.0, *self.pair_discounts))
        chance = np.where(total[u] > 0, (n - cut) / np.maximum(total[u], 1), 0.0) + gamma[u] * lower[w]
        base = np.log10((c + 1) / (self.tokens + self.distinct + 1))
        first = at[:-1]
        return np.diff(at), np.add.reduceat((c[word] > 0).astype(np.int64), first), np.add.reduceat(base[word], first), np.add.reduceat(np.log10(chance)[back], first)


def fit(train: DataFrame, text_col: str = "text") -> Model:
    """The model of all rows of train.

    Words and bigrams are counted per task in runs of RUN_TOKENS tokens and meet by hash range,
    so that shuffles carry each run's distinct entries only; the bigrams of words that would
    fill a part are spread. Every part becomes sorted arrays in the shared folder, written under
    another name first, so that a task run again changes nothing. The driver gets a few numbers
    of each part, and at most HOT_SHARE hot words for each part.
    """
    spark = train.sparkSession
    folder = local_path(shared_folder(spark, "kneser-ney"))
    os.makedirs(folder, exist_ok=True)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    texts = train.select(train[text_col].alias("t"))

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "part").sortWithinPartitions("part")

    words = dealt(texts.mapInPandas(_count_words(parts), "part int, blob binary")).mapInPandas(_merge_words(folder, parts), "tokens long, distinct long, hot array<long>, counts array<long>")
    words = settled(words, "words")
    sums = words.agg(F.sum("tokens").alias("n"), F.sum("distinct").alias("v")).first()
    tokens, distinct = sums["n"] or 0, sums["v"] or 0
    if not tokens:
        return Model(folder, parts, np.zeros(0, dtype=np.uint64), 0, 0, (0.5, 0.5, 0.5), (0.5, 0.5, 0.5), 1.0, 0)
    heavy = words.select(F.explode(F.arrays_zip("hot", "counts")).alias("x")).filter(F.col("x.counts") * (HOT_SHARE * parts) >= tokens).select("x.hot").collect()
    hot = np.array([r["hot"] for r in heavy], dtype=np.int64).view(np.uint64)
    # the start of a text is a context of as many bigrams as there are texts
    hot = np.unique(np.concatenate((hot, short(np.array([START])))))
    pairs = dealt(texts.mapInPandas(_count_pairs(parts, hot), "part int, blob binary")).mapInPandas(_merge_pairs(folder, parts), "part int, kind string, blob binary, counts array<long>")
    pairs = settled(pairs, "pairs")
    of = pairs.filter("counts is not null").agg(*[F.sum(F.col("counts")[i]).alias(f"n{i}") for i in range(4)]).first()
    pair_discounts = discounts_of(list(of))
    vocabulary = dealt(pairs.select("part", F.concat(F.col("kind").cast("binary"), "blob").alias("blob"))).mapInPandas(_with_parts(folder, parts, _merge_vocabulary(folder, pair_discounts)), "counts array<long>, over long, pairs long")
    vocabulary = settled(vocabulary, "vocabulary")
    of = vocabulary.agg(*[F.sum(F.col("counts")[i]).alias(f"n{i}") for i in range(4)], F.sum("over").alias("over"), F.sum("pairs").alias("pairs")).first()
    word_discounts = discounts_of(list(of)[:4])
    rest = (word_discounts[0] * of["n0"] + word_discounts[1] * of["n1"] + word_discounts[2] * of["over"]) / of["pairs"]
    return Model(folder, parts, hot, tokens, distinct, pair_discounts, word_discounts, rest, of["pairs"])


def _with_parts(folder: str, parts: int, run):
    def inner(batches):
        _PARTS[folder] = parts
        yield from run(batches)

    return inner


def score_documents(docs: DataFrame, model: Model, carry: list[str], text_col: str = "text") -> DataFrame:
    """The columns `carry` of docs with n_tokens, n_known, train_tokens, base_score, score and
    perplexity (by token, of the score); no shuffle.

    Null and empty texts are scored as their end token alone. A model of nothing gives every
    token probability 1. Repeated rows are each scored; other columns are ignored; an empty table
    gives no rows.
    """
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = as_texts(b["__text"])
            got = [model.score(texts[part]) for part in chunks(texts, SCORED_BYTES)]
            if got:
                n, known, base, score = (np.concatenate(x) for x in zip(*got))
                yield b.drop(columns="__text").assign(n_tokens=n, n_known=known, train_tokens=model.tokens, base_score=base, score=score, perplexity=10 ** (-score / n))

    picked = docs.select(*carry, docs[text_col].alias("__text"))
    return picked.mapInPandas(run, f"{fields}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
