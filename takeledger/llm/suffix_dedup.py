"""Removal of repeated 50-byte strings by a distributed merge sort of sampled suffixes."""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takeledger.llm.common import BYTE_CODE, as_texts, chunks, joined_bytes, local_path, mixed, settled, shared_folder
from takeledger.llm.shards import blob_rows, gathered, mapped, pack6, range_part, save, short, unpack6

#: Bytes of a repeated string, of the grams that choose suffixes, and grams of such a string.
LENGTH, GRAM = 50, 26
GRAMS = LENGTH - GRAM + 1
#: A sampled suffix as it is sorted: LENGTH bytes from its start, the GRAMS - 1 before it read
#: backwards, how many of either the document has, and padding.
BACK = GRAMS - 1
WIDTH = 80
#: Parts for each shuffle partition, and bytes of text for each part at most: what a task merges
#: at once is that much smaller, whatever the size of the input.
FINER, PART_BYTES = 3, 12_000_000
#: Suffixes of one sorted run, and grams of one run of the filter.
RUN_SUFFIXES, RUN_GRAMS = 250_000, 4_000_000

_U64 = np.uint64
_FAR = np.iinfo(np.int64).max


# ---- sampled suffixes -----------------------------------------------------------------------

def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all `size`-byte grams, doubling their length and joining by its binary digits."""
    base = _U64(0x9E3779B97F4A7C15)
    power, have, need = BYTE_CODE[data], 1, size
    factor, out, done = base, None, 0
    with np.errstate(over="ignore"):
        while need:
            if need & 1:
                if out is None:
                    out, done = power, have
                else:
                    n = len(data) - done - have + 1
                    out = out[:n] * factor + power[done : done + n] if n > 0 else out[:0]
                    done += have
            need >>= 1
            if need:
                n = max(0, len(power) - have)
                power = power[:n] * factor + power[have : have + n]
                have, factor = have * 2, factor * factor
    return mixed(out)


def _sliding(x: np.ndarray, width: int, of) -> np.ndarray:
    """of (minimum or maximum) over every `width` neighbours."""
    have, out = 1, x
    while have * 2 <= width:
        out = of(out[:-have], out[have:])
        have *= 2
    return of(out[: len(x) - width + 1], out[width - have :]) if have < width else out


def anchors(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are least of any GRAMS neighbours, ties all.

    Any LENGTH bytes of a document hold one, and it depends on these bytes alone. Every document
    is followed by a gap; grams that reach into one are left out.
    """
    if len(data) < LENGTH:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    h = gram_hashes(data, GRAM)
    least = _sliding(h, GRAMS, np.minimum)
    # a gram is chosen if the largest of the minima over the windows around it is its own hash
    edge = np.zeros(GRAMS - 1, dtype=np.uint64)
    most = _sliding(np.concatenate((edge, least, edge)), GRAMS, np.maximum)
    at = np.flatnonzero(most == h)
    end = starts[np.searchsorted(starts, at, "right")] - 1
    at = at[at + GRAM <= end]
    # minima crowd at the low end; hashed once more they spread evenly over the parts
    return at, mixed(h[at])


def contexts(data: np.ndarray, starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of WIDTH bytes that stand for the suffixes at `at`, and both lengths."""
    doc = np.searchsorted(starts, at, "right") - 1
    ahead = np.minimum(starts[doc + 1] - 1 - at, LENGTH)
    behind = np.minimum(at - starts[doc], BACK)
    out = np.zeros((len(at), WIDTH), dtype=np.uint8)
    for c in range(LENGTH):
        ok = ahead > c
        out[ok, c] = data[at[ok] + c]
    for c in range(BACK):
        ok = behind > c
        out[ok, LENGTH + c] = data[at[ok] - 1 - c]
    out[:, LENGTH + BACK], out[:, LENGTH + BACK + 1] = ahead, behind
    return out, ahead, behind


def row_hashes(rows: np.ndarray) -> np.ndarray:
    return _folded(rows, 0xA0761D6478BD642F)


def row_checks(rows: np.ndarray) -> np.ndarray:
    """A second hash, independent of the first: of n rows any two agree in both, and so could be
    taken for one, with odds below n**2 / 2**128 (for 10**13 rows, a petabyte, 3e-13)."""
    return _folded(rows, 0xE7037ED1A0B428DB)


def _folded(rows: np.ndarray, factor: int) -> np.ndarray:
    words = np.ascontiguousarray(rows).view(np.uint64)
    h = np.full(len(rows), factor, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for c in range(words.shape[1]):
            h = mixed(h + words[:, c] * _U64(factor))
    return h


# ---- front-coded runs and their merging -----------------------------------------------------

def front_coded(rows: np.ndarray, docs: np.ndarray, many: np.ndarray) -> bytes:
    """A sorted run: of each row only what follows its common prefix with the row before."""
    common = np.zeros(len(rows), dtype=np.uint8)
    differ = rows[1:] != rows[:-1]
    common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), WIDTH)
    rest = rows[np.arange(WIDTH)[None, :] >= common[:, None]]
    return zstandard.ZstdCompressor(level=1).compress(np.int64(len(rows)).tobytes() + common.tobytes() + many.astype(np.uint8).tobytes() + docs.astype(np.int64).tobytes() + rest.tobytes())


def unfolded(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, common prefixes, least ids, and whether several documents hold the row."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw[:8], dtype=np.int64)[0])
    common = np.frombuffer(raw, dtype=np.uint8, count=n, offset=8)
    many = np.frombuffer(raw, dtype=np.uint8, count=n, offset=8 + n)
    docs = np.frombuffer(raw[8 + 2 * n : 8 + 10 * n], dtype=np.int64)
    rest = np.frombuffer(raw, dtype=np.uint8, offset=8 + 10 * n)
    rows = np.zeros((n, WIDTH), dtype=np.uint8)
    rows[np.arange(WIDTH)[None, :] >= common[:, None]] = rest
    order = np.arange(n)
    for c in range(WIDTH):
        rows[:, c] = rows[np.maximum.accumulate(np.where(common <= c, order, 0)), c]
    return rows, common, docs, many


def _prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of rows that share `known` bytes; only later ones are read."""
    while known < WIDTH:
        x, y = a[known : known + 8], b[known : known + 8]
        if x != y:
            return known + len(x) - ((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7) // 8
        known += 8
    return WIDTH


def merged(runs: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Run, place in the run and common prefix with the row before, for all rows in order.

    Each run is its rows in one piece and their common prefixes. A loser tree stands over the
    heads of the runs. Every head carries its common prefix with the row put out last: the longer
    one is the smaller row, and only heads with equal prefixes are compared, from there on. The
    loser keeps its prefix with the winner.
    """
    k = 1
    while k < len(runs):
        k *= 2
    runs = [*runs, *[(b"", b"")] * (k - len(runs))]
    rows, commons = [r[0] for r in runs], [r[1] for r in runs]
    size, place = [len(c) for c in commons], [0] * k
    head: list[bytes | None] = [r[:WIDTH] if r else None for r in rows]
    known = [0] * k  # of each run's head, with the last row put out by the winner of its match
    loser = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser among two heads; the loser's prefix becomes that with the winner."""
        x, y = head[a], head[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        n = _prefix(x, y, known[a])
        if n == WIDTH or x[n] < y[n]:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    level, node = list(range(k)), k
    while len(level) > 1:
        node //= 2
        up = []
        for i in range(0, len(level), 2):
            w, lost = play(level[i], level[i + 1])
            loser[node + i // 2] = lost
            up.append(w)
        level = up
    top = level[0]
    out_run, out_place, out_common = array("i"), array("i"), array("B")
    while head[top] is not None:
        out_run.append(top)
        at = place[top]
        out_place.append(at)
        out_common.append(known[top])
        at += 1
        place[top] = at
        if at < size[top]:
            head[top], known[top] = rows[top][at * WIDTH : at * WIDTH + WIDTH], commons[top][at]
        else:
            head[top] = None
        cur, node = top, (top + k) // 2
        x, p = head[cur], known[cur]
        while node:
            other = loser[node]
            y = head[other]
            if y is not None:
                q = known[other]
                if x is None or q > p:
                    loser[node], known[cur], cur, x, p = cur, p, other, y, q
                elif p == q:
                    n = _prefix(x, y, p)
                    if n == WIDTH or x[n] < y[n]:
                        known[other] = n
                    else:
                        loser[node], known[cur], cur, x, p = cur, n, other, y, q
            node //= 2
        known[cur] = p
        top = cur
    return np.array(out_run, dtype=np.int64), np.array(out_place, dtype=np.int64), np.array(out_common, dtype=np.int64)


def first_documents(rows: np.ndarray, common: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For sorted distinct rows: the least id of any document with each of their strings.

    Column j is the string that begins j bytes before the suffix. The strings of two rows are
    equal if their common prefix is LENGTH - j or more and their j bytes before are equal; common
    prefixes of neighbours tell the first, for they bound a range of the sorted order.
    """
    n = len(rows)
    ahead, behind = rows[:, LENGTH + BACK].astype(np.int64), rows[:, LENGTH + BACK + 1].astype(np.int64)
    out = np.full((n, GRAMS), _FAR, dtype=np.int64)
    left = np.zeros(n, dtype=np.int64)  # number of each row's j bytes before the suffix among all rows'
    for j in range(GRAMS):
        if j:
            left = np.unique(left * 256 + rows[:, LENGTH + j - 1], return_inverse=True)[1]
        ok = np.flatnonzero((ahead >= LENGTH - j) & (behind >= j))
        if not len(ok):
            continue
        block = np.cumsum(common < LENGTH - j)
        key = block[ok] * n + left[ok]
        order = np.argsort(key, kind="stable")
        key = key[order]
        at = np.flatnonzero(np.concatenate((np.ones(1, dtype=bool), key[1:] != key[:-1])))
        least = np.minimum.reduceat(docs[ok][order], at)
        back = np.empty(len(ok), dtype=np.int64)
        back[order] = np.repeat(least, np.diff(np.append(at, len(ok))))
        out[ok, j] = back
    return out


# ---- the three passes -----------------------------------------------------------------------

def _texts(batches: Iterator[pd.DataFrame]):
    """(ids, data, starts) of slices of the batches' texts, each text followed by a byte."""
    for b in batches:
        texts, ids = as_texts(b["t"]), b["k"].to_numpy()
        for part in chunks(texts, 3_000_000):
            yield ids[part], *joined_bytes(texts[part])


def _gram_runs(parts: int):
    """Distinct gram hashes of a run, and whether several of its documents hold them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def flush() -> pd.DataFrame:
            h, d = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            new = np.concatenate((np.ones(1, dtype=bool), h[1:] != h[:-1]))
            at = np.flatnonzero(new)
            last = np.append(at[1:], len(h)) - 1
            many, h = d[at] != d[last], h[at]
            cuts = np.searchsorted(range_part(h, parts), np.arange(parts + 1))
            return blob_rows([(p, pack6(h[lo:hi]) + np.packbits(many[lo:hi]).tobytes()) for p, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if hi > lo])

        for ids, data, starts in _texts(batches):
            at, h = anchors(data, starts)
            if len(at):
                held.append((short(h), ids[np.searchsorted(starts, at, "right") - 1]))
                size += len(at)
            if size >= RUN_GRAMS:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return run


def _shared_grams(folder: str):
    """Keeps the hashes that several documents hold, as a sorted shard."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, blobs in gathered(batches):
            keys, many = [], []
            for raw in blobs:
                n = len(raw) * 8 // 49
                keys.append(unpack6(raw[: 6 * n]))
                many.append(np.unpackbits(np.frombuffer(raw, dtype=np.uint8, offset=6 * n), count=n).astype(bool))
            h, m = np.concatenate(keys), np.concatenate(many)
            order = np.argsort(h, kind="stable")
            h, m = h[order], m[order]
            twice = np.zeros(len(h), dtype=bool)
            twice[1:] = h[1:] == h[:-1]
            twice[:-1] |= twice[1:]
            h = np.unique(h[twice | m])
            save(folder, f"grams-{part}", h=h)
            yield pd.DataFrame({"n": [len(h)]})

    return run


def _candidates(folder: str, parts: int, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and parts of the sampled suffixes whose gram several documents hold."""
    at, h = anchors(data, starts)
    h = short(h)
    order = np.argsort(h, kind="stable")
    needles = h[order]
    part = range_part(needles, parts)
    keep = np.zeros(len(at), dtype=bool)
    cuts = np.searchsorted(part, np.arange(parts + 1))
    for p, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        kept = mapped(folder, f"grams-{p}", "h") if hi > lo else ()
        if len(kept):
            found = np.minimum(np.searchsorted(kept, needles[lo:hi]), len(kept) - 1)
            keep[order[lo:hi]] = kept[found] == needles[lo:hi]
    at, h = at[keep], h[keep]
    return at, range_part(h, parts)


def _suffix_runs(folder: str, parts: int):
    """Front-coded sorted runs of distinct suffixes by part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def flush() -> pd.DataFrame:
            rows, docs, part = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(rows.view(f"S{WIDTH}").ravel(), kind="stable")
            order = order[np.argsort(part[order], kind="stable")]
            rows, docs, part = rows[order], docs[order], part[order]
            new = np.concatenate((np.ones(1, dtype=bool), (rows[1:] != rows[:-1]).any(axis=1) | (part[1:] != part[:-1])))
            at = np.flatnonzero(new)
            low, high = np.minimum.reduceat(docs, at), np.maximum.reduceat(docs, at)
            rows, part = rows[at], part[at]
            cuts = np.searchsorted(part, np.arange(parts + 1))
            return blob_rows([(p, front_coded(rows[lo:hi], low[lo:hi], low[lo:hi] != high[lo:hi])) for p, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if hi > lo])

        for ids, data, starts in _texts(batches):
            at, part = _candidates(folder, parts, data, starts)
            if len(at):
                held.append((contexts(data, starts, at)[0], ids[np.searchsorted(starts, at, "right") - 1], part))
                size += len(at)
            if size >= RUN_SUFFIXES:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return run


def _merged_parts(folder: str):
    """Merges a part's runs, and saves for each suffix who had its strings first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, blobs in gathered(batches):
            runs = [unfolded(b) for b in blobs]
            blobs.clear()
            which, place, common = merged([(rows.tobytes(), shared.tobytes()) for rows, shared, _, _ in runs])
            offset = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum([len(r[0]) for r in runs])))
            index = offset[which] + place
            docs, many = np.concatenate([r[2] for r in runs])[index], np.concatenate([r[3] for r in runs])[index].astype(bool)
            # equal rows of several runs are one
            new = common < WIDTH
            new[0] = True
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(common)))
            common = common[at]
            docs, many = np.minimum.reduceat(docs, at), np.logical_or.reduceat(many, at) | (times > 1)
            # a suffix that shares no gram with its neighbours and has one document repeats nothing;
            # without it the prefixes of the others still tell whether they share a gram
            near = common >= GRAM
            near[0] = False
            beside = near.copy()
            beside[:-1] |= near[1:]
            keep = np.flatnonzero(many | beside)
            common, docs = common[keep], docs[keep]
            rows = np.concatenate([r[0] for r in runs])[index[at[keep]]]
            del runs, index, which, place
            first = first_documents(rows, common, docs)
            h = row_hashes(rows)
            order = np.argsort(h, kind="stable")
            h, first = h[order], first[order]
            valid = first != _FAR
            low = np.where(valid, first, _FAR).min(axis=1, initial=_FAR)
            uneven = (valid & (first != low[:, None])).any(axis=1)
            odd = np.full(len(h), -1, dtype=np.int32)
            odd[uneven] = np.arange(int(uneven.sum()))
            save(folder, f"first-{part}", h=h, check=row_checks(rows)[order], low=low, odd=odd, each=first[uneven])
            yield pd.DataFrame({"n": [len(h)]})

    return run


def _removed(folder: str, parts: int, ids: np.ndarray, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which bytes go, as a boolean array."""
    at, part = _candidates(folder, parts, data, starts)
    change = np.zeros(len(data) + 1, dtype=np.int32)
    rows, ahead, behind = contexts(data, starts, at)
    h = row_hashes(rows)
    own = ids[np.searchsorted(starts, at, "right") - 1]
    order = np.lexsort((h, part))
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for p, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        keys = mapped(folder, f"first-{p}", "h") if hi > lo else ()
        if not len(keys):
            continue
        me = order[lo:hi]
        found = np.searchsorted(keys, h[me])
        checks, own_checks, todo = mapped(folder, f"first-{p}", "check"), row_checks(rows[me]), np.arange(len(me))
        hit = np.zeros(len(me), dtype=bool)
        while len(todo):  # the hash finds the place, the second one decides; equal hashes stand side by side
            todo = todo[found[todo] < len(keys)]
            todo = todo[keys[found[todo]] == h[me[todo]]]
            same = checks[found[todo]] == own_checks[todo]
            hit[todo[same]] = True
            todo = todo[~same]
            found[todo] += 1
        me, found = me[hit], found[hit]
        odd = mapped(folder, f"first-{p}", "odd")[found]
        early = (mapped(folder, f"first-{p}", "low")[found] < own[me]) & (ahead[me] + behind[me] >= LENGTH)
        all_of = me[early & (odd < 0)]
        np.add.at(change, at[all_of] - behind[all_of], 1)
        np.add.at(change, at[all_of] + ahead[all_of], -1)
        some = early & (odd >= 0)
        if some.any():
            each = mapped(folder, f"first-{p}", "each")[odd[some]] < own[me[some]][:, None]
            i, j = np.nonzero(each)
            begin = at[me[some]][i] - j
            np.add.at(change, begin, 1)
            np.add.at(change, begin + LENGTH, -1)
    return np.cumsum(change[:-1]) > 0


def _cleaned(folder: str, parts: int, with_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, data, starts in _texts(batches):
            gone = _removed(folder, parts, ids, data, starts)
            out = []
            for lo, hi in zip(starts, starts[1:] - 1):
                g, raw = gone[lo:hi], data[lo:hi]
                n = int(g.sum())
                kept = raw[~g].tobytes() if n else raw.tobytes()
                spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if n else 0
                out.append((hi - lo, n, spans, hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]
            frame = pd.DataFrame(out, columns=names)
            frame.insert(0, "doc", ids)
            yield frame

    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]) of every row of docs.

    A byte goes if some LENGTH-byte string around it also starts in a document with a smaller id;
    strings lie within one text as UTF-8. Suffixes are sampled so that every such string holds a
    sampled one that depends on the string alone; a first exchange of gram hashes leaves those
    that several documents share. Their runs are sorted, equal ones collapsed, front-coded and
    dealt by gram; loser trees merge them, and the common prefixes tell which strings are equal.
    The answers become sorted shards in the shared folder, which the last pass over the texts
    memory-maps: texts are never shuffled, and a text copied often is exchanged once a run.

    Null and empty texts have 0 bytes. Rows that repeat an id never take bytes from each other. A
    row with a null id keeps all its bytes and takes none. Extra columns are ignored; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    folder = local_path(shared_folder(spark, "suffixes"))
    os.makedirs(folder, exist_ok=True)
    rows = docs.select(docs[id_col].cast("long").alias("k"), docs[text_col].alias("t"))
    named = rows.filter("k is not null")
    size = named.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (PART_BYTES * FINER), 1)
    parts = tasks * FINER

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(tasks, "part").sortWithinPartitions("part")

    settled(dealt(named.mapInPandas(_gram_runs(parts), "part int, blob binary")).mapInPandas(_shared_grams(folder), "n long"), "grams")
    settled(dealt(named.mapInPandas(_suffix_runs(folder, parts), "part int, blob binary")).mapInPandas(_merged_parts(folder), "n long"), "firsts")
    fields = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    out = named.mapInPandas(_cleaned(folder, parts, with_text), fields)
    raw = F.coalesce(F.col("t"), F.lit("")).cast("binary")
    zero = F.lit(0).cast("long")
    bare = rows.filter("k is null").select("k", F.octet_length(raw).cast("long"), zero, zero, F.sha2(raw, 256), *([raw] if with_text else []))
    return out.union(bare).withColumnRenamed("doc", id_col)
