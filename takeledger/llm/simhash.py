"""SimHash near-duplicates by deletion variants: segments that differ in one bit at most meet.

A fingerprint of 64 bits is cut into so few segments that of two fingerprints within the distance
one segment differs by at most one bit. A segment is indexed as it is and once for each of its bits
with that bit as a wildcard; equal keys meet, and whole fingerprints are compared.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from takeledger.llm.common import HOT_KEYS, discard, settled, settled_at, shared_folder, with_value
from takeledger.llm.jaccard import components

#: Words of a shingle, the seed of its hash, and bits in which linked fingerprints may differ.
WORDS, SEED, DISTANCE = 4, 42, 4
BITS = 64
#: Bytes of a text that are taken into words at once.
PIECE = 1 << 20
#: Fingerprints of one segment value that a task compares as they come; more are dealt in blocks.
CROWD = 2048
#: Fingerprints of a block, on either side.
BLOCK = 8192
#: Rows of sorted keys that a task holds at once, beside the group it is in, and that it gets about.
HELD, ROWS = 100_000, 500_000

_SPACE = re.compile(rb"[ \t-\r]")


# ---- fingerprints -----------------------------------------------------------------------------

def hashes(text: bytes, words: int = WORDS) -> Iterator[np.ndarray]:
    """XXH64 of every `words` words in a row, repeats included, a piece of the text at a time.

    A text of fewer words, but at least one, has one shingle: all its words.
    """
    held, at, whole = [], 0, False
    while at < len(text):
        cut = _SPACE.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        held += text[at:end].lower().split()
        at = end + 1
        if len(held) >= words:
            whole = True
            ends = np.cumsum(np.fromiter(map(len, held), dtype=np.int64, count=len(held)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            line, digest = b" ".join(held), xxhash.xxh64_intdigest
            yield np.fromiter((digest(line[s:e], SEED) for s, e in zip(starts.tolist(), ends[words - 1 :].tolist())), dtype=np.uint64, count=len(held) - words + 1)
            held = held[len(held) - words + 1 :]
    if held and not whole:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], dtype=np.uint64)


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The bits that over half of the shingles' hashes have set; 0 for a text without words."""
    ones, n = np.zeros(BITS, dtype=np.int64), 0
    for h in hashes(text, words):
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]) if n else 0


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((fingerprint(t or b"", words) for t in b.column(1).to_pylist()), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["doc", "f"])

    return run


# ---- segments and keys ------------------------------------------------------------------------

def segments_for(distance: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of the fewest segments of which one has at most one of `distance` bits; two at least."""
    n = max(2, distance // 2 + 1)
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _segment(f: Column, low: int, bits: int) -> Column:
    return F.shiftrightunsigned(f, low).bitwiseAND(F.lit((1 << bits) - 1))


def _tagged(number: int, value: Column) -> Column:
    """A value of at most 48 bits with the number of what it is a value of."""
    return value.bitwiseOR(F.lit(number << 48))


def _values(fingerprints: DataFrame, segments: list[tuple[int, int]]) -> DataFrame:
    """(f, ..., s): a row for each segment value of a fingerprint, tagged with the segment."""
    return fingerprints.withColumn("s", F.explode(F.array(*[_tagged(i, _segment(F.col("f"), *seg)) for i, seg in enumerate(segments)])))


def _neighbours(segments: list[tuple[int, int]]) -> Column:
    """The tagged values that differ from `s` in one bit of its segment."""
    flips = F.lit(None).cast("array<long>")
    for i, (_, bits) in enumerate(segments):
        flips = F.when(F.shiftrightunsigned("s", 48) == i, F.array(*[F.col("s").bitwiseXOR(F.lit(1 << b)) for b in range(bits)])).otherwise(flips)
    return flips


def _variants(segments: list[tuple[int, int]]) -> Column:
    """Keys of `s`: (key, side): the segment as it is (side -1), and with each bit taken out (side: that bit)."""
    keys = F.lit(None).cast("array<struct<key:long,side:byte>>")
    for i, (_, bits) in enumerate(segments):
        own = i * (BITS + 1)
        value = F.col("s").bitwiseAND(F.lit((1 << 48) - 1))
        plain = F.struct(_tagged(own, value).alias("key"), F.lit(-1).cast("byte").alias("side"))
        wild = [F.struct(_tagged(own + 1 + b, value.bitwiseAND(F.lit(((1 << bits) - 1) ^ (1 << b)))).alias("key"), F.shiftrightunsigned(value, b).bitwiseAND(F.lit(1)).cast("byte").alias("side")) for b in range(bits)]
        keys = F.when(F.shiftrightunsigned("s", 48) == i, F.array(plain, *wild)).otherwise(keys)
    return keys


# ---- comparing --------------------------------------------------------------------------------

def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) as fewer ones that connect the same: each value with the least of its component."""
    names, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[left], root[right])
        now = root.copy()
        np.minimum.at(now, root[left], low)
        np.minimum.at(now, root[right], low)
        now = now[now]
        if (now == root).all():
            keep = root != np.arange(len(names))
            return names[keep], names[root[keep]]
        root = now


def links(key: np.ndarray, side: np.ndarray, f: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints of equal keys; rows are sorted by key and side.

    Rows of side -1 are compared with each other, of the other sides only 0 with 1: what agrees in
    the wildcard's bit agrees in the whole segment and meets there.
    """
    n = len(key)
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if n else np.zeros(0, dtype=np.int64)
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    end = np.append(starts[1:], n)[group] if n else starts
    ones = np.append(starts, n)[:-1] + np.bincount(group[side == 0], minlength=len(starts)) if n else starts
    # the next row to compare each row with
    next_ = np.where(side < 0, np.arange(n) + 1, ones[group]) if n else starts
    row = np.flatnonzero((side < 1) & (next_ < end))
    a, b, size = [], [], 0
    at = next_[row]
    while len(row):
        near = np.bitwise_count(f[row] ^ f[at]) <= distance
        if near.any():
            a.append(f[row[near]])
            b.append(f[at[near]])
            size += len(a[-1])
            if size > 4 * HELD:  # many links among few fingerprints
                x, y = forest(np.concatenate(a), np.concatenate(b))
                a, b, size = [x], [y], len(x)
        at = at + 1
        left = at < end[row]
        row, at = row[left], at[left]
    none = np.zeros(0, dtype=np.uint64)
    return forest(np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def _held(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of whole groups (equal in the first `keys` columns) of sorted rows, HELD rows or more."""
    kept: list[list[np.ndarray]] = []
    size = 0

    def joined() -> list[np.ndarray]:
        return [np.concatenate(c) for c in zip(*kept)]

    for b in batches:
        kept.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
        size += b.num_rows
        if size >= HELD:
            columns = joined()
            same = np.ones(size, dtype=bool)
            for c in columns[:keys]:
                same &= c == c[-1]
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield [c[:cut] for c in columns]
            kept, size = [[c[cut:] for c in columns]], size - cut
    if size:
        yield joined()


def _linked(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, side, f in _held(batches, 1):
            yield _edges(*links(key, side, f.view(np.uint64), distance))

    return run


def _crossed(distance: int):
    """Cells of a far block and a block of all: every far fingerprint against every one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, i, j, far, f in _held(batches, 3):
            cuts = np.flatnonzero((s[1:] != s[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for rows in np.split(np.arange(len(s)), cuts):
                one, all_ = (f[rows][far[rows] == x].view(np.uint64) for x in (True, False))
                a, b = [], []
                for at in range(0, len(one), 256):
                    x, y = np.nonzero(np.bitwise_count(one[at : at + 256, None] ^ all_[None, :]) <= distance)
                    a.append(one[at + x])
                    b.append(all_[y])
                a, b = np.concatenate(a or [f[:0].view(np.uint64)]), np.concatenate(b or [f[:0].view(np.uint64)])
                yield _edges(*forest(a[a != b], b[a != b]))

    return run


def _crowded(values: DataFrame, hot: DataFrame, few: bool, segments: list[tuple[int, int]], distance: int) -> DataFrame:
    """Links of fingerprints of a crowded segment value with each other and with its neighbours'.

    All are held against the value's leader, the fingerprint of most copies, in the plan itself;
    those within the distance are linked through it. Only the rest, the far ones, are held against
    all of the value, block against block, wherever these are far or near.
    """
    sent = F.broadcast if few else (lambda df: df)
    lead = values.join(sent(hot.select("s")), "s").groupBy("s").agg(F.max_by("f", F.struct("copies", "f")).alias("lead"))
    around = lead.select("lead", F.col("s").alias("hot"), F.explode(F.concat(F.array("s"), _neighbours(segments))).alias("s"))
    met = values.select("s", "f").join(sent(around), "s").select("hot", "lead", "f")
    near = F.bit_count(F.col("f").bitwiseXOR(F.col("lead"))) <= distance
    held = settled(met.withColumn("near", near), "crowded")
    sizes = held.groupBy("hot").agg(F.count("*").alias("n"), F.count_if(~F.col("near")).alias("far")).filter("far > 0")
    sizes = sizes.select("hot", F.ceil(F.col("n") / BLOCK).alias("blocks"), F.ceil(F.col("far") / BLOCK).alias("far_blocks"))
    placed = held.join(sent(sizes), "hot")
    of = lambda name: F.pmod(F.xxhash64("f"), F.col(name))
    every = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))
    lone = placed.filter("not near").select("hot", of("far_blocks").alias("i"), every("blocks").alias("j"), F.lit(True).alias("far"), "f")
    rest = placed.select("hot", of("blocks").alias("j"), every("far_blocks").alias("i"), F.lit(False).alias("far"), "f").select("hot", "i", "j", "far", "f")
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = lone.unionByName(rest).repartition(parts, "hot", "i", "j").sortWithinPartitions("hot", "i", "j")
    through = held.filter("near and f <> lead").select(F.col("f").alias("a"), F.col("lead").alias("b"))
    return through.unionByName(cells.mapInArrow(_crossed(distance), "a long, b long"))


def near_links(fingerprints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) that connect all fingerprints (f, copies; distinct) within the distance."""
    segments = segments_for(distance)
    values = _values(fingerprints, segments)
    sizes = values.groupBy("s").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD)
    hot = settled(sizes, "crowds")
    crowds = hot.count()
    few = crowds <= HOT_KEYS // (BITS // len(segments) + 1)
    plain = values.select("s", "f")
    if crowds:
        plain = plain.join(F.broadcast(hot.select("s")) if few else hot.select("s"), "s", "left_anti")
    keyed = plain.select(F.explode(_variants(segments)).alias("k"), "f").select("k.key", "k.side", "f")
    parts = max(int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions")), fingerprints.count() * (BITS + len(segments)) // ROWS)
    found = keyed.repartition(parts, "key").sortWithinPartitions("key", "side").mapInArrow(_linked(distance), "a long, b long")
    return found.unionByName(_crowded(values, hot, few, segments, distance)) if crowds else found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """(id, fingerprint, component_id) of every row of docs.

    A-Z are lower-cased, words stand between ASCII white space, shingles are `words` words. Rows
    are linked if their fingerprints differ in at most `distance` bits; component_id is the least
    id that links reach. Null, empty and wordless texts have fingerprint zero and are linked like
    others. Rows with a null id link others too, and have the component of what they reach (null
    if that is nothing but null ids). Repeated rows, ties and extra columns are taken as they are;
    an empty table gives no rows. Texts are read whole, in pieces.

    Equal fingerprints are collapsed first. No pair is emitted as a row: tasks emit trees.
    """
    texts = docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].cast("string").cast("binary").alias("t"))
    signed = settled(texts.mapInArrow(_fingerprints(words), "doc long, f long"), "fingerprints")
    distinct = settled(signed.groupBy("f").agg(F.min("doc").alias("least"), F.count("*").alias("copies")), "distinct")
    found_at = shared_folder(docs.sparkSession, "links")
    edges = settled_at(near_links(distinct.select("f", "copies"), distance), found_at)
    roots = settled(components(edges, "components"), "roots")
    discard(docs.sparkSession, found_at)
    of = distinct.join(roots.withColumnRenamed("node", "f"), "f", "left").select("f", "least", "copies", F.coalesce("root", "f").alias("root"))
    of = settled(of, "classes")
    least = of.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = with_value(of.select("f", "root", "copies"), least, "root", of.count()).select("f", "component_id", F.col("copies").alias("n"))
    rows = with_value(signed, named, "f", signed.count())
    return rows.select(F.col("doc").alias(id_col), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")
