"""n-gram Jaccard self-join by MinHash banding, with verified links and components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takeledger.llm.common import as_texts, chunks, discard, mixed, settled, settled_at, shared_folder, shingle_hashes, with_value, word_hashes

#: Words of a shingle, least similarity, and the chance to meet in a band at that similarity.
WORDS, SIMILARITY, RECALL = 5, 0.8, 0.9999
#: MinHash values in a band.
ROWS = 6
#: Texts of one block of a candidate cluster; larger clusters are verified block against block.
BLOCK = 768
#: Shingle columns of one matrix product.
COLUMNS = 8192


def bands_for(similarity: float, rows: int, recall: float) -> int:
    """The fewest bands of `rows` values in which a pair of that similarity meets with `recall`."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)))


def band_keys(shingles: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """bands MinHash band keys of each text (texts x bands); texts without shingles get zeros."""
    texts = len(first) - 1
    out = np.zeros((texts, bands), dtype=np.uint64)
    full = np.flatnonzero(np.diff(first) > 0)
    if not len(full):
        return out
    at = first[full]
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    rng = np.random.default_rng(99)
    factor = rng.integers(0, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shift = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)
    with np.errstate(over="ignore"):
        for b in range(bands):
            key = np.full(len(full), b + 1, dtype=np.uint64)
            for r in range(b * rows, (b + 1) * rows):
                least = np.minimum.reduceat((low ^ shift[r]) * factor[r], at)
                key = key * np.uint64(0x9E3779B97F4A7C15) + least
            out[full, b] = mixed(key)
    return out


def _signatures(n: int, bands: int, rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = as_texts(batch["t"])
            ids = batch["k"].to_numpy()
            for part in chunks(texts, 3_000_000):
                h, first = shingle_hashes(*word_hashes(texts[part]), n)
                owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
                order = np.lexsort((h, owner))
                h, owner = h[order], owner[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                h, owner = h[new], owner[new]
                first = np.searchsorted(owner, np.arange(len(first)))
                keys = band_keys(h, first, bands, rows).view(np.int64)
                size = np.diff(first)
                with np.errstate(over="ignore"):
                    sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(x))) for x in (mixed(h), mixed(h ^ np.uint64(0x5DEECE66D)))]
                one, two = ((s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums)
                yield pd.DataFrame({"doc": ids[part], "key1": one, "key2": two, "size": size, "bands": list(keys)})

    return run


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root): the least node that each node of the edges (a, b) is connected with.

    Alternates large stars and small stars; every round is written to the shared folder, and
    the rounds end when the edges no longer change. Needs about log(n) rounds. A node with very
    many edges is no single task's: minima are combined before the shuffle, and with_value brings
    the node's minimum to its edges.
    """

    def measured(df: DataFrame) -> tuple:
        return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20)")).alias("s")).first()

    spark = edges.sparkSession
    path = shared_folder(spark, name)
    now = settled_at(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), path)
    mark = measured(now)
    while mark["n"]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        larger = F.count_if(F.col("v") > F.col("u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), larger.alias("n")).filter("n > 0")
        large = with_value(both.filter("v > u"), least, "u", mark["n"]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        star = shared_folder(spark, name)
        large = settled_at(large, star)
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = with_value(large, low, "u", mark["n"])
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        before, path = path, shared_folder(spark, name)
        now = settled_at(small, path)
        discard(spark, before)
        discard(spark, star)
        got = measured(now)
        if got == mark:
            break
        mark = got
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(now.select("v", "v").distinct())


def _verify_group(ids: np.ndarray, sets: list[np.ndarray], copies: np.ndarray, side: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (in copies) of each text and the least text it is linked with, in one block pair.

    side: the block of each text; where there are two blocks only pairs across them count.
    """
    m = len(ids)
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=m)
    flat = np.concatenate(sets)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), sizes)
    shared = times[column] > 1
    row, column = row[shared], column[shared]
    used, column = np.unique(column, return_inverse=True)
    inter = np.zeros((m, m), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, len(used), COLUMNS):
        lo, hi = np.searchsorted(column, (at, at + COLUMNS))
        x = np.zeros((m, min(COLUMNS, len(used) - at)), dtype=np.float32)
        x[row[lo:hi], column[lo:hi] - at] = 1
        inter += x @ x.T
    union = sizes[:, None] + sizes[None, :] - inter
    linked = inter >= similarity * union - 1e-4
    np.fill_diagonal(linked, False)
    if (side != side[0]).any():
        linked &= side[:, None] != side[None, :]
    links = linked @ copies
    root = np.arange(m)
    while True:  # least index reachable: pull the least over neighbours, then jump
        pulled = np.minimum(np.where(linked, root[None, :], m).min(axis=1), root)
        pulled = pulled[pulled]
        if (pulled == root).all():
            return links, ids[root]
        root = pulled


def _verified(n: int, similarity: float):
    """Rows sorted by (cluster, left, right) to links and roots, a group at a time."""

    def flush(group: dict) -> pd.DataFrame:
        order = np.argsort(np.array(group["doc"]), kind="stable")
        ids = np.array(group["doc"])[order]
        first = np.concatenate(([True], ids[1:] != ids[:-1]))
        order, ids = order[first], ids[first]
        links, roots = _verify_group(ids, [group["set"][i] for i in order], np.array(group["copies"])[order], np.array(group["block"])[order], similarity)
        return pd.DataFrame({"doc": ids, "links": links.astype(np.int64), "root": roots})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, key = {"doc": [], "set": [], "copies": [], "block": []}, None
        ready, rows = [], 0
        for b in batches:
            for c, left, right, doc, copies, block, raw in zip(b["cluster"], b["left"], b["right"], b["doc"], b["copies"], b["block"], b["shingles"]):
                if (c, left, right) != key:
                    if len(held["doc"]) > 1:
                        ready.append(flush(held))
                        rows += len(ready[-1])
                    held, key = {"doc": [], "set": [], "copies": [], "block": []}, (c, left, right)
                    if rows > 5000:
                        yield pd.concat(ready)
                        ready, rows = [], 0
                held["doc"].append(doc)
                held["set"].append(np.frombuffer(raw, dtype=np.uint64))
                held["copies"].append(copies)
                held["block"].append(block)
        if len(held["doc"]) > 1:
            ready.append(flush(held))
        if ready:
            yield pd.concat(ready)

    return run


def _shingle_sets(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, out = as_texts(b["t"]), []
            for part in chunks(texts):
                h, first = shingle_hashes(*word_hashes(texts[part]), n)
                out += [np.unique(h[first[i] : first[i + 1]]).tobytes() for i in range(len(first) - 1)]
            yield b.drop(columns="t").assign(shingles=out)

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """(id, class_id, n_copies, n_links) of every row of docs.

    Texts are sets of `words`-word shingles (lower case; a text of fewer words is one shingle).
    Two rows are linked if their sets' Jaccard similarity is at least `similarity`; class_id is the
    least id that a row is connected with by links, n_copies the rows with the same set and
    n_links the other rows it is linked with, copies included. Pairs below an infinitesimal
    1 - recall of those at the very threshold are found: bands are chosen for that, and every pair
    inside a cluster of texts that share bands is verified on the full sets.

    Texts without a word (null, empty) are linked with nothing and have their own id as class.
    Rows that repeat an id have one class; a null id has null class and counts. Extra columns are
    ignored; an empty table gives no rows. Copies are collapsed before the join, hot clusters are
    verified in blocks of BLOCK texts, and no pair is emitted as a row.
    """
    bands = bands_for(similarity, rows, recall)
    texts = docs.select(docs[id_col].cast("long").alias("k"), docs[text_col].alias("t"))
    schema = "doc long, key1 long, key2 long, size long, bands array<long>"
    signed = settled(texts.filter("k is not null").mapInPandas(_signatures(words, bands, rows), schema), "signed")
    sets = signed.filter("size > 0").groupBy("key1", "key2", "size").agg(F.min("doc").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    sets = settled(sets, "sets")
    spread = sets.select("rep", F.explode("bands").alias("band"))
    met = spread.groupBy("band").agg(F.min("rep").alias("lead"), F.count("*").alias("n")).filter("n > 1")
    edges = with_value(spread, met, "band", sets.count() * bands).filter("rep <> lead").select(F.col("rep").alias("a"), F.col("lead").alias("b")).distinct()
    clusters = components(edges, "clusters")
    clusters = settled(clusters, "members")
    sizes = clusters.groupBy("root").agg(F.count("*").alias("members"), F.count("*").alias("n"))
    placed = with_value(clusters, sizes, "root", clusters.count()).withColumn("blocks", F.ceil(F.col("members") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    placed = placed.join(sets.select(F.col("rep").alias("node"), "copies"), "node").select(F.col("node").alias("k"), F.col("root").alias("cluster"), "blocks", "block", "copies")
    held = placed.join(texts, "k").select(F.col("k").alias("doc"), "cluster", "blocks", "block", "copies", "t")
    held = held.mapInPandas(_shingle_sets(words), "doc long, cluster long, blocks long, block long, copies long, shingles binary")
    paired = held.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "cluster", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "doc", "copies", "block", "shingles"
    )
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    paired = paired.repartition(parts, "cluster", "left", "right").sortWithinPartitions("cluster", "left", "right")
    found = settled(paired.mapInPandas(_verified(words, similarity), "doc long, links long, root long"), "verified")
    classes = components(found.select(F.col("doc").alias("a"), F.col("root").alias("b")), "classes")
    links = found.groupBy("doc").agg(F.sum("links").alias("links"))
    reps = (
        sets.select("key1", "key2", "size", "rep", "copies")
        .join(links.withColumnRenamed("doc", "rep"), "rep", "left")
        .join(classes.withColumnRenamed("node", "rep"), "rep", "left")
        .select("key1", "key2", "size", F.coalesce("root", "rep").alias("class_id"), F.col("copies").alias("n_copies"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    whole = signed.filter("size > 0").join(reps, ["key1", "key2", "size"]).select("doc", "class_id", "n_copies", "n_links")
    bare = signed.filter("size = 0").select("doc", F.col("doc").alias("class_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    none = texts.filter("k is null").select(F.col("k").alias("doc"), *[F.lit(None).cast("long").alias(c) for c in ("class_id", "n_copies", "n_links")])
    return whole.union(bare).union(none).withColumnRenamed("doc", id_col)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that stand for their class: one of each; null ids stay."""
    classes = near_duplicates(docs, id_col, text_col)
    kept = classes.filter(F.col(id_col) == F.col("class_id")).select(F.col(id_col).alias("__kept")).distinct()
    stays = docs.join(kept, docs[id_col] == F.col("__kept"), "left_semi").dropDuplicates([id_col])
    return stays.union(docs.filter(docs[id_col].isNull()))
