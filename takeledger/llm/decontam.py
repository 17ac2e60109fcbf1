"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Token positions that each mask looks at. Every window of WINDOW tokens with at most two
#: substitutions holds a placement of one of them that no substitution touches.
MASKS = ((0, 1, 2, 4, 7, 8), (0, 1, 4, 5, 6, 8), (0, 2, 3, 4, 5, 8))
SPAN = 9
#: Tokens of the window that has to agree, and how much of it.
WINDOW, AGREEMENT = 12, 0.8
#: Shorter test items match nothing: a few words alone are no evidence.
SHORTEST = 5
#: Seeds that are broadcast at most (about 100 bytes each); beyond, seeds are joined by shuffle.
BROADCAST_SEEDS = 400_000

#: The positions that all masks look at: one probe with their hash rules most windows out.
COMMON = tuple(sorted(set(MASKS[0]).intersection(*MASKS)))


#: The most masks of a length below WINDOW.
PER_LENGTH = 6


def short_masks(n: int) -> list[tuple[int, ...]]:
    """Masks of a whole item of n words: with d substitutions allowed, d of d + 2 blocks left out.

    Whatever blocks the substitutions fall into, one mask looks only at the others.
    """
    d = n - math.ceil(n * AGREEMENT)
    return [tuple(i for i in range(n) if i * (d + 2) // n in kept) for kept in combinations(range(d + 2), 2)]


def _with_words(df: DataFrame, text: str, words: str) -> DataFrame:
    """df with the lower-case words (letters and digits) of its column `text`; null is empty.

    Only the first and the last piece of the split can be empty; they are cut off by slicing,
    for a higher-order filter would run outside the generated code. The split stands in a
    projection of its own, so that it is done once.
    """
    df = df.withColumn(words, F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^\\p{L}\\p{N}]+")).drop(text)
    pieces = F.col(words)
    n = F.size(pieces)
    front = F.when(F.get(pieces, F.lit(0)) == "", 1).otherwise(0)
    back = F.when((n > 1) & (F.get(pieces, n - 1) == ""), 1).otherwise(0)
    return df.withColumn(words, F.slice(pieces, front + 1, F.greatest(n - front - back, F.lit(0))))


def _token(words: Column, at: Column) -> Column:
    return F.xxhash64(F.get(words, at))


def seed(words: Column, at: Column, mask: tuple[int, ...], number: int, length: int) -> Column:
    """The hash of the masked words of the window of `length` at `at`; null beyond the end."""
    picked = [_token(words, at + F.lit(p)) for p in mask]
    return F.when(at + F.lit(length - 1) < F.size(words), F.xxhash64(F.lit(number), *picked))


def _seeded(df: DataFrame, masks: dict[int, tuple[int, ...]], at: str, words: str) -> DataFrame:
    keys = [F.struct(seed(F.col(words), F.col(at), m, i, m[-1] + 1).alias("key"), F.lit(i).alias("mask")) for i, m in masks.items()]
    return df.withColumn("s", F.explode(F.array(*keys))).filter("s.key is not null").withColumn("key", F.col("s.key")).withColumn("mask", F.col("s.mask")).drop("s")


def _agreement(doc: Column, item: Column, at: Column, iat: Column, window: Column, span: Column, skip: Column) -> Column:
    """The most equal tokens of any aligned window around the hit (doc `at` = item `iat`), and the
    least place of such a window, in one number: equal << 32 | (2**31 - place).

    Written out window by window, token by token: higher-order functions would end the generated
    code of the join, and copy the text's tokens for every position.
    """
    best = F.lit(0).cast("long")
    for k in range(WINDOW - min(SPAN, WINDOW) + 1):
        start = iat + span - window + F.lit(k)
        begin = start + at - iat
        fits = (F.lit(k) <= window - span) & (start >= 0) & (begin >= 0) & (start + window <= F.size(item)) & (begin + window <= F.size(doc))
        equal = F.lit(0)
        for t in range(WINDOW):
            equal = equal + F.when((F.lit(t) < window) & (F.get(item, start + F.lit(t)) == _token(doc, begin + F.lit(t))), 1).otherwise(0)
        best = F.greatest(best, F.when(fits, F.shiftleft(equal.cast("long"), 32) + (F.lit(1 << 31) - begin - skip)).otherwise(0))
    return best


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, n_matched, n_window, n_item, first_token): texts that repeat a test item.

    A pair is reported if some WINDOW tokens in a row of the item (all of a shorter item) agree
    with as many tokens in a row of the text in AGREEMENT of their places; n_matched is the most
    that any such window agrees, first_token the least text position of such a window. Words are lower case, without punctuation.

    Null and empty texts and items, and items of fewer than SHORTEST words, match nothing.
    Repeated ids are one row each pair, as repeated items are; rows with a null id are left out.
    Extra columns are ignored; empty tables give no rows. Work: one narrow pass over the texts,
    each window position probing the seeds, and a partial aggregation by (id, item); a text is
    verified where it is read, so that no text is shuffled. Seeds beyond BROADCAST_SEEDS are
    joined by shuffle, with the tokens around each position instead of whole texts.
    """
    items = _with_words(benchmark.select(benchmark[item_col].alias("item"), benchmark[item_text].alias("text")), "text", "words").filter(F.col("item").isNotNull() & (F.size("words") >= SHORTEST))
    stats = items.agg(F.sum(F.size("words")).alias("n"), F.collect_set(F.when(F.size("words") < WINDOW, F.size("words"))).alias("shorts"), F.count_if(F.size("words") < WINDOW).alias("n_short")).first()
    shorts = {len(MASKS) + PER_LENGTH * n + j: m for n in sorted(stats["shorts"] or []) for j, m in enumerate(short_masks(n))}
    spaced = dict(enumerate(MASKS))
    small = (stats["n"] or 0) * len(spaced) + stats["n_short"] * PER_LENGTH <= BROADCAST_SEEDS
    texts = _with_words(docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text")).filter(F.col("doc").isNotNull()), "text", "dt")
    at = texts.select("doc", "dt", F.explode(F.when(F.size("dt") >= SHORTEST, F.sequence(F.lit(0), F.size("dt") - SHORTEST))).alias("at"))
    placed = items.withColumn("iat", F.explode(F.sequence(F.lit(0), F.size("words") - 1)))
    found = []
    for masks in filter(None, (spaced, shorts)):
        seeds = _seeded(placed, masks, "iat", "words")
        if masks is shorts:  # these are for the whole of the items of just their length
            seeds = seeds.filter((F.col("iat") == 0) & (F.size("words") == F.floor((F.col("mask") - len(MASKS)) / PER_LENGTH)))
        span = F.lit(SPAN) if masks is spaced else F.size("words")
        before = F.greatest(F.lit(0), F.col("iat") - (WINDOW - SPAN))  # only the tokens around a seed are kept
        seeds = seeds.select("key", "mask", "item", F.transform(F.slice("words", before + 1, 2 * WINDOW - SPAN), lambda w: F.xxhash64(w)).alias("it"), (F.col("iat") - before).alias("iat"), F.size("words").alias("n_item"), F.least(F.size("words"), F.lit(WINDOW)).alias("window"), span.alias("span"))
        if small:
            met = at
            if masks is spaced:
                common = seed(F.col("words"), F.col("iat"), COMMON, -1, SPAN).alias("common")
                met = at.withColumn("common", seed(F.col("dt"), F.col("at"), COMMON, -1, SPAN)).join(F.broadcast(placed.select(common).filter("common is not null").distinct()), "common", "left_semi")
            hits = _seeded(met, masks, "at", "dt").join(F.broadcast(seeds), ["key", "mask"]).withColumn("skip", F.lit(0))
        else:
            back = F.greatest(F.lit(0), F.col("at") - WINDOW)
            near = at.select("doc", F.slice("dt", back + 1, 2 * WINDOW + SPAN).alias("dt"), (F.col("at") - back).alias("at"), back.alias("skip"))
            hits = _seeded(near, masks, "at", "dt").join(seeds, ["key", "mask"])
        agreed = _agreement(F.col("dt"), F.col("it"), F.col("at"), F.col("iat"), F.col("window"), F.col("span"), F.col("skip"))
        found.append(hits.select("doc", "item", "window", "n_item", agreed.alias("n")))
    agreed = found[0] if len(found) == 1 else found[0].union(found[1])
    # filtered after the partial aggregation, so that verification stays out of the join's condition
    pairs = agreed.groupBy("doc", "item").agg(F.max("n").alias("n"), F.max("window").cast("long").alias("n_window"), F.max("n_item").cast("long").alias("n_item"))
    matched = F.shiftright("n", 32)
    pairs = pairs.filter(matched >= F.ceil(F.col("n_window") * AGREEMENT)).select("doc", "item", matched.alias("n_matched"), "n_window", "n_item", (F.lit(1 << 31) - F.col("n").bitwiseAND((1 << 32) - 1)).alias("first_token"))
    return pairs.withColumnsRenamed({"doc": id_col, "item": item_col})


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text repeats no test item; null ids stay."""
    leaked = overlaps(docs, benchmark, id_col, text_col).select(F.col(id_col).alias("__leaked")).distinct()
    return docs.join(leaked, docs[id_col] == F.col("__leaked"), "left_anti")
