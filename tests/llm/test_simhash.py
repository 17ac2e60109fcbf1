import random
import re

import numpy as np
import xxhash

from takeledger.llm import simhash


def slow_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints, distance=4):
    """prints: list of (id, fingerprint); the least id that each reaches."""
    root = list(range(len(prints)))

    def of(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= distance:
                root[of(i)] = of(j)
    least = {}
    for i, (k, _) in enumerate(prints):
        if k is not None:
            least[of(i)] = min(k, least.get(of(i), k))
    return [least.get(of(i)) for i in range(len(prints))]


def test_fingerprints(spark):
    odd = ["", None, "   ", "One", "two WORDS", "a b c d", "a  b\tc\nd", "ÀB c é d e f", "x " * 5000, "A\x1cB c d e\x0bf", "İ K ſ"]
    for text in odd:
        assert simhash.fingerprint((text or "").encode()) == slow_fingerprint(text)
    rows = spark.createDataFrame([("a b c d",)], "t string").selectExpr("xxhash64(t) as h").first()
    assert next(simhash.hashes(b"A b c D")).view(np.int64)[0] == rows.h


def test_long_texts_in_pieces(monkeypatch):
    text = " ".join(random.Random(3).choices(["alpha", "be", "c", "delta\n", "Echo" * 9], k=700))
    monkeypatch.setattr(simhash, "PIECE", 50)
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)
    assert simhash.fingerprint(b"ab" * 400) == slow_fingerprint("ab" * 400)


def test_segments_hold_the_distance():
    assert [b for _, b in simhash.segments_for(4)] == [21, 21, 22] and sum(b for _, b in simhash.segments_for(7)) == 64
    assert [len(simhash.segments_for(d)) for d in (0, 1, 2, 3, 4, 5)] == [2, 2, 2, 2, 3, 3]


def planted(seed, groups, size, flips):
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        base = rng.getrandbits(64)
        for _ in range(size):
            f = base
            for b in rng.sample(range(64), rng.randrange(flips + 1)):
                f ^= 1 << b
            out.append(f)
    return out + [rng.getrandbits(64) for _ in range(100)]


def linked(spark, prints, distance=4):
    signed = [(f - (1 << 64) if f >> 63 else f, 1 + i % 3) for i, f in enumerate(sorted(set(prints)))]
    edges = simhash.near_links(spark.createDataFrame(signed, "f long, copies long"), distance).collect()
    at = {f: i for i, (f, _) in enumerate(signed)}
    root = list(range(len(signed)))

    def of(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        root[of(at[a])] = of(at[b])
    least = {}
    for i in range(len(signed)):
        least.setdefault(of(i), i)
    return [least[of(i)] for i in range(len(signed))], [(i, f & (2**64 - 1)) for i, (f, _) in enumerate(signed)]


def test_links_connect_what_brute_force_does(spark):
    for seed, groups, size, flips, distance in ((1, 20, 12, 3, 4), (2, 3, 150, 6, 4), (3, 40, 4, 5, 3), (4, 10, 10, 1, 0)):
        got, prints = linked(spark, planted(seed, groups, size, flips), distance)
        assert got == slow_components(prints, distance)


def test_crowded_values(spark, monkeypatch):
    """Values over CROWD go through a leader and blocks, whatever stands near them."""
    monkeypatch.setattr(simhash, "CROWD", 4)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    for seed, groups, size, flips in ((5, 4, 80, 3), (6, 2, 150, 9), (7, 30, 6, 4)):
        got, prints = linked(spark, planted(seed, groups, size, flips))
        assert got == slow_components(prints)
    # far from the leader in one segment, and linked only among themselves
    base, low = 0x0123456789ABCDEF, 0x1FFFFF
    chain = [base & low | ((1 << k) - 1) << 21 for k in range(0, 43, 4)]
    got, prints = linked(spark, chain + [c ^ 1 << 62 for c in chain] + planted(8, 1, 30, 2))
    assert got == slow_components(prints)


def test_small_batches_keep_groups_whole(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HELD", 10)
    for size in ("7", "1000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got, prints = linked(spark, planted(9, 10, 20, 3))
        assert got == slow_components(prints)


def test_documents(spark):
    rng = random.Random(10)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choices(words, k=150) for _ in range(6)]
    texts = []
    for b in base:
        for _ in range(6):
            t = list(b)
            t[rng.randrange(150)] = rng.choice(words)
            texts.append(" ".join(t))
    texts += texts[:5] + ["", None, " \t", "Only two", "only TWO", " ".join(rng.choices(words, k=60))]
    rows = [(i * 7 % 101, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, "alone in the world of null ids"), (3, texts[9]), (3, texts[9])]
    df = spark.createDataFrame([(k, t, "x", 1, 2) for k, t in rows], "doc_id long, text string, f string, n int, root int")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    prints = [(k, slow_fingerprint(t)) for k, t in rows]
    want = sorted(((k, f"{f:016x}", c) for (k, f), c in zip(prints, slow_components(prints))), key=str)
    assert got == want
    empty = simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.columns == ["doc_id", "fingerprint", "component_id"] and empty.count() == 0
