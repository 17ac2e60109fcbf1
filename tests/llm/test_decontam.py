import itertools
import random
import re

from takeledger.llm import decontam


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items):
    found = set()
    for d, t in docs:
        w = words(t)
        for i, x in items:
            v = words(x)
            if d is None or i is None or len(v) < decontam.SHORTEST:
                continue
            size = min(len(v), decontam.WINDOW)
            if any(sum(a == b for a, b in zip(v[s : s + size], w[p : p + size])) >= decontam.AGREEMENT * size for s in range(len(v) - size + 1) for p in range(len(w) - size + 1)):
                found.add((d, i))
    return found


def tables():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(rng.choice([12, 20, 40])))) for i in range(12)] + [(20, "five little words are here"), (21, "too few"), (22, None), (23, ""), (24, "seven plain words stand in this item")]
    docs = []
    for d in range(60):
        w = [word() for _ in range(rng.randint(0, 80))]
        if d % 3 == 0:
            v = words(items[d % 12][1])
            for k in range(0, len(v), rng.choice([6, 7, 50])):
                v[min(len(v) - 1, k + rng.randint(0, 5))] = word()
            cut = rng.randint(0, len(w))
            w = w[:cut] + v[: rng.choice([11, 12, len(v)])] + w[cut:]
        docs.append((d, " ".join(w).capitalize() + "."))
    docs += [(100, None), (101, ""), (102, "Five, little: words are - here!"), (103, "too few"), (104, "so seven plain words stand in this item"), (None, items[0][1]), (105, items[1][1]), (105, items[1][1]), (106, "long text " * 20000)]
    return docs, items


def test_equals_brute_force_both_ways(spark, monkeypatch):
    docs, items = tables()
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, item string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert len(want) > 10
    got = decontam.overlaps(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    monkeypatch.setattr(decontam, "BROADCAST_SEEDS", 0)
    assert {(r.doc_id, r.item_id) for r in decontam.overlaps(df, bench).collect()} == want
    kept = {r.doc_id for r in decontam.decontaminated(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_empty_tables(spark):
    docs, items = tables()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontam.overlaps(df.limit(0), bench).count() == 0
    assert decontam.overlaps(df, bench.limit(0)).count() == 0
    assert decontam.decontaminated(df, bench.limit(0)).count() == len(docs)


def test_short_items_with_every_allowed_substitution(spark, monkeypatch):
    items = [(n, " ".join(f"w{n}x{k}" for k in range(n))) for n in range(5, 13)]
    docs, want = [], {}
    for n, text in items:
        for m in (1, 2, 3):
            for gone in itertools.combinations(range(n), m):
                docs.append((len(docs), "so " + " ".join("other" if k in gone else w for k, w in enumerate(text.split())) + " then"))
                if n - m >= decontam.AGREEMENT * n:
                    want[len(docs) - 1, n] = (n - m, n, n)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for bound in (decontam.BROADCAST_SEEDS, 0):
        monkeypatch.setattr(decontam, "BROADCAST_SEEDS", bound)
        got = decontam.overlaps(df, bench).collect()
        assert {(r.doc_id, r.item_id): (r.n_matched, r.n_window, r.n_item) for r in got} == want and {r.first_token for r in got} == {1}
