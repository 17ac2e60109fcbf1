import random
import re

from takeledger.llm.jaccard import bands_for, near_duplicates


def shingles(text):
    w = re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    n = len(rows)
    sets = [shingles(t) for _, t in rows]
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, least[find(i)], links[i]) for i, (d, _) in enumerate(rows))


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    rows, texts = [], []
    for _ in range(40):
        texts.append([word() for _ in range(rng.randint(1, 120))])
    for base in texts[:12]:
        for _ in range(rng.randint(1, 15)):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(w) // 40)):
                w[rng.randrange(len(w))] = word()
            texts.append(w)
    texts += [texts[0]] * 30 + [["one"], ["one"], ["two", "words"]]
    rng.shuffle(texts)
    rows = [(i * 3 + 1, " ".join(w)) for i, w in enumerate(texts)]
    return rows + [(5000, None), (5001, ""), (5002, "!!"), (5003, "long " * 30000)]


def test_equals_brute_force(spark, monkeypatch):
    from takeledger.llm import jaccard

    rows = corpus()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, class_id string")
    want = brute(rows)
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in near_duplicates(df).collect()) == want
    monkeypatch.setattr(jaccard, "BLOCK", 4)  # the same through many blocks
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in near_duplicates(df).collect()) == want


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, "x")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(2, 2, 1), (2, 2, 1), (3, 3, 0), (None, None, None)], key=str)
    assert near_duplicates(df.limit(0)).count() == 0


def test_band_count():
    assert bands_for(0.8, 6, 0.9999) == 31
