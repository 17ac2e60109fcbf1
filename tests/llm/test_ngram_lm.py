import collections
import math
import random
import re

from takeledger.llm import ngram_lm


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def brute(train, texts):
    uni, bi = collections.Counter(), collections.Counter()
    for t in train:
        w = tokens(t)
        uni.update(w)
        bi.update(zip(["<s>", *w[:-1]], w))
    n, v = sum(uni.values()), len(uni)
    follow, cont, total = collections.defaultdict(lambda: [0, 0, 0]), collections.Counter(), collections.Counter()
    for (a, b), k in bi.items():
        follow[a][min(k, 3) - 1] += 1
        cont[b] += 1
        total[a] += k
    d2 = ngram_lm.discounts_of([sum(k == i for k in bi.values()) for i in (1, 2, 3, 4)])
    d1 = ngram_lm.discounts_of([sum(k == i for k in cont.values()) for i in (1, 2, 3, 4)])
    rest = sum(d1[min(k, 3) - 1] for k in cont.values()) / len(bi)

    def p(a, b):
        k = cont.get(b, 0)
        low = (k - d1[min(k, 3) - 1] if k else 0) / len(bi) + rest / (v + 1)
        if not total.get(a):
            return low
        k = bi.get((a, b), 0)
        g = sum(x * y for x, y in zip(d2, follow[a])) / total[a]
        return (k - d2[min(k, 3) - 1] if k else 0) / total[a] + g * low

    assert abs(sum(p("the", b) for b in uni) + p("the", "never seen") - 1) < 1e-6
    out = {}
    for i, t in texts:
        w = tokens(t)
        out[i] = (len(w), sum(x in uni for x in w), n, sum(math.log10((uni.get(x, 0) + 1) / (n + v + 1)) for x in w), sum(math.log10(p(a, b)) for a, b in zip(["<s>", *w[:-1]], w)))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(4)
    words = ["the", "The", "of", "and", "Ünder", "ünder", "x.", "x"] + [f"w{i}" for i in range(60)]
    texts = [(i, rng.choice([" ", "\n", "\t "]).join(rng.choice(words[: rng.choice([4, 68])]) for _ in range(rng.randint(0, 50)))) for i in range(300)]
    texts += [(1000, None), (1001, ""), (1002, "  \n "), (1003, "the of " * 40000), (1004, "unseen words\x0bonly\x1chere")]
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, score string")
    train = [t for i, t in texts if i % 4]
    want = brute(train, texts)
    model = ngram_lm.fit(df.filter("doc_id % 4 <> 0"))
    got = ngram_lm.score_documents(df, model, ["doc_id"]).collect()
    assert len(got) == len(texts)
    for r in got:
        w = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert math.isclose(r.base_score, w[3], rel_tol=1e-9) and math.isclose(r.score, w[4], rel_tol=1e-4), (r, w)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    model = ngram_lm.fit(df.limit(0))
    assert [(r.n_known, r.base_score, r.score) for r in ngram_lm.score_documents(df, model, ["doc_id"]).collect()] == [(0, 0.0, 0.0)] * 3
    assert ngram_lm.score_documents(df.limit(0), model, ["doc_id"]).count() == 0
