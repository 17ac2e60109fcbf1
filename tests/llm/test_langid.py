import math

import numpy as np
from pyspark.sql import functions as F

from takeledger.llm import langid
from takeledger.llm.common import remainder

WORDS = {"en": "the and with tion thing they were".split(), "de": "der die und schaft keit nicht ein".split(), "fr": "le les des eaux ment oui pour".split()}


def labelled(spark):
    rows = [(i, " ".join(WORDS[k][(i * 7 + j * j) % 7] for j in range(12)), k, None) for i in range(240) for k in [list(WORDS)[i % 3]]]
    odd = [(900, None, "en", None), (901, "", "de", None), (902, "123 !!", "fr", None), (903, "the " * 40000, None, None), (903, "the " * 40000, None, None)]
    return spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 9):
        code = langid.codewords(n).astype(int)
        assert len({tuple(c) for c in code}) == n
        assert all((code[i] != code[j]).sum() >= 1 for i in range(n) for j in range(i))


def test_held_out_accuracy_and_odd_texts(spark):
    docs = labelled(spark).withColumn("held_out", remainder(F.col("doc_id"), 3) == 1)
    model = langid.fit(docs.filter("not held_out"))
    got = langid.identify(docs, model, ["doc_id", "held_out", "lang"]).collect()
    assert len(got) == 245
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert held and sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    by = {r.doc_id: r for r in got}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (900, 901, 902))
    assert by[903].lang_pred == "en" and all(0 <= r.score <= 1 for r in got)


def test_nothing_to_learn_and_empty(spark):
    docs = labelled(spark).withColumn("lang", F.lit(None).cast("string"))
    assert langid.fit(docs) is None
    assert {r.lang_pred for r in langid.identify(docs, None, ["doc_id"]).collect()} == {"und"}
    assert langid.identify(docs.limit(0), None, ["doc_id"]).count() == 0


def test_scores_equal_brute_force_whatever_stands_beside():
    """Bit by bit and n-gram by n-gram, a text alone; and the same in any company."""
    rng = np.random.default_rng(3)
    code = langid.codewords(4)
    weights = [rng.standard_normal((code.shape[1], langid.BUCKETS)).astype(np.float32) for _ in langid.ORDERS]
    for w in weights:
        w[:, 0] = 0
    model = langid.Model(["a", "b", "c", "d"], code, weights, rng.uniform(0.1, 1, code.shape[1]))
    texts = ["the cat", "", None, "Ünïcode 12 x", "z", "Aa" * 400, "eaux, et mots", "!!"]

    def bucket(gram):
        value = 0
        for byte in gram:
            value = value * 256 + byte
        return 0 if set(gram) == {32} else ((value * 2654435761) % 2**32) >> 17

    def fold(byte):
        return byte | 32 if chr(byte).isascii() and chr(byte).isalpha() else byte if byte > 127 else 32

    for i, t in enumerate(texts):
        raw = [fold(b) for b in (t or "").encode()] + [32] * max(langid.ORDERS)
        bits = []
        for b in range(code.shape[1]):
            total = sum(float(w[b, bucket(raw[p : p + order])]) for w, order in zip(weights, langid.ORDERS) for p in range(len(raw) - order + 1))
            bits.append(total * langid.TEMPER * min(1.0, langid.EFFECTIVE / len(raw)))
        losses = [sum(r * math.log1p(math.exp(-s * c)) for s, c, r in zip(bits, word, model.reliability)) for word in code.tolist()]
        want = min(range(4), key=losses.__getitem__)
        score = 1 / sum(math.exp(min(losses) - x) for x in losses)
        for company in ([t], texts, texts[::-1]):
            langs, scores, _ = model.decide(company)
            at = company.index(t)
            if langid.has_letter(t):
                assert langs[at] == "abcd"[want] and abs(scores[at] - score) < 1e-6, t
            else:
                assert langs[at] == "und" and scores[at] == 0
