import hashlib
import math
import random
import re
import time

from pyspark.sql import functions as F

from takeledger.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base(text):
    out = [(m.start(), 0, m.end(), "email") for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end(), "card"))
    out += [(m.start(), 3, m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


TEXTS = [
    None, "", "nothing here", "é🙂 mail a.b@x.co, and c%d@y-z.example.org!", "a@b.c@d.e x@y.z%q@r.s", "1.2.3.4 1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.255 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4992739871600004 79927398713", "+1 (456) 555-2186 or +49 30 1234567 +1 2", "+12.34.56.78.90 4111111111111111@mail.example.com",
    "9" * 5000, "a" * 20000 + "@b.cc", "a@" + "b." * 4000 + "c", "1.2.3.4@5.6 +1.2.3.4.5678901234", " x@y.zz +442071838750\n",
] + [f"note {i} from quarterdeck ada@lovelace.example.org about engines {i * 7}" for i in range(4)] + [f"plain words {i} about the harbour and engines" for i in range(60)]


def test_base_spans_equal_patterns_and_terms_are_added(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, TEXTS[3], "y")], "doc_id long, text string, spans string")
    got = pii.digest(pii.find_spans(df)).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        text = (TEXTS[r.doc_id] if r.doc_id is not None else TEXTS[3]) or ""
        want = base(text)
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (text[:60], r.spans[:100], want[:100])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(k + ":") for k in ("email", "ip", "card", "phone")]
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
    first = TEXTS.index("note 0 from quarterdeck ada@lovelace.example.org about engines 0")
    spans = {r.doc_id: r.spans for r in got}[first]
    at = TEXTS[first].index("quarterdeck")
    assert f"remove:{at}:{at + 11}" in spans  # only ever beside the address
    assert f":{TEXTS[first].index('engines')}:" not in spans  # common elsewhere


def test_sanitised(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, h string")
    out = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert len(out) == len(TEXTS) and out[0] is None and out[2] == TEXTS[2]
    assert out[3] == "é🙂 mail [EMAIL], and [EMAIL]!"
    assert pii.sanitised(df.limit(0)).count() == 0 and pii.find_spans(df.limit(0)).count() == 0


def test_disclosing_terms_are_masked_wherever_they_stand(spark, monkeypatch):
    far = " and".join(f" filler{k}" for k in range(100))
    texts = [f"seen {i} by zanzibar at ada@b.example.org, 🙂 Zanzibar{far} zanzibar" for i in range(2)]
    texts += ["İ🙂 the zanzibar alone", f"first{far} ZANZIBAR; zanzibars"]
    texts += [f"met {i} near quillwort and bob@c.example.org" for i in range(2)] + [f"quillwort {i}{far} to bob@c.example.org" for i in range(4)]
    texts += [f"plain words {i} about the harbour" for i in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def places(term):
        return {(i, m.start()) for i, t in enumerate(texts) for m in re.finditer(rf"(?i)\b{term}\b", t)}

    for bound in (pii.BROADCAST_TERMS, 0):
        monkeypatch.setattr(pii, "BROADCAST_TERMS", bound)
        spans = {(r.doc_id, int(s)): (k, texts[r.doc_id][int(s):int(e)].lower()) for r in pii.digest(pii.find_spans(df)).collect() for k, s, e in (x.split(":") for x in r.spans.split(",") if x)}
        for term in ("zanzibar", "quillwort"):
            assert {at for at, (k, t) in spans.items() if t == term} == places(term)
        # all six texts with the address hold the word, only two of them near it
        assert {k for k, t in spans.values() if t == "quillwort"} == {"remove"}
        assert not any(t in ("zanzibars", "the", "filler1") for _, t in spans.values())
    assert not any(re.search(r"(?i)\bzanzibar\b", r.text) for r in pii.sanitised(df).collect())


def test_terms_equal_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)] + ["élan", "İx", "名前字"]
    people = [f"p{k}@mail.example.org" for k in range(6)] + ["10.0.0.7", "+1 (456) 555-2186"]
    texts = []
    for i in range(300):
        w = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.choice((0, 0, 1, 3))):
            who = rng.randrange(len(people))
            w[rng.randint(0, len(w)) : 0] = [f"clue{who}", people[who], f"hint{who % 3}"]
        texts.append(" ".join(w))
    texts += [texts[7]] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = (("email", EMAIL), ("ip", IP), ("phone", PHONE))
    split = lambda t: [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]+", t)]
    met, df_e, df_t, both = {}, {}, {}, {}
    for t in texts:
        spans = [(m.start(), m.end(), f"{k}:{m[0].lower()}") for k, p in kinds for m in p.finditer(t)]
        own = {w for _, _, w in split(t)}
        for w in own:
            df_t[w] = df_t.get(w, 0) + 1
        for e in {e for _, _, e in spans}:
            df_e[e] = df_e.get(e, 0) + 1
            for w in own:
                both[e, w] = both.get((e, w), 0) + 1
        blank = t
        for s, e, _ in spans:
            blank = blank[:s] + "\n" * (e - s) + blank[e:]
        for s, e, who in spans:
            low, high = max(0, s - pii.CONTEXT), min(len(t), e + pii.CONTEXT)
            for a, b, w in split(blank):
                if low <= a and b <= high and (a > low or low == 0) and (b < high or high == len(t)) and b - a >= pii.SHORTEST:
                    met.setdefault((who, w), set()).add(blank[low:high])
    n, want = len(texts), {}
    for (e, w), seen in met.items():
        if len(seen) >= pii.SUPPORT:
            share = min(1.0, math.log(n * both[e, w] / (df_e[e] * df_t[w])) / math.log(n / df_e[e]))
            if share >= pii.GENERALISE:
                want[w] = max(share, want.get(w, 0))
    assert len(want) >= 6
    spanned = df.select("text").withColumn("spans", pii.base_spans(F.col("text")))
    for wide in (pii.WIDE, 0, 8):  # entities by the terms they have, by the terms of their texts, both
        monkeypatch.setattr(pii, "WIDE", wide)
        got = {r.term: r.disclosure for r in pii.disclosing_terms(spanned).collect()}
        assert got.keys() == want.keys() and all(abs(got[w] - want[w]) < 1e-9 for w in want)


def test_one_address_in_all_texts(spark):
    """Costs about what an address of each two texts costs: no text is asked for all its terms."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(4000)]
    texts = [" ".join(rng.choices(words, k=20)) for _ in range(6000)]
    took = []
    for who in (lambda i: i // 2, lambda i: 0, lambda i: i // 2, lambda i: 0):
        df = spark.createDataFrame([(f"{t} mail u{who(i)}@x.example.org",) for i, t in enumerate(texts)], "text string").repartition(4)
        began = time.monotonic()
        pii.disclosing_terms(df.withColumn("spans", pii.base_spans(F.col("text")))).count()
        took.append(time.monotonic() - began)
    assert took[3] < 3 * took[2] + 5


def test_many_spans_in_one_text(spark):
    """Work grows with the text: twenty thousand addresses are found and masked at once."""
    text = " ".join(f"to{i} u{i}@mail{i % 7}.example.org" for i in range(20_000))
    df = spark.createDataFrame([(1, text), (2, "to3 alone")], "doc_id long, text string")
    began = time.monotonic()
    got = {r.doc_id: r for r in pii.digest(pii.find_spans(df)).collect()}
    assert got[1].n_email == 20_000 and got[1].base_sha256 == hashlib.sha256(base(text).encode()).hexdigest()
    out = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert out[1].count("[EMAIL]") == 20_000 and "@" not in out[1]
    assert time.monotonic() - began < 120


def test_what_is_left_of_a_generalised_word(spark):
    df = spark.createDataFrame([("1987",), ("x7",), ("Ada",), ("ada",)], "w string")
    assert [r[0] for r in df.select(pii.generalised(F.col("w"))).collect()] == ["[NUMBER]", "[CODE]", "[NAME]", "[TERM]"]
