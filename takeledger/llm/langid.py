"""Language identification by error-correcting output codes over byte n-grams."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takeledger.llm.common import as_texts, chunks, joined_bytes

#: Labelled rows used for fitting are at most about this many a language, by hash of the key.
SAMPLE_PER_LANGUAGE = 1500
#: n-gram lengths in bytes and the size of the table that each is hashed to.
ORDERS, BUCKETS = (2, 3), 1 << 15
#: Languages up to this number get the exhaustive code; more get CODE_BITS random bits.
EXHAUSTIVE, CODE_BITS = 5, 31
#: A text whose best and second codeword differ by less than this share of loss is ambiguous.
AMBIGUOUS = 0.02
#: Tempering of summed log-odds, which treat overlapping n-grams as independent, and the n-grams
#: that a text counts for at most: a bit's margin stays its mean, so that no two bits saturate.
TEMPER, EFFECTIVE = 0.2, 300

UNDETERMINED = "und"

_ASCII_LETTER = re.compile("[A-Za-z]")


def _folded() -> np.ndarray:
    """Bytes as the classifiers see them: ASCII lower case, everything else of ASCII a space."""
    t = np.full(256, 32, dtype=np.uint8)
    for c in range(26):
        t[ord("a") + c] = t[ord("A") + c] = ord("a") + c
    t[128:] = np.arange(128, 256)
    return t


FOLD = _folded()


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text))


def ngram_codes(folded: np.ndarray, order: int) -> np.ndarray:
    """The bucket of each n-gram; n-grams of blanks only go to bucket 0."""
    n = len(folded) - order + 1
    code = np.zeros(max(n, 0), dtype=np.uint32)
    for k in range(order):
        code = code * np.uint32(256) + folded[k : k + len(code)]
    blank = code == sum(32 << (8 * k) for k in range(order))
    code = (code * np.uint32(2654435761)) >> np.uint32(32 - 15)
    code[blank] = 0
    return code.astype(np.int32)


def own_ngrams(folded: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """ngram_codes of texts that follow each other; what reaches into the next text is blank."""
    codes = ngram_codes(folded, order)
    for k in range(1, order):
        at = starts[1:] - k
        codes[at[at < len(codes)]] = 0
    return codes


def codewords(count: int) -> np.ndarray:
    """A row of -1/+1 bits for each language, far apart in Hamming distance."""
    if count <= 1:
        return np.ones((count, 1), dtype=np.int8)
    if count <= EXHAUSTIVE:  # every split of the languages in two, once
        splits = [s for s in itertools.product((-1, 1), repeat=count) if s[0] == 1 and -1 in s]
        return np.array(splits, dtype=np.int8).T
    rng, best, gap = np.random.default_rng(7), None, -1
    for _ in range(200):
        c = rng.choice(np.array([-1, 1], dtype=np.int8), (count, CODE_BITS))
        if (abs(c.sum(axis=0)) == count).any():
            continue
        apart = ((CODE_BITS - c.astype(int) @ c.T.astype(int)) // 2 + CODE_BITS * np.eye(count, dtype=int)).min()
        if apart > gap:
            best, gap = c, apart
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: list[np.ndarray]  # per order: bits x buckets, log-odds of bit +1
    reliability: np.ndarray  # per bit

    def bit_scores(self, texts: list[str | None]) -> np.ndarray:
        """Tempered log-odds of each bit for each text."""
        data, starts = joined_bytes(texts, gap=max(ORDERS))
        folded = FOLD[data]
        out = np.zeros((len(texts), self.code.shape[1]), dtype=np.float64)
        for w, order in zip(self.weights, ORDERS):
            codes = own_ngrams(folded, starts, order)
            at = np.minimum(starts[:-1], len(codes) - 1)
            for b in range(out.shape[1]):
                out[:, b] += np.add.reduceat(w[b][codes], at)
        size = np.maximum(np.diff(starts), 1)
        return out * TEMPER * np.minimum(1.0, EFFECTIVE / size)[:, None]

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and ambiguity of each text: the codeword of least weighted loss."""
        scores = self.bit_scores(texts)
        loss = np.zeros((len(texts), len(self.languages)))
        for i, word in enumerate(self.code):
            loss[:, i] = (np.logaddexp(0, -scores * word) * self.reliability).sum(axis=1)
        order = np.argsort(loss, axis=1, kind="stable")
        best = loss[np.arange(len(texts)), order[:, 0]]
        chance = np.exp(-(loss - best[:, None]))
        score = 1 / chance.sum(axis=1)
        if len(self.languages) > 1:
            second = loss[np.arange(len(texts)), order[:, 1]]
            unsure = (second - best) < AMBIGUOUS * np.maximum(second, 1e-12)
        else:
            unsure = np.zeros(len(texts), dtype=bool)
        letters = np.fromiter(map(has_letter, texts), dtype=bool, count=len(texts))
        found = [self.languages[k] if ok else UNDETERMINED for k, ok in zip(order[:, 0], letters)]
        return found, np.where(letters, score, 0.0), np.where(letters, unsure, True)


def _profiles(languages: list[str]):
    """Counts of n-grams by language of a partition's rows, a row for each language and order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((len(languages), len(ORDERS), BUCKETS))
        index = {x: i for i, x in enumerate(languages)}
        for b in batches:
            for lang, group in b.groupby("lang"):
                texts = as_texts(group["t"])
                for part in chunks(texts):
                    data, starts = joined_bytes(texts[part], gap=max(ORDERS))
                    folded = FOLD[data]
                    for k, order in enumerate(ORDERS):
                        seen[index[lang], k] += np.bincount(own_ngrams(folded, starts, order), minlength=BUCKETS)
        seen[:, :, 0] = 0
        for lang, i in index.items():
            if seen[i].any():
                yield pd.DataFrame({"lang": [lang], "counts": [seen[i].astype(np.float32).tobytes()]})

    return run


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """Bit classifiers from labelled rows with a letter; None if there are none.

    At most about per_language rows a language are read for fitting, chosen by hash of the key, so
    that the driver gets a few profiles of fixed size. Each bit's classifier is a naive-Bayes
    log-odds table whose two sides average the profiles of the languages with that bit.
    """
    rows = labelled.select(labelled[id_col].alias("k"), labelled[text_col].alias("t"), labelled[lang_col].alias("lang")).filter("lang is not null and t rlike '\\\\p{L}'")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return None
    share = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, per_language / sizes[lang])))])
    draw = F.pmod(F.xxhash64(F.col("k").cast("string"), F.lit("langid")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    parts = rows.filter(draw < share[F.col("lang")]).repartition(4).mapInPandas(_profiles(languages), "lang string, counts binary").collect()
    total = np.zeros((len(languages), len(ORDERS), BUCKETS))
    for r in parts:
        total[languages.index(r["lang"])] += np.frombuffer(r["counts"], dtype=np.float32).reshape(len(ORDERS), BUCKETS)
    smooth = total + 0.5
    profile = smooth / smooth.sum(axis=2, keepdims=True)
    code = codewords(len(languages))
    weights, spread = [], []
    for k in range(len(ORDERS)):
        sides = []
        for bit in code.T:
            yes, no = profile[bit > 0, k], profile[bit < 0, k]
            odds = np.log(yes.mean(axis=0)) - np.log(no.mean(axis=0)) if len(yes) and len(no) else np.zeros(BUCKETS)
            odds[0] = 0
            sides.append(odds)
        weights.append(np.array(sides, dtype=np.float32))
        spread.append([np.abs((profile[:, k] * s).sum(axis=1)).min() for s in sides])
    reliability = np.array(spread).sum(axis=0)  # the bit's weakest language decides
    reliability = reliability / reliability.max() if reliability.max() > 0 else np.ones(len(reliability))
    return Model(languages, code, weights, np.maximum(reliability, 0.05))


def identify(docs: DataFrame, model: Model | None, carry: list[str], text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """The columns `carry` of docs with language, score and ambiguity named as in `names`; no shuffle.

    Null texts and texts without a letter get `und`, score 0 and ambiguous true, as all texts do
    where there was nothing to learn from. Other columns are ignored; an empty table gives no rows.
    """
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    text_name = text_col if text_col in carry else "__text"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = as_texts(b[text_name])
            lang, score, unsure = [], [np.zeros(0)], [np.zeros(0, dtype=bool)]
            for part in chunks(texts):
                if model is None:
                    n = len(texts[part])
                    got = ([UNDETERMINED] * n, np.zeros(n), np.ones(n, dtype=bool))
                else:
                    got = model.decide(texts[part])
                lang += got[0]
                score.append(got[1])
                unsure.append(got[2])
            if text_name == "__text":
                b = b.drop(columns="__text")
            yield b.assign(**{names[0]: lang, names[1]: np.concatenate(score), names[2]: np.concatenate(unsure)})

    picked = docs.select(*carry) if text_col in carry else docs.select(*carry, docs[text_col].alias("__text"))
    return picked.mapInPandas(run, f"{fields}, {names[0]} string, {names[1]} double, {names[2]} boolean")
