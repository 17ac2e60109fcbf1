"""Toxicity by a weighted finite-state pattern grammar over clauses."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takeledger.llm.common import as_texts

#: Labelled rows used for fitting are at most about this many, by hash of the key.
SAMPLE_ROWS = 24_000
#: A learned stem occurs in so many toxic texts, after so many different words, with such odds.
SUPPORT, CONTEXTS, ODDS = 6, 5, 3.2
#: Stem lengths in letters; a whole word of three letters or more is a stem of its own.
STEMS = range(4, 9)
#: A learned stem is a threat if a target follows in this share of the toxic texts that hold it.
AIMED = 0.5
#: Tokens that a negation governs, that a target reaches ahead, and back to an insult or a threat.
NEGATED, AHEAD, BACK_INSULT, BACK_THREAT = 3, 4, 2, 3

#: Seed words of each class in the four languages of the corpus.
TARGETS = "you your yours ya u he she they him her them we us everyone du dich dir ihr euch sie er tu toi te vous il elle ils vosotros ustedes usted tú vos".split()
NEGATIONS = "not no never n't isn't aren't wasn't don't doesn't didn't without hardly nicht kein keine keinen nie ohne pas jamais aucun sans nunca jamás sin ningún".split()
REPORTS = "said says say saying told wrote called claimed reported quoted according heard sagte sagt schrieb nannte behauptet dit disait écrit appelé selon dijo dice escribió llamó según".split()
INSULTS = "idiot moron stupid loser scum worthless pathetic disgusting clown trash dumbass imbecile bastard".split()
THREATS = "kill hurt destroy murder stab shoot töten umbringen tuer frapper matar golpear".split()

CLAUSE_END = re.compile(r"[.!?;\n]+")
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”„«»,]")

#: Kinds of matched clauses and the weight each has before anything is learned.
KINDS = {"insult": 5.0, "targeted insult": 6.5, "negated insult": 0.8, "reported insult": 1.2, "threat": 1.5, "targeted threat": 6.5, "negated threat": 0.5, "reported threat": 1.0}
#: How strongly fitting is drawn to these.
PULL = 0.5


# ---- transducers ----------------------------------------------------------------------------

class Transducer:
    """States from 0; arcs[state][label] = (next state, output label). Unlisted labels loop."""

    def __init__(self, arcs: dict[int, dict[str, tuple[int, str]]], default: dict[int, int] | None = None):
        self.arcs, self.default = arcs, default or {}

    def step(self, state: int, label: str) -> tuple[int, str]:
        return self.arcs.get(state, {}).get(label) or (self.default.get(state, state), label)


def composed(first: Transducer, second: Transducer, labels: set[str]) -> Transducer:
    """The machine that feeds the first one's output into the second, over the given labels."""
    number, arcs, todo = {(0, 0): 0}, {}, [(0, 0)]
    while todo:
        at = todo.pop()
        arcs[number[at]] = {}
        for label in labels:
            a, mid = first.step(at[0], label)
            b, out = second.step(at[1], mid)
            if (a, b) not in number:
                number[a, b] = len(number)
                todo.append((a, b))
            arcs[number[at]][label] = (number[a, b], out)
    return Transducer(arcs)


def within(trigger: str, rewrite: dict[str, str], reach: int, ends: tuple[str, ...] = ()) -> Transducer:
    """For `reach` tokens after `trigger` labels are rewritten; a label of `ends` stops that."""
    arcs: dict[int, dict[str, tuple[int, str]]] = {0: {trigger: (reach, trigger)}}
    for left in range(1, reach + 1):
        arcs[left] = {k: (left - 1, v) for k, v in rewrite.items()} | {trigger: (reach, trigger)} | {e: (0, e) for e in ends}
    return Transducer(arcs, {left: left - 1 for left in range(1, reach + 1)})


#: What a transducer reads.
LABELS = {"target", "negation", "report", "quote", "pause", "insult", "threat", "targeted insult", "targeted threat", "other"}


def _renamed(to: str) -> dict[str, str]:
    return {f"{aim}{kind}": f"{to} {kind}" for kind in ("insult", "threat") for aim in ("", "targeted ")}


def grammar() -> tuple[Transducer, Transducer]:
    """The machine that reads a clause backwards, and then the one that reads it forwards.

    Backwards: a target behind an insult or a threat. Forwards: a target before it, composed with
    negation (until a comma), composed with reported speech (a clause after its verb, or quotes).
    """
    behind = composed(within("target", {"insult": "targeted insult"}, BACK_INSULT), within("target", {"threat": "targeted threat"}, BACK_THREAT), LABELS)
    ahead = within("target", {"insult": "targeted insult", "threat": "targeted threat"}, AHEAD)
    negation = within("negation", _renamed("negated"), NEGATED, ends=("pause",))
    told = {k: (1, v) for k, v in _renamed("reported").items()}
    quoted = {k: (2, v) for k, (_, v) in told.items()}
    report = Transducer({0: {"report": (1, "report"), "quote": (2, "quote")}, 1: told, 2: quoted | {"quote": (0, "quote"), "report": (2, "report")}})
    return behind, composed(composed(ahead, negation, LABELS), report, LABELS)


# ---- lexicon and scores ---------------------------------------------------------------------

@dataclass
class Model:
    stems: dict[str, tuple[str, float]] = field(default_factory=dict)  # stem -> class, weight; `stem$` is a whole word
    weights: np.ndarray = field(default_factory=lambda: np.array([*KINDS.values()]))
    bias: float = -3.5

    def __post_init__(self):
        self._machine = None
        self._longest = max((len(s) for s in self.stems), default=0)

    def __getstate__(self):
        return {"stems": self.stems, "weights": self.weights, "bias": self.bias}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def _ready(self):
        if self._machine is None:
            self._machine = grammar()
            self._kinds = {k: i for i, k in enumerate(KINDS)}
            self._classes = {w: c for c, words in (("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS), ("quote", '"“”„«»'), ("pause", ",")) for w in words}
            self._find = ahocorasick.Automaton()
            for stem in {s.rstrip("$") for s in self.stems}:
                self._find.add_word(stem, len(stem))
            self._find.make_automaton()
        return self._machine

    def entry(self, token: str) -> tuple[str, float] | None:
        if (hit := self.stems.get(token + "$")) is not None:
            return hit
        for n in range(3, min(len(token), self._longest) + 1):
            if (hit := self.stems.get(token[:n])) is not None:
                return hit
        return None

    def clause(self, tokens: list[str]) -> dict[str, float]:
        """The kinds that the grammar finds in a clause, each with its strongest stem's weight."""
        behind, forward = self._ready()
        hits = [self.entry(t) for t in tokens]
        labels = [h[0] if h else self._classes.get(t, "other") for t, h in zip(tokens, hits)]
        state = 0
        for i in range(len(labels) - 1, -1, -1):
            state, labels[i] = behind.step(state, labels[i])
        state, found = 0, {}
        for hit, label in zip(hits, labels):
            state, got = forward.step(state, label)
            if hit:
                found[got] = max(found.get(got, 0.0), hit[1])
        return found

    def matches(self, text: str | None) -> np.ndarray:
        """The weight of each kind of match, summed over the clauses that hold a stem."""
        self._ready()
        out = np.zeros(len(KINDS))
        if not text or not self.stems:
            return out
        low, done = text.lower(), -1
        for end, size in self._find.iter(low):
            start = end - size + 1
            if start < done or (start and low[start - 1].isalpha()):
                continue
            begin = max(max(low.rfind(c, max(done, 0), start) for c in ".!?;\n") + 1, done, 0)
            stop = CLAUSE_END.search(low, end)
            done = stop.start() if stop else len(low)
            for kind, weight in self.clause(TOKEN.findall(low[begin:done])).items():
                out[self._kinds[kind]] += weight
        return out

    def score(self, matched: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(np.log1p(matched) @ self.weights + self.bias)))


def seed_stems() -> dict[str, tuple[str, float]]:
    return {w + "$": ("insult", 1.0) for w in INSULTS} | {w + "$": ("threat", 1.0) for w in THREATS}


def _stem_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(stem, toxic texts, other texts, bits of the words before it in toxic texts, toxic texts
    in which a target follows) of a partition."""
    n: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
    targets = set(TARGETS)
    grammatical = targets.union(NEGATIONS, REPORTS)
    for b in batches:
        for text, toxic in zip(as_texts(b["t"]), b["toxic"]):
            tokens = TOKEN.findall((text or "").lower())
            own: dict[str, int] = {}
            aimed: set[str] = set()
            before = ""
            for i, t in enumerate(tokens):
                if len(t) >= 3 and t not in grammatical:
                    bit = 1 << (hash_of(before) % 63)
                    if toxic and not targets.isdisjoint(tokens[i + 1 : i + 1 + BACK_THREAT]):
                        aimed.update((t + "$", *(t[:size] for size in STEMS if size <= len(t))))
                    own[t + "$"] = own.get(t + "$", 0) | bit
                    for size in STEMS:
                        if size > len(t):
                            break
                        own[t[:size]] = own.get(t[:size], 0) | bit
                before = t
            for stem, bits in own.items():
                x = n[stem]
                x[0 if toxic else 1] += 1
                if toxic:
                    x[2] |= bits
                    x[3] += stem in aimed
        if len(n) > 400_000:
            yield _frame(n)
            n.clear()
    if n:
        yield _frame(n)


def hash_of(word: str) -> int:
    """The same in every process."""
    h = 0
    for c in word:
        h = (h * 31 + ord(c)) & 0x7FFFFFFF
    return h ^ (h >> 7)


def _frame(n: dict[str, list[int]]) -> pd.DataFrame:
    return pd.DataFrame([(k, *v) for k, v in n.items()], columns=["stem", "yes", "no", "bits", "aimed"])


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """Stems and match weights from labelled rows; the seed grammar where there are none.

    At most about `rows` rows are read for fitting, by hash of the text, so that copies of one
    text count once. A stem is learned if it occurs in SUPPORT toxic texts after CONTEXTS
    different words with log-odds of ODDS, not being a word of the grammar, as a threat if targets mostly follow it, else as an
    insult; only the shortest such stem of a word is kept. Their number is bounded by the sample.
    """
    picked = labelled.select(labelled[text_col].alias("t"), labelled[label_col].cast("int").alias("toxic")).filter("toxic in (0, 1) and t is not null")
    n = picked.count()
    draw = F.pmod(F.xxhash64("t", F.lit("toxic")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = picked.filter(draw < min(1.0, rows / max(n, 1))).dropDuplicates(["t"])
    base = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    yes, no = base.get(1, 0), base.get(0, 0)
    stems = seed_stems()
    if not yes or not no:
        return Model(stems)
    counts = sample.mapInPandas(_stem_counts, "stem string, yes long, no long, bits long, aimed long").groupBy("stem").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"), F.bit_count(F.bit_or("bits")).alias("contexts"), F.sum("aimed").alias("aimed"))
    odds = F.log((F.col("yes") + 0.5) / (yes + 1)) - F.log((F.col("no") + 0.5) / (no + 1))
    strong = counts.withColumn("odds", odds).filter((F.col("yes") >= SUPPORT) & (F.col("contexts") >= CONTEXTS) & (F.col("odds") >= ODDS))
    learned: dict[str, tuple[str, float]] = {}
    for r in sorted(strong.collect(), key=lambda r: (len(r["stem"]), r["stem"])):
        bare = r["stem"].rstrip("$")
        if not any(bare[:k] in learned for k in STEMS if k <= len(bare)):
            learned[r["stem"]] = ("threat" if r["aimed"] >= AIMED * r["yes"] else "insult", min(2.0, r["odds"] / 4))
    stems |= {s: c for s, c in learned.items() if s.rstrip("$") + "$" not in stems}
    model = Model(stems)
    kinds = len(KINDS)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array([model.matches(t) for t in as_texts(b["t"])]).reshape(-1, kinds)
            yield pd.DataFrame(x, columns=[f"x{i}" for i in range(kinds)]).assign(toxic=b["toxic"].to_numpy())

    fields = ", ".join(f"x{i} double" for i in range(kinds))
    names = [f"x{i}" for i in range(kinds)]
    # texts alike in all their matches count as one row with a weight
    alike = sample.mapInPandas(features, f"{fields}, toxic int").groupBy(*[F.round(c, 1).alias(c) for c in names], "toxic").count().toPandas()
    model.weights, model.bias = _logistic(np.log1p(alike[names].to_numpy(dtype=float)), alike["toxic"].to_numpy(dtype=float), alike["count"].to_numpy(dtype=float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights by Newton steps, drawn towards those of KINDS, never below zero."""
    x = np.column_stack((x, np.ones(len(x))))
    prior = np.array([*KINDS.values(), -3.5])
    pull = np.full(len(prior), PULL)
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - y)) + pull * (w - prior)
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(curve, gradient)
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return np.maximum(w[:-1], 0), float(w[-1])


def score_documents(docs: DataFrame, model: Model, carry: list[str], text_col: str = "text", cut: float = 0.7) -> DataFrame:
    """The columns `carry` of docs with score, predicted and the summed weight of each match kind.

    No shuffle; null and empty texts have no match and get the score of such texts; repeated rows
    are each scored; an empty table gives no rows.
    """
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    extra = ["insults", "threats", "mitigated"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array([model.matches(t) for t in as_texts(b["__text"])]).reshape(-1, len(KINDS))
            s = model.score(x)
            yield b.drop(columns="__text").assign(score=s, predicted=(s >= cut).astype(np.int32), insults=x[:, :2].sum(axis=1), threats=x[:, 4:6].sum(axis=1), mitigated=x[:, [2, 3, 6, 7]].sum(axis=1))

    picked = docs.select(*carry, docs[text_col].alias("__text"))
    return picked.mapInPandas(run, f"{fields}, score double, predicted int, " + ", ".join(f"{c} double" for c in extra))
