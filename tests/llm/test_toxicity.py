import random

from pyspark.sql import functions as F

from takeledger.llm import toxicity
from takeledger.llm.common import remainder


def test_composed_grammar_tells_kinds_apart():
    m = toxicity.Model(toxicity.seed_stems())
    kinds = list(toxicity.KINDS)

    def of(text):
        return {kinds[i] for i, x in enumerate(m.matches(text)) if x}

    assert of("You are an idiot.") == {"targeted insult"}
    assert of("What a clown!") == {"insult"}
    assert of("He is not stupid") == {"negated insult"}
    assert of("the critic said you are an idiot") == {"reported insult"}
    assert of("he said nothing. What a loser") == {"insult"}
    assert of("we will kill it") == {"targeted threat"}
    assert of("closer clowns") == set() and of(None) == of("") == of("...") == set()


def table(spark):
    rows = []
    for i in range(600):
        bad = i % 4 == 0
        words = [f"w{(i * 31 + j * j * 17) % 211}x".replace("0", "o") for j in range(30)]
        words = ["".join(chr(97 + (ord(c) * 7 + j) % 26) for c in w) for j, w in enumerate(words)]
        if bad:
            words.insert(i % 29, f"grunk{'abcde'[i % 5]}")
        rows.append((i, " ".join(words), int(bad), "x"))
    rows += [(1000, None, 1, "x"), (1001, "", 0, None), (1002, "grunka " * 30000, None, None), (1002, "grunka " * 30000, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int, score string")


def test_learned_stems_and_held_out_rows(spark):
    docs = table(spark).withColumn("held_out", remainder(F.col("doc_id"), 3) == 1)
    model = toxicity.fit(docs.filter("not held_out"))
    assert any(s.startswith("grun") for s in model.stems)
    got = toxicity.score_documents(docs.drop("toxic"), model, ["doc_id", "held_out"]).join(docs.select("doc_id", "toxic").distinct(), "doc_id").collect()
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert sum(r.predicted == r.toxic for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[1000].predicted == by[1001].predicted == 0 and by[1000].score == by[1001].score
    assert sum(r.doc_id == 1002 for r in got) == 2 and by[1002].predicted == 1


def test_without_labels(spark):
    docs = table(spark)
    model = toxicity.fit(docs.withColumn("toxic", F.lit(None).cast("int")))
    got = {r.doc_id: r for r in toxicity.score_documents(spark.createDataFrame([(1, "you are an idiot"), (2, "fine words")], "doc_id long, text string"), model, ["doc_id"]).collect()}
    assert got[1].predicted == 1 and got[2].predicted == 0
    assert toxicity.score_documents(docs.limit(0), model, ["doc_id"]).count() == 0


def direct(m, tokens):
    """What the composed machines should find, said without states."""
    classes = {w: c for c, words in (("target", toxicity.TARGETS), ("negation", toxicity.NEGATIONS), ("report", toxicity.REPORTS)) for w in words}
    found = {}
    for i, t in enumerate(tokens):
        hit = m.entry(t)
        if not hit:
            continue
        kind, weight = hit
        target = lambda ts: any(m.entry(x) is None and classes.get(x) == "target" for x in ts)
        back = toxicity.BACK_INSULT if kind == "insult" else toxicity.BACK_THREAT
        label = f"targeted {kind}" if target(tokens[max(0, i - toxicity.AHEAD) : i]) or target(tokens[i + 1 : i + 1 + back]) else kind
        near = tokens[max(0, i - toxicity.NEGATED) : i]
        near = near[max((k + 1 for k, x in enumerate(near) if x == ","), default=0) :]
        if any(classes.get(x) == "negation" for x in near):
            label = f"negated {kind}"
        else:
            inside = told = False
            for x in tokens[:i]:
                if x == '"' and not told:
                    inside = not inside
                elif classes.get(x) == "report" and not inside:
                    told = True
            if inside or told:
                label = f"reported {kind}"
        found[label] = max(found.get(label, 0.0), weight)
    return found


def test_machines_equal_the_direct_reading():
    m = toxicity.Model(toxicity.seed_stems() | {"grunk": ("insult", 1.7)})
    rng = random.Random(2)
    words = ["you", "he", "not", "never", "said", '"', ",", "idiot", "grunks", "kill", "the", "of", "stone"]
    for _ in range(4000):
        tokens = [rng.choice(words) for _ in range(rng.randint(0, 14))]
        assert m.clause(tokens) == direct(m, tokens), tokens


def test_targets_behind_and_quotes():
    m = toxicity.Model(toxicity.seed_stems())
    of = lambda text: set(m.clause(toxicity.TOKEN.findall(text.lower())))
    assert of("what an idiot you are") == {"targeted insult"}
    assert of("they will hurt all of you") == {"targeted threat"}
    assert of('"You are an idiot", she told them') == {"reported insult"}
    assert of("no, you idiot") == {"targeted insult"}


def test_negation_and_report_flip_decisions(spark):
    """Labels that follow the clause, not the word: the word alone would be wrong on a third."""
    rng = random.Random(9)
    fill = lambda n: " ".join(f"{rng.choice('bcdfgk')}o{rng.choice('lmnprt')}{rng.choice('aeiou')}" for _ in range(n))
    shapes = [("you are {} blorg", 1), ("{} zarg you all", 1), ("we {} walk", 0), ("{} and so on", 0), ("it {} rains", 0), ("so {} it goes", 0), ("that {} is all", 0), ("there {} we were", 0)]
    mild = [("you are not {} blorg", 0), ("she said you are {} blorg", 0), ("never {} zarg you", 0)]
    rows = []
    for i in range(3000):
        shape, toxic = rng.choice(mild) if i % 60 == 0 else rng.choice(shapes)
        rows.append((i, f"{fill(6)}. {shape.format(fill(1))}. {fill(4)}.", toxic))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert {model.entry("blorg")[0], model.entry("zarg")[0]} == {"insult", "threat"}
    asked = ["you are a blorg", "you are not a blorg", "she said you are a blorg", "zarg you all", "never zarg you", "they are stones"]
    got = {r.doc_id: r.predicted for r in toxicity.score_documents(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model, ["doc_id"]).collect()}
    assert [got[i] for i in range(6)] == [1, 0, 0, 1, 0, 0]
