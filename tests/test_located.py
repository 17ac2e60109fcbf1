"""Passages against brute force: windows, weights and ties."""

import random
import re

from takeledger.functions import normalize as n
from takeledger.operators import script
from takeledger.plans import registry
from takeledger.sources.adapters import frame


def terms_of(line):
    words = [w.lower().replace("’", "'").strip("'-") for w in re.findall(r"[A-Za-z][A-Za-z'’-]{2,}", line or "")]
    return {w for w in words if len(w) >= 3 and w not in {*n.COMMON_WORDS, *n.LOG_SHORTHAND}}


def brute(lines, wanted):
    """lines: (script, scene, place, line); wanted: {(query, script): terms}."""
    scenes = {}
    for s, c, p, t in lines:
        scenes.setdefault((s, c), {}).setdefault(p, set()).update(terms_of(t))
    out = set()
    for (q, s), terms in wanted.items():
        best = None
        for (s2, c), per in scenes.items():
            if s2 != s:
                continue
            spread = {w: sum(w in t for t in per.values()) for w in terms}
            for size in (1, 2, 3):
                for start in range(min(per), max(per) - size + 2):
                    found = set().union(*(per.get(start + k, set()) for k in range(size))) & terms
                    weight = round(sum(1 / spread[w] for w in found), 6)
                    if weight >= 1.0 and (best is None or (-weight, size, c, start) < best):
                        best = (-weight, size, c, start)
        if best:
            out.add((q, s, best[2], best[1], best[3], -best[0]))
    return out


def rows(df):
    got = [(r.query, r.script_id, r.scene, r.size, r.start, round(r.weight, 6)) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_located_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [a + b for a in ("lamp", "door", "river", "storm") for b in ("ab", "cd", "ef", "gh")]
    # the same scene numbers in both scripts, and the same queries asked of both
    lines = [(s, c, p, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 5)))) for s in ("A", "B") for c in range(1, 7) for p in range(rng.randint(1, 9))]
    wanted = {(f"q{i}", s): set(rng.sample(vocabulary, rng.randint(1, 9))) for i in range(40) for s in ("A", "B")}
    df = spark.createDataFrame(lines, "script_id string, scene int, place int, line string")
    terms = spark.createDataFrame([(q, s, t) for (q, s), ts in wanted.items() for t in ts], "query string, script_id string, term string")
    want = brute(lines, wanted)
    assert len(want) > 40 and {w[3] for w in want} == {1, 2, 3}
    assert rows(script.located(df, terms)) == want
    assert script.located(df.limit(0), terms).count() == 0


def test_query_asks_for_every_line_with_all_terms(spark):
    d = "/root/testdata/sf0.001"
    lines = [tuple(r) for r in frame(spark, d, "lines").select("script_id", "scene", "place", "line").collect()]
    wanted = {}
    for s, c, p, t in lines:
        wanted.setdefault((f"{c}:{p}", s), set()).update(terms_of(t))
    assert rows(registry.QUERIES["locate_passages"](spark, d)) == brute(lines, wanted)


def test_located_in_blocks_of_scenes_and_queries(spark, monkeypatch):
    """However scripts are dealt: long scenes, lines said twice, and terms that many scenes hold."""
    rng = random.Random(11)
    vocabulary = [a + b for a in ("lamp", "door", "river") for b in ("ab", "cd", "ef", "gh")]
    lines = [(s, c, p, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 6)))) for s in ("A", "B") for c in range(1, 12) for p in range(40 if c == 3 else rng.randint(1, 6))]
    lines += lines[:30]
    wanted = {(f"q{i}", s): set(rng.sample(vocabulary, rng.randint(1, 9))) for i in range(30) for s in ("A", "B", "C")}
    df = spark.createDataFrame(lines, "script_id string, scene int, place int, line string")
    terms = spark.createDataFrame([(q, s, t) for (q, s), ts in wanted.items() for t in ts], "query string, script_id string, term string")
    want = brute(lines, wanted)
    monkeypatch.setattr(script, "BLOCK_WORDS", 100)
    monkeypatch.setattr(script, "BLOCK_TERMS", 40)
    monkeypatch.setattr(script, "READ_FIRST", 1)
    assert len(want) > 40 and rows(script.located(df, terms)) == want
