import hashlib
import random

import numpy as np

from takeledger.llm import suffix_dedup as sd


def brute(rows):
    first = {}
    raws = [(d, (t or "").encode()) for d, t in rows]
    for d, raw in raws:
        if d is not None:
            for i in range(len(raw) - 49):
                s = raw[i : i + 50]
                first[s] = min(d, first.get(s, d))
    out = []
    for d, raw in raws:
        gone = np.zeros(len(raw), dtype=bool)
        if d is not None:
            for i in range(len(raw) - 49):
                if first[raw[i : i + 50]] < d:
                    gone[i : i + 50] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((d, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(rng.randint(5, 30)) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [text(rng.randint(0, 20))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            cut = rng.randint(0, len(s) // 2)
            parts += [s[cut : cut + rng.randint(30, 120)], text(rng.randint(0, 6))]
        rows.append((rng.randint(-50, 400), "".join(parts)))
    rows += [(500 + i, rows[3][1]) for i in range(20)]
    rows += [(600, "a" * 49), (601, "a" * 50), (602, "a" * 4000), (603, "ab" * 40), (604, "ab" * 30), (605, None), (606, ""), (None, rows[3][1]), (607, "\x00" * 60), (608, "x" + "\x00" * 60)]
    rows += [(700, rows[5][1]), (700, rows[5][1]), (701, "long words " * 20000), (702, "more long words " * 300)]
    return rows


def test_equals_brute_force(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, n_bytes string").repartition(5)
    want = brute(rows)
    got = sd.without_repeats(df).collect()
    assert sorted((tuple(r) for r in got), key=str) == want


def test_many_small_runs():
    rng = random.Random(1)
    runs = []
    for _ in range(7):
        rows = sorted(bytes(rng.choice(b"ab") for _ in range(12)) + bytes(sd.WIDTH - 12) for _ in range(rng.randint(0, 40)))
        common = [0] + [next((i for i in range(sd.WIDTH) if a[i] != b[i]), sd.WIDTH) for a, b in zip(rows, rows[1:])]
        runs.append((rows, common))
    which, place, common = sd.merged([(b"".join(r), bytes(c) if r else b"") for r, c in runs])
    out = [runs[w][0][p] for w, p in zip(which, place)]
    assert out == sorted(x for r, _ in runs for x in r)
    assert common.tolist()[1:] == [next((i for i in range(sd.WIDTH) if a[i] != b[i]), sd.WIDTH) for a, b in zip(out, out[1:])]


def test_front_coding_round_trip():
    rng = np.random.default_rng(3)
    rows = np.unique(rng.integers(0, 2, (500, sd.WIDTH)).astype(np.uint8), axis=0)
    docs = np.arange(len(rows)) - 7
    many = docs % 3 == 0
    back, _, d, m = sd.unfolded(sd.front_coded(rows, docs, many))
    assert (back == rows).all() and (d == docs).all() and (m.astype(bool) == many).all()


def test_empty(spark):
    assert sd.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_equal_hashes_of_different_rows_do_no_harm(monkeypatch, tmp_path):
    import pandas as pd

    monkeypatch.setattr(sd, "row_hashes", lambda rows: rows[:, 0].astype(np.uint64) % np.uint64(2))
    rows = [r for r in corpus()[:90] if r[0] is not None]
    frame = pd.DataFrame(rows, columns=["k", "t"])
    folder, parts = str(tmp_path), 3

    def through(run, batches):
        out = pd.concat(list(run(iter(batches))))
        return out.sort_values("part", kind="stable") if "part" in out else out

    through(sd._shared_grams(folder), [through(sd._gram_runs(parts), [frame])])
    through(sd._merged_parts(folder), [through(sd._suffix_runs(folder, parts), [frame])])
    got = through(sd._cleaned(folder, parts, False), [frame])
    assert sorted(map(tuple, got.itertuples(index=False)), key=str) == brute(rows)


def test_grams_spread_evenly_over_parts():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 123, 400_000).astype(np.uint8)
    _, h = sd.anchors(data, np.array([0, len(data)]))
    counts = np.bincount(sd.range_part(sd.short(h), 64), minlength=64)
    assert counts.min() > 0 and counts.max() < 1.5 * counts.mean()
