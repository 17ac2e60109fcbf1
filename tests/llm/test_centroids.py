import hashlib
import math

import numpy as np

from takeledger.llm import centroids as c


def brute(rows, width, k, rounds):
    xs = [(i, [math.floor(256 * v) for v in vec]) for i, vec in rows]
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), x) for i, x in xs if i is not None)
    at = [x for _, x in start[:k]]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    near = lambda x: min((far(x, y), j) for j, y in enumerate(at))
    for _ in range(rounds):
        groups = {}
        for _, x in xs:
            groups.setdefault(near(x)[1], []).append(x)
        at = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if j in groups else y for j, y in enumerate(at)]
    found = [(i, *near(x)) for i, x in xs]
    inertia = {}
    for _, d, j in found:
        inertia[j] = inertia.get(j, 0) + d
    whole = sum(inertia.values())
    fits = lambda v: v if v < 2**63 else None
    return sorted(((i, j, fits(d), fits(inertia[j]), fits(whole), hashlib.sha256(",".join(map(str, at[j])).encode()).hexdigest()) for i, d, j in found), key=str)


def test_threshold_walk_equals_all_distances():
    rng = np.random.default_rng(7)
    for width, k, spread in ((1, 5, 3), (3, 40, 4), (8, 17, 50), (2, 1, 9)):
        x, at = rng.integers(-spread, spread, (500, width)), rng.integers(-spread, spread, (k, width))
        all_ = ((x[:, None] - at[None]) ** 2).sum(axis=2)
        number, far, taken = c.nearest(x, c.Lists(at))
        assert (far == all_.min(axis=1)).all() and (number == all_.argmin(axis=1)).all() and taken <= all_.size
    few = c.nearest(rng.integers(-50, 50, (500, 2)), c.Lists(rng.integers(-50, 50, (200, 2))))[2]
    assert few < 0.5 * 500 * 200  # in few dimensions the walk ends early


def test_rows_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((260, 6)))] + [(i, [0.25] * 6) for i in range(1000, 1130)]
    rows += [(7, [0.5] * 6), (None, [1.0] * 6), (None, [1.0] * 6)]
    odd = [(5001, None), (5002, []), (5003, [None] * 6), (5004, [float("nan")] + [1.0] * 5), (5005, [float("inf")] + [1.0] * 5), (5006, [1.0] * 5), (5007, [1.0] * 7)]
    df = spark.createDataFrame([(k, v, 3, "x") for k, v in rows + odd], "vec_id long, embedding array<double>, cluster int, k string")
    got = sorted((tuple(r) for r in c.clustered(df, width=6, centroids=9, rounds=4).collect()), key=str)
    assert got == brute(rows, 6, 9, 4)


def test_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    empty = c.clustered(spark.createDataFrame([], schema))
    assert empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and empty.count() == 0
    for rows in ([(1, [0.5, 0.5]), (2, [0.1, 0.5])], [(i, [1.0, 1.0]) for i in range(9)], [(i, [(-1) ** i * 1e15 * i, 2.0]) for i in range(30)]):
        got = sorted((tuple(r) for r in c.clustered(spark.createDataFrame(rows, schema), width=2, centroids=5, rounds=3).collect()), key=str)
        assert got == brute(rows, 2, 5, 3)
