import math

import numpy as np
import pytest

from takeledger.llm import whitening as w


def exact(v):
    values, vectors = np.linalg.eigh(v)
    return values[::-1], vectors[:, ::-1]


@pytest.mark.parametrize("spectrum", [
    [9, 7, 5, 3, 1, 0.5], [5, 5, 5, 2, 1, 0], [4, 4 - 1e-6, 4 - 2e-6, 4 - 3e-6, 1, 1], [1, 1, 1, 1, 1, 1],
    [1e6, 1, 1e-6, 1e-9, 0, 0], [3, 3 * (1 - 1e-15), 2, 1, 1, 1], [0, 0, 0, 0, 0, 0], [1e-200, 1e-201, 0, 0, 0, 0],
])
def test_pairs_of_a_spectrum(spectrum):
    q = np.linalg.qr(np.random.default_rng(4).standard_normal((6, 6)))[0]
    v = (q * spectrum) @ q.T
    v = (v + v.T) / 2
    values, vectors = w.leading_pairs(v, 4)
    assert np.allclose(values, exact(v)[0][:4], rtol=0, atol=1e-14 * max(spectrum[0], 1e-300))
    assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-12
    assert np.abs(v @ vectors - vectors * values).max() <= 2e-14 * max(spectrum[0], 1e-300)


def test_counts_are_of_eigenvalues_above():
    rng = np.random.default_rng(5)
    for n in (1, 2, 5, 17):
        a = rng.standard_normal((n, n))
        a = a + a.T
        values = np.linalg.eigvalsh(a)
        for shift in [*(values[:-1] + values[1:]) / 2, values[0] - 1, values[-1] + 1, 0.0]:
            assert w.count_above(a, shift) == (values > shift).sum()
    assert w.count_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1  # no pivot on the diagonal
    assert w.count_above(np.zeros((3, 3)), 0.0) == 0


def brute(rows, components=4):
    """Rows (id, vector) of one width to {(id, component): (n, deviation, |whitened|, explained)}."""
    xs = [(k, [math.floor(256 * c) for c in v]) for k, v in rows]
    fit = sorted({tuple(x) for _, x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, dtype=float) - np.array([s / n for s in sums])
    values, vectors = exact(centred.T @ centred / n)
    out = {}
    for k, x in xs:
        for c in range(min(components, len(x))):
            flat = (np.array(x, dtype=float) - np.array([s / n for s in sums])) @ vectors[:, c]
            out[k, c + 1] = (n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), abs(flat) / math.sqrt(values[c]), values[c] / values.sum())
    return out


def test_rows_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((300, 12)) * np.linspace(2, 0.2, 12)
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[3].tolist()) for i in range(150)]
    odd = [(5001, None), (5002, []), (5003, [None] * 12), (5004, [float("nan")] + [1.0] * 11), (5005, [float("-inf")] + [1.0] * 11), (5006, [1.0] * 3)]
    df = spark.createDataFrame([(k, v, 1.5, 2) for k, v in rows + odd], "vec_id long, embedding array<double>, whitened double, n int")
    got, want = w.whitened(df).collect(), brute(rows)
    assert len(got) == len(want) and {(r.vec_id, r.component) for r in got} == set(want)
    signs = {}
    for r in got:
        n, deviation, white, explained = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(abs(r.whitened) - white) < 1e-9 and abs(r.explained - explained) < 1e-9 * explained and r.identity_error < 1e-9
    assert signs == {}


def test_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    empty = w.whitened(spark.createDataFrame([], schema))
    assert empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and empty.count() == 0
    alike = w.whitened(spark.createDataFrame([(None, [1.0, 2.0]), (1, [1.0, 2.0])], schema)).collect()
    assert len(alike) == 4 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, None, None) for r in alike)
    line = w.whitened(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], schema)).collect()
    assert all((r.whitened is None) == (r.component == 2) and r.identity_error < 1e-12 for r in line)
    huge = w.whitened(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert len(huge) == 6 and all(r.deviation is None for r in huge if r.vec_id < 3)


def test_deviation_at_the_end_of_long():
    for x, n, s in (([3037000499, 0], 1, [0, 0]), ([3037000500, 0], 1, [0, 0]), ([2**62, 5], 3, [0, 7]), ([-(2**63), 0], 2, [-(2**64), 0])):
        exact_sum = sum((n * a - b) ** 2 for a, b in zip(x, s))
        assert w.deviations(np.array([x], dtype=np.int64), n, s) == [exact_sum if exact_sum < 2**63 else None]
