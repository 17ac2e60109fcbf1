"""Exact quantiles against sorted values, and sets over arrays of scenes."""

import math
import random

from pyspark.sql import functions as F

from takeledger.operators.analytics import spread
from takeledger.operators.quantiles import exact_quantiles, with_quantiles

SHARES = {"low": 0.0, "half": 0.5, "most": 0.9, "top": 1.0}


def by_hand(values, p):
    values = sorted(values)
    place = (len(values) - 1) * p
    a, b = math.floor(place), math.ceil(place)
    return values[a] * (1 - (place - a)) + values[b] * (place - a) if a != b else values[a]


def test_quantiles_equal_sorted_values(spark):
    r = random.Random(7)
    groups = {
        "even": [float(i) for i in range(1000)], "ties": [5.0] * 300 + [-5.0] * 299, "one": [3.25], "two": [-1.5, 2.5],
        # a node of the tree with all its values, near values in one leaf, values beyond a long's digits
        "wide": [r.uniform(-1e9, 1e9) for _ in range(3000)], "near": [1 + i * 1e-9 for i in range(200)], "far": [1e300, -1e300, 2e300, 0.0, 9e12, 1e13],
        "hot": [r.randrange(100_000) / 7 for _ in range(40_000)], None: [r.gauss(0, 1) for _ in range(501)],
    }
    rows = [(k, 1, v) for k, vs in groups.items() for v in vs] + [("hollow", 1, None), ("even", 2, 4.0), ("even", None, 6.0)]
    df = spark.createDataFrame(rows, "name string, n int, v double")
    got = {(x.name, x.n): x for x in exact_quantiles(df, ["name", "n"], F.col("v"), SHARES).collect()}
    assert set(got) == {(k, 1) for k in groups} | {("even", 2), ("even", None)}
    for k, vs in groups.items():
        for share, p in SHARES.items():
            assert math.isclose(got[k, 1][share], by_hand(vs, p), rel_tol=1e-12, abs_tol=1e-15), (k, share)
    assert got["even", 2].half == 4.0 and got["even", None].half == 6.0
    totals = df.groupBy("name", "n").agg(F.count("*").alias("rows"))
    beside = {(x.name, x.n): x for x in with_quantiles(totals, df, ["name", "n"], F.col("v"), {"half": 0.5}).collect()}
    assert len(beside) == len(groups) + 3 and beside["hollow", 1].half is None and beside[None, 1].half == got[None, 1].half
    assert exact_quantiles(df.limit(0), ["name"], F.col("v"), SHARES).count() == 0


def test_quantiles_hold_no_group(spark):
    """Every window sorts the children of one node; the rows are grouped by value before they move."""
    df = spark.range(100).select(F.lit(1).alias("g1"), F.col("id").cast("double").alias("v"))
    plan = exact_quantiles(df, ["g1"], F.col("v"), {"half": 0.5})._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "collect" not in plan


def test_spread_keeps_every_row_once(spark):
    df = spark.createDataFrame([("a", ["1", "2"], ["x"]), ("a", [], []), ("a", ["2"], ["x", "y", "z"]), ("b", None, ["q"])], "k string, d array<string>, e array<string>")
    got = spread(df, "d", "e").groupBy("k").agg(F.count_if("once").alias("n"), F.sort_array(F.collect_set("d")).alias("d"), F.sort_array(F.collect_set("e")).alias("e"))
    assert {x.k: (x.n, x.d, x.e) for x in got.collect()} == {"a": (3, ["1", "2"], ["x", "y", "z"]), "b": (1, [], ["q"])}
