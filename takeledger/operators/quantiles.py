"""Exact quantiles of groups of any size: counts in a tree of value digits, walked from the top."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Binary digits a level of the tree tells apart, and its levels: together the 64 of a long.
DIGITS, LEVELS = 16, 4
#: Values are told apart by the tree to this part of their unit, then by themselves.
PARTS = 1_000_000


def _digits(value: Column) -> Column:
    """A long that grows with the value; what is too large for it shares the last one."""
    return F.floor(F.greatest(F.least(value * PARTS, F.lit(9e18)), F.lit(-9e18))).cast("long")


def exact_quantiles(rows: DataFrame, by: list[str], value: Column, shares: dict[str, float]) -> DataFrame:
    """(by, one column a share): quantiles of the groups' values, interpolated between two of them.

    Groups may hold any number of different values and null in their keys; null values don't count,
    and groups without values have no row. Equal values are counted first. Each level of the tree
    has the counts of the level below by its leading digits, so that a node has at most 2^16
    children; a rank is then found level by level among the children of one node. No task holds
    more than those, whatever the group's size: only durations that differ by less than a
    millionth of the unit share a leaf.
    """
    group = F.struct(*by).alias("g")
    each = rows.select(group, value.cast("double").alias("v")).filter("v is not null").groupBy("g", "v").agg(F.count("*").alias("n"))
    levels = [each.withColumn("node", _digits(F.col("v")))]
    for _ in range(LEVELS - 1):
        levels.append(levels[-1].groupBy("g", F.shiftright("node", DIGITS).alias("node")).agg(F.sum("n").alias("n")))
    place = lambda p: (F.col("total") - 1) * F.lit(float(p))
    sides = [F.struct(F.lit(name).alias("share"), side(place(p)).cast("long").alias("rank"), F.lit(i).alias("side"), (place(p) - F.floor(place(p))).alias("part")) for name, p in shares.items() for i, side in enumerate((F.floor, F.ceil))]
    sought = levels[-1].groupBy("g").agg(F.sum("n").alias("total")).select("g", F.inline(F.array(*sides)))
    for depth, level in enumerate(reversed(levels)):
        on = ["g", "above"] if depth else ["g"]
        order = ["node", "v"] if depth == LEVELS - 1 else ["node"]
        met = sought.join(level.withColumn("above", F.shiftright("node", DIGITS)) if depth else level, on)
        upto = F.sum("n").over(Window.partitionBy("g", "share", "side").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        met = met.withColumn("before", upto - F.col("n")).filter("before <= rank and rank < before + n")
        sought = met.select("g", "share", "side", "part", (F.col("rank") - F.col("before")).alias("rank"), F.col("node").alias("above"), *order[1:])
    at = lambda name, side: F.max(F.when((F.col("share") == name) & (F.col("side") == side), F.col("v")))
    part = lambda name: F.max(F.when(F.col("share") == name, F.col("part")))
    found = sought.groupBy("g").agg(*[F.when(part(name) == 0, at(name, 0)).otherwise(at(name, 0) * (1 - part(name)) + at(name, 1) * part(name)).alias(name) for name in shares])
    return found.select("g.*", *shares)


def with_quantiles(totals: DataFrame, rows: DataFrame, by: list[str], value: Column, shares: dict[str, float]) -> DataFrame:
    """Aggregates of groups with their quantiles beside them; null where a group has no value."""
    key = F.struct(*by)
    found = exact_quantiles(rows, by, value, shares).select(key.alias("g"), *shares)
    return totals.withColumn("g", key).join(found, "g", "left").drop("g")
