"""Exact interpolated quantiles of groups of any size, by selection.

A first pass brackets each wanted rank by a sketch of fixed size; a second one
counts what lies below the bracket and, value by value, what lies inside.  So
no task holds a group's values: sketches and counts combine before they are
shuffled, and what is sorted in the end is the distinct values of a few
thousandths of a large group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The sketch's rank error is 1 / ACCURACY of a group; the bracket is REACH times that on either side.
ACCURACY = 10_000
REACH = 20
#: Groups of up to so many values are their own bracket.
SMALL = 10_000


def exact_quantiles(df: DataFrame, keys: Sequence[str], columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """keys, and for each column an array of its quantiles: at p (n - 1), between two values in proportion, as percentile() has them.

    Null values don't count; a column without values in a group has null.  Keys
    may be null or none; a group of the input is a row of the result.  NaN is
    greater than any number.
    """
    keys, shares = list(keys), [float(p) for p in shares]
    long = df.select(*keys, F.explode(F.array(*(F.struct(F.lit(k).alias("_column"), F.col(c).cast("double").alias("_value")) for k, c in enumerate(columns)))).alias("_x")).select(*keys, "_x.*")
    group = [*keys, "_column"]
    edge = REACH / ACCURACY
    points = [min(max(p + d, 0.0), 1.0) for p in shares for d in (-edge, edge)]
    v = F.col("_value")
    sketch = long.groupBy(*group).agg(F.count("_value").alias("_n"), F.min("_value").alias("_least"), F.max("_value").alias("_most"), F.percentile_approx("_value", F.array(*map(F.lit, points)), ACCURACY).alias("_s"))
    all_in = F.col("_n") <= SMALL
    # a null group stays in the array of brackets, so each row meets its group once
    bracket = lambda k: F.struct(F.lit(k).alias("share"), F.when(all_in, F.col("_least")).otherwise(F.col("_s")[2 * k]).alias("low"), F.when(all_in, F.col("_most")).otherwise(F.col("_s")[2 * k + 1]).alias("high"))
    brackets = sketch.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], "_n", F.array(*(bracket(k) for k in range(len(shares)))).alias("_b"))
    same = F.lit(True)
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    placed = long.where(v.isNotNull()).join(brackets, same).select(*group, "_n", v, F.explode("_b").alias("_b")).where(v <= F.col("_b.high"))
    # values below the bracket are one slot, null
    counts = placed.groupBy(*group, "_n", F.col("_b.share").alias("_share"), F.when(v >= F.col("_b.low"), v).alias("_slot")).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*group, "_share").orderBy(F.asc_nulls_first("_slot"))
    upto = F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    share = F.array(*map(F.lit, shares))[F.col("_share")]
    ranked = counts.withColumn("_upto", upto).withColumn("_at", share * (F.col("_n") - 1))
    holds = lambda rank: (F.col("_upto") > rank) & (F.col("_upto") - F.col("_c") <= rank)
    low, high = F.floor("_at"), F.ceil("_at")
    picked = ranked.groupBy(*group, "_share").agg(F.max("_at").alias("_at"), F.max(F.when(holds(low), F.col("_slot"))).alias("_l"), F.max(F.when(holds(high), F.col("_slot"))).alias("_h"))
    value = F.when(low == high, F.col("_l")).otherwise((high - F.col("_at")) * F.col("_l") + (F.col("_at") - low) * F.col("_h"))
    # a bracket that misses its rank would show as a null here; the sketch's error bound excludes it
    value = F.when(F.col("_l").isNull() | F.col("_h").isNull(), F.raise_error(F.lit("a quantile lies outside its bracket"))).otherwise(value)
    by = picked.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_share", value.alias("v")))).alias("_q"))
    per = by.groupBy(*keys).agg(*(F.max(F.when(F.col("_column") == k, F.transform("_q", lambda x: x["v"]))).alias(c) for k, c in enumerate(columns)))
    every = df.groupBy(*keys).agg(F.lit(1).alias("_one")).drop("_one") if keys else df.sparkSession.range(1).select()
    return null_safe_left(every, per, keys, list(columns))


def null_safe_left(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """left with the columns of right's row of the same keys, where nulls are alike."""
    if not keys:
        return left.join(right)
    other = right.select(*(F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)), *columns)
    same: Column = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_r{i}"))
    return left.join(other, same, "left").select(*left.columns, *columns)
