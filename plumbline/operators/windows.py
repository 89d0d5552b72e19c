"""Series and ranks within groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lag_check(df: DataFrame, keys: Sequence[str], period: str, value: str, found, strict: bool = False) -> DataFrame:
    """Rows where found(previous, value) holds; previous is the row before, or with strict that of the period before."""
    w = Window.partitionBy(*keys).orderBy(period)
    out = df.withColumns({"previous": F.lag(value).over(w), "_gap": F.col(period) - F.lag(period).over(w)})
    out = out.where(F.col("_gap") == 1) if strict else out
    return out.where(found(F.col("previous"), F.col(value))).drop("_gap")


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def latest_value(df: DataFrame, key: str, period: str, value: str) -> DataFrame:
    """Per key the last period that has a value; one aggregate."""
    return df.where(F.col(value).isNotNull()).groupBy(key).agg(F.max(period).alias(period), F.max_by(value, period).alias(value))


def percentile_below(df: DataFrame, cohort: Sequence[str], column: str, digits: int = 1) -> DataFrame:
    """Share of the cohort strictly below, in percent: (rank - 1) / size * 100; rows without a value are left out.

    Values are counted first, so what one task ranks is a cohort's distinct
    values, not its rows.
    """
    there = df.where(F.col(column).isNotNull())
    counts = there.groupBy(*cohort, column).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*cohort)
    placed = counts.withColumns({"_below": F.sum("_c").over(w.orderBy(column)) - F.col("_c"), "cohort_size": F.sum("_c").over(w)})
    percentile = F.bround(F.col("_below").cast("double") / F.col("cohort_size") * 100, digits).alias("percentile")
    return there.join(placed.drop("_c"), [*cohort, column]).select(*df.columns, percentile, "cohort_size")


def index_to_base(df: DataFrame, entity: str, period: str, value: str) -> DataFrame:
    """Values in percent of a base: that of the first period in which every entity has one, else the entity's own first."""
    there = df.where(F.col(value).isNotNull())
    size = df.agg(F.count_distinct(entity).alias("_k"))
    common = there.groupBy(period).agg(F.count_distinct(entity).alias("_n")).join(F.broadcast(size)).where("_n = _k").agg(F.min(period).alias("_base"))
    bases = there.join(F.broadcast(common)).groupBy(entity).agg(
        F.coalesce(F.max(F.when(F.col(period) == F.col("_base"), F.col(value))), F.min_by(value, period)).alias("base"), F.coalesce(F.max("_base"), F.min(period)).alias("base_period")
    )
    return df.join(bases, entity, "left").withColumn("indexed", F.when(F.col("base") != 0, F.col(value).cast("double") / F.col("base") * 100))


def change_between(df: DataFrame, entity: str, period: str, value: str, start: int, end: int) -> DataFrame:
    """Absolute and percent change between two periods; null unless both have a value."""
    at = lambda y: F.max(F.when(F.col(period) == y, F.col(value)))
    out = df.groupBy(entity).agg(at(start).alias("start"), at(end).alias("end"))
    return out.withColumns({"change": F.col("end") - F.col("start"), "percent": F.when(F.col("start") != 0, (F.col("end") - F.col("start")).cast("double") / F.abs("start") * 100)})


def first_last_change(df: DataFrame, entity: str, period: str, value: str) -> DataFrame:
    out = df.where(F.col(value).isNotNull()).groupBy(entity).agg(F.min_by(value, period).alias("first"), F.max_by(value, period).alias("last"))
    return out.withColumn("change", F.col("last") - F.col("first"))


def islands(df: DataFrame, entity: str, period: str, value: str) -> DataFrame:
    """Runs of consecutive rows with a value: a row a run with its begin, end and points; gaps are never filled."""
    w = Window.partitionBy(entity).orderBy(period)
    out = df.withColumn("_gaps", F.sum(F.when(F.col(value).isNull(), 1).otherwise(0)).over(w)).where(F.col(value).isNotNull())
    return out.groupBy(entity, "_gaps").agg(F.min(period).alias("begin"), F.max(period).alias("end"), F.count("*").alias("points")).drop("_gaps")


def page(df: DataFrame, sort: str, descending: bool, number: int, size: int, allowed: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """One page of a sorted listing with total and pages; nulls last in both directions, ties by other columns."""
    if sort not in allowed:
        raise ValueError(f"cannot sort by {sort}")
    total = df.agg(F.count("*").alias("total_rows"))
    order = F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort)
    return df.orderBy(order, *ties).offset((number - 1) * size).limit(size).join(F.broadcast(total)).withColumn("pages", F.ceil(F.col("total_rows") / size))


def relevance(df: DataFrame, query: str, id_col: str, name_col: str, most: int) -> DataFrame:
    """Hits by exact id, exact name, part of the name, then shorter names first."""
    q = query.lower()
    name, i = F.lower(name_col), F.lower(F.col(id_col).cast("string"))
    rank = F.when(i == q, 0).when(name == q, 1).otherwise(2)
    return df.where((i == q) | name.contains(q)).withColumn("relevance", rank).orderBy("relevance", F.length(name_col), id_col).limit(most)
