"""Grouped statistics; conditional ones in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import settled
from .quantiles import exact_quantiles, null_safe_left


def cohort_benchmarks(df: DataFrame, cohort: Sequence[str], metrics: Sequence[str], least: int = 5) -> DataFrame:
    """Size, and exact interpolated quartiles of each metric, for cohorts of at least `least`."""
    df = settled(df.select(*cohort, *metrics), "cohorts")  # read three times
    sizes = df.groupBy(*cohort).agg(F.count("*").alias("cohort_size")).where(F.col("cohort_size") >= least)
    out = null_safe_left(sizes, exact_quantiles(df, cohort, metrics, (0.25, 0.5, 0.75)), cohort, metrics)
    return out.select(*cohort, "cohort_size", *(F.col(m)[k].alias(f"{m}_{name}") for m in metrics for k, name in enumerate(("p25", "median", "p75"))))


def group_median(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return exact_quantiles(settled(df.select(*keys, *columns), "medians"), keys, columns, (0.5,)).select(*keys, *(F.col(c)[0].alias(f"median_{c}") for c in columns))


def state_year(df: DataFrame, state: str = "state", strict: bool = False) -> DataFrame:
    """Per state and year: entities, participants, sums, and a rate of full-year reporters.

    participants is null, not 0, where no row has a participation flag.  With
    strict, the rate's numerator also needs a population.
    """
    full = F.col("months_reported") >= 12
    counted = full & (F.col("population") > 0) if strict else full
    n = F.sum(F.when(counted, F.col("offenses")))
    d = F.sum(F.when(full & (F.col("population") > 0), F.col("population")))
    return df.groupBy(state, "data_year").agg(
        F.count_distinct("entity_id").alias("entities"), F.when(F.count("participated") > 0, F.count_distinct(F.when(F.col("participated"), F.col("entity_id")))).alias("participants"),
        F.sum("offenses").alias("offenses"), F.when(d > 0, n.cast("double") * 100000 / d).alias("rate"),
    )


def coverage(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full, partial and non reporters, and the share of population that full reporters cover."""
    m, p = F.coalesce("months_reported", F.lit(0)), F.col("population")
    covered = F.sum(F.when(m >= 12, p).otherwise(F.lit(0)))
    total = F.sum(p)
    return df.groupBy(*keys).agg(
        F.count_if(m >= 12).alias("full_reporters"), F.count_if((m > 0) & (m < 12)).alias("partial_reporters"), F.count_if(m <= 0).alias("non_reporters"),
        total.alias("population_total"), covered.alias("population_covered"), F.when(total > 0, covered.cast("double") / total).alias("coverage_ratio"),
    )


def provenance(facts: dict[str, DataFrame], entity: str = "entity_id") -> DataFrame:
    """First and last year and rows by measure, entity and source."""
    out = None
    for measure, df in facts.items():
        one = df.groupBy(entity, "source").agg(F.min("data_year").alias("first_year"), F.max("data_year").alias("last_year"), F.count("*").alias("observations")).withColumn("measure", F.lit(measure))
        out = one if out is None else out.unionByName(one)
    return out


def source_usage(prov: DataFrame) -> DataFrame:
    return prov.groupBy("source").agg(F.sum("observations").alias("observations"), F.min("first_year").alias("first_year"), F.max("last_year").alias("last_year"))


def facets(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """facet, value, n for each of several columns, from one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def group_counts(df: DataFrame, key: str, least: int, most: int) -> DataFrame:
    """The keys with the most rows, at least `least` each; a report of `most` lines."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), key).limit(most)


def status_pivot(df: DataFrame, keys: Sequence[str], status: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == v).alias(v.lower()) for v in values])


def share_of_total(df: DataFrame, key: str, value: str, digits: int = 4) -> DataFrame:
    """Sums by key and their share of the whole; the whole is summed from the few group rows."""
    by = df.groupBy(key).agg(F.sum(value).alias("total"))
    whole = by.agg(F.sum("total").alias("_all"))
    return by.join(F.broadcast(whole)).select(key, "total", F.when(F.col("_all") > 0, F.bround(F.col("total").cast("double") / F.col("_all"), digits)).alias("share"))


def national_trend(df: DataFrame, year: str, n: str, d: str, times: float = 100000.0) -> DataFrame:
    """A ratio of sums by year."""
    return df.groupBy(year).agg(F.sum(n).alias("n"), F.sum(d).alias("d")).select(year, "n", "d", F.when(F.col("d") > 0, F.col("n").cast("double") * times / F.col("d")).alias("rate"))


def check_register(log: DataFrame, severities: Sequence[str] = ("error", "warning", "info")) -> DataFrame:
    order = F.array_position(F.array(*map(F.lit, severities)), F.col("severity"))
    return log.groupBy("check_id", "severity").agg(F.count("*").alias("findings"), F.min("message").alias("message")).withColumn("severity_order", order.cast("int"))


def zero_sums(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.coalesce(F.sum(value), F.lit(0)).alias("sum")).where("sum = 0")


def latest_periods(df: DataFrame, period: str, measures: dict[str, Column]) -> DataFrame:
    """One row: the last period in which each condition holds."""
    return df.agg(*[F.max(F.when(c, F.col(period))).alias(f"latest_{name}") for name, c in measures.items()])


def nearest_rank(df: DataFrame, keys: Sequence[str], column: str, shares: Sequence[float]) -> DataFrame:
    """Legend quantiles by rank: sorted[min(n - 1, half_even(p * (n - 1)))]; counts with and without a value.

    Values are counted first, so what is ranked is distinct values, not rows.
    """
    counts = df.groupBy(*keys, column).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys).orderBy(column)
    there = counts.where(F.col(column).isNotNull())
    placed = there.withColumns({"_hi": F.sum("_c").over(w), "_n": F.sum("_c").over(Window.partitionBy(*keys))})
    at = lambda p: F.least(F.col("_n") - 1, F.bround(F.lit(p) * (F.col("_n") - 1), 0).cast("long"))
    picks = [F.max(F.when((at(p) < F.col("_hi")) & (at(p) >= F.col("_hi") - F.col("_c")), F.col(column))).alias(f"p{round(p * 100)}") for p in shares]
    stats = placed.groupBy(*keys).agg(F.sum("_c").alias("with_value"), F.min(column).alias("least"), F.max(column).alias("most"), *picks)
    missing = counts.groupBy(*keys).agg(F.sum(F.when(F.col(column).isNull(), F.col("_c")).otherwise(0)).alias("without_value"))
    return missing.join(stats, list(keys), "left").fillna(0, ["with_value"])


def low_point(df: DataFrame, key: str, period: str, value: str) -> DataFrame:
    """Per key the period of the least value (the first of equals), and the values of the periods right before and after."""
    w = Window.partitionBy(key).orderBy(period)
    near = lambda f, d: F.when(f(period).over(w) == F.col(period) + d, f(value).over(w))
    around = df.withColumns({"before": near(F.lag, -1), "after": near(F.lead, 1)})
    return around.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(F.struct(F.col(value).alias("v"), F.col(period).alias("t"), "before", "after")).alias("m")).select(key, F.col("m.t").alias(period), F.col("m.v").alias(value), "m.before", "m.after")
