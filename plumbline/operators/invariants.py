"""Invariants across tables, declared once: what a column must name, hold or begin with; each gives its number of violations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the domain asks of its tables.
ATTRIBUTION = "government_unit"
LEGACY_PREFIX = 7


@dataclass(frozen=True)
class Invariant:
    """A rule for the rows of a table: `broken` as SQL; or, with `member`, that a column's values stand in (table, column); or, with `by`, that `broken` holds for no group's sums."""

    name: str
    table: str
    broken: str | None = None
    column: str | None = None
    member: tuple[str, str] | None = None
    by: str | None = None


def sources_known(facts: Sequence[str], source: str = "source", among: tuple[str, str] = ("dim_source", "source")) -> list[Invariant]:
    """Every fact row names its source, and every source named is one of the dimension's."""
    return [x for t in facts for x in (Invariant("source_is_named", t, broken=f"{source} IS NULL"), Invariant("source_is_known", t, column=source, member=among))]


INVARIANTS = (
    *sources_known(("crime", "staffing")),
    Invariant("no_rate_of_a_partial_year", "agency_year", broken="violent_rate IS NOT NULL AND coalesce(violent_months_reported, 0) < 12"),
    Invariant("no_rate_on_an_unaccepted_link", "agency_year", broken="violent_rate IS NOT NULL AND review_status <> 'accepted'"),
    Invariant("attributed_to_governments", "finance", broken=f"attribution_level IS NULL OR attribution_level <> '{ATTRIBUTION}'"),
    Invariant("key_is_the_legacy_keys_beginning", "entity", broken=f"legacy_key IS NOT NULL AND NOT key <=> substr(legacy_key, 1, {LEGACY_PREFIX})"),
    Invariant("no_zero_filled_year", "staffing", broken="sum(sworn) = 0", by="data_year"),
)


def check_invariants(tables: dict[str, DataFrame], invariants: Sequence[Invariant] = INVARIANTS) -> DataFrame:
    """invariant, table_name, violations: rows that break it (groups, where it is about groups), 0 where none does.

    All rules of a table's rows are one pass over it; the keys that members must
    stand in are joined as distinct keys, which Spark broadcasts if they are
    small.  A null member breaks nothing; that it is there is a rule of its own.
    """
    out: list[DataFrame] = []
    for name in dict.fromkeys(x.table for x in invariants):
        mine = [x for x in invariants if x.table == name]
        rows, counts = tables[name], []
        for k, x in enumerate(x for x in mine if x.by is None):
            broken: Column = F.expr(x.broken) if x.broken else F.lit(False)
            if x.member:
                other, column = x.member
                known = tables[other].select(F.col(column).alias(f"_k{k}")).where(F.col(f"_k{k}").isNotNull()).distinct()
                rows = rows.join(known, F.col(x.column) == F.col(f"_k{k}"), "left")
                broken = F.col(x.column).isNotNull() & F.col(f"_k{k}").isNull()
            counts.append((x, F.count_if(broken)))
        if counts:
            listed = F.array(*(F.struct(F.lit(x.name).alias("invariant"), c.alias("violations")) for x, c in counts))
            out.append(rows.agg(listed.alias("found")).select(F.explode("found").alias("f")).select("f.invariant", F.lit(name).alias("table_name"), "f.violations"))
        for x in mine:
            if x.by is not None:
                groups = tables[name].groupBy(x.by).agg(F.expr(x.broken).alias("broken"))
                out.append(groups.agg(F.count_if("broken").alias("violations")).select(F.lit(x.name).alias("invariant"), F.lit(name).alias("table_name"), "violations"))
    every = out[0]
    for df in out[1:]:
        every = every.unionByName(df)
    return every
