"""Parametrised analytical queries over the entity-year table and its neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import policy
from ..operators import aggregates as A
from ..operators import windows as W
from ..operators.quantiles import exact_quantiles
from ..sources.sinks import settled

SORTABLE = ("name", "data_year", "denominator", "violent_offenses", "violent_rate", "officers_per_1k", "sworn")
METRICS = ("violent_rate", "property_rate", "officers_per_1k", "violent_offenses", "property_offenses", "civilian_share")


def _metric(name: str) -> str:
    if name not in METRICS:
        raise ValueError(f"no metric {name}")
    return name


def agencies(ay: DataFrame, year: int, q: str | None = None, state: str | None = None, kind: str | None = None, population: tuple[float | None, float | None] = (None, None), sworn: tuple[float | None, float | None] = (None, None), coverage: str | None = None, status: str | None = None, sort: str = "name", descending: bool = False, page: int = 1, size: int = 25) -> DataFrame:
    """One page of entities of a year under up to nine filters."""
    out = ay.where(F.col("data_year") == year)
    conditions: list[Column] = []
    if q:
        conditions.append(F.lower("name").contains(q.lower()))
    for column, value in (("state", state), ("kind", kind), ("coverage", coverage), ("review_status", status)):
        if value:
            conditions.append(F.col(column) == value)
    for column, (low, high) in (("denominator", population), ("sworn", sworn)):
        if low is not None:
            conditions.append(F.col(column) >= low)
        if high is not None:
            conditions.append(F.col(column) <= high)
    for c in conditions:
        out = out.where(c)
    return W.page(out, sort, descending, page, size, SORTABLE, ("name", "entity_id"))


def profile(entity: DataFrame, ay: DataFrame, entity_id: str) -> dict[str, DataFrame]:
    own = ay.where(F.col("entity_id") == entity_id)
    latest = own.where("violent_offenses is not null").orderBy(F.desc("data_year")).limit(1)
    return {"entity": entity.where(F.col("entity_id") == entity_id), "latest": latest, "history": own}


def series(ay: DataFrame, entity_id: str, metric: str) -> DataFrame:
    return ay.where(F.col("entity_id") == entity_id).select("entity_id", "data_year", F.col(_metric(metric)).alias("value"), "coverage", "confidence")


def peers(ay: DataFrame, entity_id: str, year: int, metric: str) -> DataFrame:
    """The subject's standing in its cohort (kind, band, setting; publishable, with a value): one row, no collect.

    A subject without a population band has an empty cohort; a missing setting
    equals a missing or blank one.
    """
    m = _metric(metric)
    subject = ay.where((F.col("entity_id") == entity_id) & (F.col("data_year") == year)).select(F.col("entity_id").alias("subject_id"), F.col("kind").alias("s_kind"), F.col("band").alias("s_band"), F.coalesce("urbanicity", F.lit("")).alias("s_urb"), F.col("urbanicity").alias("s_setting"), F.col(m).alias("s_value"), F.col("confidence").alias("s_confidence"), F.col("state").alias("s_state"))
    pool = ay.where((F.col("data_year") == year) & F.col("violent_rate_allowed") & F.col(m).isNotNull())
    members = pool.join(subject, (F.col("kind") == F.col("s_kind")) & (F.col("band") == F.col("s_band")) & (F.coalesce("urbanicity", F.lit("")) == F.col("s_urb")))
    members = settled(members.select("subject_id", "s_value", F.col(m).alias("_q")), "members")
    stats = members.groupBy("subject_id").agg(F.count("*").alias("cohort_size"), F.count_if(F.col("_q") < F.col("s_value")).alias("below")).join(exact_quantiles(members, ["subject_id"], ["_q"], (0.25, 0.5, 0.75)), "subject_id")
    areas = pool.join(subject.select("subject_id", "s_state", F.lit(year).alias("data_year")), "data_year").select("subject_id", F.when(F.col("state") == F.col("s_state"), F.col(m)).alias("state_median"), F.col(m).alias("national_median"))
    areas = exact_quantiles(settled(areas, "areas"), ["subject_id"], ["state_median", "national_median"], (0.5,)).select("subject_id", F.col("state_median")[0].alias("state_median"), F.col("national_median")[0].alias("national_median"))
    out = subject.join(stats, "subject_id", "left").join(areas, "subject_id", "left")
    n = F.coalesce("cohort_size", F.lit(0))
    return out.select(
        "subject_id", F.col("s_value").alias("value"), n.alias("cohort_size"), F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("p50"), F.col("_q")[2].alias("p75"), "state_median", "national_median",
        F.when(policy.percentile_allowed(n, F.col("s_confidence")), F.bround(F.col("below").cast("double") / F.col("cohort_size") * 100, 1)).alias("percentile"),
        policy.peer_definition(F.col("s_kind"), F.col("s_band"), F.col("s_setting"), F.lit(year)).alias("definition"),
    )


def comparability(members: DataFrame) -> DataFrame:
    """Issues of comparing these entity-years: code and severity; fewer than two members have none."""
    agg = members.agg(
        F.count("*").alias("n"), F.count_distinct("kind").alias("kinds"), F.count_distinct("denominator_type").alias("types"), F.max(F.col("confidence") == "NOT_COMPARABLE").alias("apart"),
        F.max(F.col("kind").isin(*policy.STATEWIDE_TYPES)).alias("wide"), F.min("violent_months_reported").alias("months"),
    )
    rules = {
        "statewide_vs_local": F.col("wide") & (F.col("kinds") > 1), "mixed_denominators": F.col("types") > 1, "not_comparable_member": F.col("apart"),
        "mixed_agency_types": (F.col("kinds") > 1) & ~F.col("wide"), "incomplete_coverage": F.col("months") < policy.FULL_YEAR,
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)) & (F.col("n") >= 2), F.lit(code)) for code, c in rules.items()]))
    return agg.select(F.explode(found).alias("code")).withColumn("severity", F.lit("warning"))


def compare(ay: DataFrame, ids: Sequence[str], year: int) -> dict[str, DataFrame]:
    """Two to five entities: the year's rows, their series, who is missing and their last year, issues."""
    if not 2 <= len(ids) <= 5:
        raise ValueError("two to five entities")
    some = ay.where(F.col("entity_id").isin(*ids))
    now = some.where(F.col("data_year") == year)
    missing = some.join(now.select("entity_id"), "entity_id", "left_anti").groupBy("entity_id").agg(F.max("data_year").alias("latest_year"))
    return {"snapshot": now, "trends": some, "missing": missing, "issues": comparability(now)}


def overview(ay: DataFrame, year: int) -> dict[str, DataFrame]:
    now = ay.where(F.col("data_year") == year)
    head = now.agg(F.count_distinct("entity_id").alias("entities"), F.sum("sworn").alias("sworn"), F.sum("violent_offenses").alias("violent_offenses"), F.sum("denominator").alias("population"))
    full = ay.where("coverage = 'COMPLETE' and denominator > 0")
    return {"headline": head, "coverage": A.status_pivot(now.withColumn("all", F.lit("all")), ["all"], "coverage", ["COMPLETE", "PARTIAL", "NONE", "UNKNOWN"]), "composition": A.share_of_total(now, "kind", "sworn"), "trend": A.national_trend(full, "data_year", "violent_offenses", "denominator")}


LEGEND = (0.1, 0.25, 0.5, 0.75, 0.9)


def map_layer(ay: DataFrame, year: int, metric: str, layer: str, geographies: DataFrame | None = None, state: str | None = None, kind: str | None = None) -> dict[str, DataFrame]:
    """Features of a layer (entity, state, county), its legend, and how many of the year's rows have no coordinates.

    entity: rows with coordinates, of one state or kind if asked; the others
    are counted, not placed.  state: medians of all rows with a state.  county:
    medians of rows whose geo_id is a county among `geographies` (geo_id,
    geo_level, geoid, name, state); rows of other levels are in no county.  A
    feature without a value stays, with null, and the legend counts it.
    """
    m, now = _metric(metric), ay.where(F.col("data_year") == year)
    none = F.col("lat").isNull() | F.col("lon").isNull()
    unplaced = now.agg((F.count_if(none) if layer == "entity" else F.lit(0).cast("long")).alias("unplaced"))
    sums = [F.count("*").alias("agencies"), F.sum("sworn").alias("sworn")]
    if layer == "entity":
        asked = now.where(~none)
        asked = asked.where(F.col("state") == state) if state else asked
        asked = asked.where(F.col("kind") == kind) if kind else asked
        about = ["entity_id", "name", "kind", "state", "lat", "lon", "denominator", "sworn", "violent_months_reported", "coverage", "violent_rate_allowed", "violent_withheld", "denominator_type", "confidence"]
        placed = asked.select(*about, F.col(m).alias("value"))
    elif layer == "state":
        known = now.where(F.col("state").isNotNull())
        sums += [F.sum("denominator").alias("population"), F.count_if("violent_rate_allowed").alias("reporting_agencies")]
        placed = known.groupBy("state").agg(*sums).join(A.group_median(known, ["state"], [m]), "state")
    elif layer == "county":
        if geographies is None:
            raise ValueError("counties have to be given")
        counties = geographies.where("geo_level = 'county'").select("geo_id", "geoid", F.col("name").alias("county"), F.col("state").alias("county_state"))
        known = now.join(counties, "geo_id")
        placed = known.groupBy("geoid").agg(F.any_value("county").alias("name"), F.any_value("county_state").alias("state"), *sums).join(A.group_median(known, ["geoid"], [m]), "geoid")
    else:
        raise ValueError(f"no such layer: {layer}")
    placed = placed.withColumnRenamed(f"median_{m}", "value")
    legend = A.nearest_rank(placed.select("value", F.lit(layer).alias("layer")), ["layer"], "value", LEGEND)
    return {"features": placed, "legend": legend, "unplaced": unplaced}


def search(entity: DataFrame, q: str, most: int = 20) -> DataFrame:
    """Entity and state hits of one query, typed, by relevance."""
    e = entity.select(F.lit("entity").alias("type"), F.col("entity_id").alias("id"), "name")
    s = entity.select(F.lit("state").alias("type"), F.col("state").alias("id"), F.col("state").alias("name")).distinct()
    return W.relevance(e.unionByName(s), q, "id", "name", most)


def register_views(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def adhoc(tables: dict[str, DataFrame], sql: str):
    """Any SQL over the warehouse's tables."""
    register_views(tables)
    return next(iter(tables.values())).sparkSession.sql(sql)


def state_profile(ay: DataFrame, state: str, year: int, most: int = 10) -> dict[str, DataFrame]:
    """A state's summary by year, its kinds and its largest entities of a year."""
    own = ay.where(F.col("state") == state)
    now = own.where(F.col("data_year") == year)
    return {
        "trend": own.groupBy("data_year").agg(F.sum("violent_offenses").alias("offenses"), F.sum("denominator").alias("population")), "composition": A.share_of_total(now, "kind", "sworn"),
        "largest": now.orderBy(F.desc_nulls_last("denominator"), "entity_id").limit(most), "quality": A.status_pivot(now, ["kind"], "coverage", ["COMPLETE", "PARTIAL", "NONE", "UNKNOWN"]),
    }


def entity_coverage(ay: DataFrame, log: DataFrame, entity_id: str) -> dict[str, DataFrame]:
    """An entity's years with what was reported and why a rate is withheld, and its findings in the log."""
    years = ay.where(F.col("entity_id") == entity_id).select("entity_id", "data_year", "violent_months_reported", "coverage", "violent_rate_allowed", "violent_withheld")
    return {"years": years, "flags": log.where(F.col("entity_id") == entity_id)}


def coverage_detail(ay: DataFrame, year: int, state: str | None = None, status: str | None = None, most: int = 200) -> DataFrame:
    """The largest entities of a year, state and coverage status."""
    out = ay.where(F.col("data_year") == year)
    for column, value in (("state", state), ("coverage", status)):
        out = out.where(F.col(column) == value) if value else out
    return out.orderBy(F.desc_nulls_last("denominator"), "entity_id").limit(most)


def flag_detail(log: DataFrame, entity: DataFrame, check_id: str, most: int = 200) -> DataFrame:
    """A check's latest findings with the entities' names."""
    some = log.where(F.col("check_id") == check_id).orderBy(F.desc_nulls_last("data_year"), "entity_id", "observed").limit(most)
    return some.join(entity.select("entity_id", "name", "state"), "entity_id", "left")


def sources(registry: DataFrame, usage: DataFrame) -> DataFrame:
    """The registry's sources with how many observations the tables have of each."""
    return registry.join(usage.select("source", "observations"), "source", "left").fillna(0, ["observations"])


def release(ay: DataFrame, release_id: str, periods: dict[str, Column]) -> DataFrame:
    """The release and the latest year of each measure."""
    return A.latest_periods(ay, "data_year", periods).select(F.lit(release_id).alias("release_id"), "*")
