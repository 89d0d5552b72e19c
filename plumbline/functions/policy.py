"""May a rate be published?  Every rule is a column expression; null is never taken for zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Types of entities by the population they can have.
STATEWIDE_TYPES = ("state_police",)
TRANSIENT_TYPES = {
    "university_police": "campus_population",
    "transit_police": "transit_population",
    "port_or_airport_police": "unknown",
    "park_or_conservation_police": "unknown",
    "special_jurisdiction": "unknown",
    "state_special_jurisdiction": "unknown",
    "marshal_or_constable": "unknown",
    "federal": "not_applicable",
}
COUNTY_TYPES = ("county_sheriff", "county_police")
NOT_COMPARABLE = ("statewide_population", "campus_population", "transit_population", "not_applicable", "unknown")
EXTREME_PER_1K, IMPLAUSIBLE_PER_100K, MIN_COHORT, FULL_YEAR = 8.0, 10_000.0, 5, 12
# Why a rate is withheld.
REASONS = {
    "partial_year": "Insufficient annual reporting coverage",
    "no_reporting": "Not reported",
    "no_denominator": "No population estimate for this year",
    "not_comparable": "Not comparable using a standard resident denominator",
    "negative_source_value": "Source value is negative after revisions",
}


def denominator_type_for(kind: Column, basis: Column, level: Column) -> Column:
    """What a population stands for, by entity type, basis and level of geography; order matters."""
    out = F.when(kind.isin(*STATEWIDE_TYPES), "statewide_population")
    for name, population in TRANSIENT_TYPES.items():
        out = out.when(kind == name, population)
    return (
        out.when(kind.isin(*COUNTY_TYPES), F.when(basis == "pep_county_balance", "unincorporated_population").otherwise("county_population"))
        .when(basis.isin("pep", "acs5") | level.isin("place", "cousub"), "municipal_population")
        .when(level == "county", "county_population")
        .otherwise("unknown")
    )


def structurally_not_comparable(denominator_type: Column) -> Column:
    return F.coalesce(denominator_type.isin(*NOT_COMPARABLE), F.lit(False))


def denominator_confidence(denominator_type: Column, basis: Column, status: Column, per_1k: Column, has_value: Column) -> Column:
    return (
        F.when(structurally_not_comparable(denominator_type), "NOT_COMPARABLE")
        .when(~F.coalesce(has_value, F.lit(False)), "LIMITED")
        .when(~F.coalesce(status == "accepted", F.lit(False)), "LIMITED")
        .when(denominator_type == "unincorporated_population", F.when(per_1k > EXTREME_PER_1K, "LIMITED").otherwise("MODERATE"))
        .when(denominator_type == "county_population", "MODERATE")
        .when(basis == "acs5", "MODERATE")
        .otherwise("HIGH")
    )


def coverage_status(months: Column, need: int = FULL_YEAR) -> Column:
    return F.when(months.isNull(), "UNKNOWN").when(months <= 0, "NONE").when(months >= need, "COMPLETE").otherwise("PARTIAL")


def rate_allowed(months: Column, denominator: Column, confidence: Column, offenses: Column) -> Column:
    """Full coverage, a positive denominator, comparable, and no negative count; a null count passes."""
    rule = (coverage_status(months) == "COMPLETE") & (denominator > 0) & (confidence != "NOT_COMPARABLE") & ~F.coalesce(offenses < 0, F.lit(False))
    return F.coalesce(rule, F.lit(False))


def rate_withheld_reason(months: Column, denominator: Column, confidence: Column, offenses: Column, denominator_type: Column | None = None, texts: dict[str, str] = REASONS) -> Column:
    """The first reason that holds, null where the rate is allowed."""
    status = coverage_status(months)
    structural = (confidence == "NOT_COMPARABLE") if denominator_type is None else F.when(denominator_type.isNull(), confidence == "NOT_COMPARABLE").otherwise(structurally_not_comparable(denominator_type))
    return (
        F.when(rate_allowed(months, denominator, confidence, offenses), None)
        .when(structural, texts["not_comparable"])
        .when(status.isin("NONE", "UNKNOWN"), texts["no_reporting"])
        .when(status == "PARTIAL", texts["partial_year"])
        .when(offenses < 0, texts["negative_source_value"])
        .otherwise(texts["no_denominator"])
    )


def methodology_warning(kind: Column, denominator_type: Column, per_1k: Column) -> Column:
    """A note on values of county entities whose population is the unincorporated balance."""
    balance = kind.isin(*COUNTY_TYPES) & (denominator_type == "unincorporated_population")
    return F.when(balance & (per_1k > EXTREME_PER_1K), "Unusually high: cities policed under contract are not in this denominator").when(balance, "Denominator is the unincorporated balance of the county")


def percentile_allowed(n: Column, confidence: Column, least: int = MIN_COHORT) -> Column:
    return F.coalesce((n >= least) & (confidence != "NOT_COMPARABLE"), F.lit(False))


def peer_definition(kind: Column, band: Column, urbanicity: Column, year: Column) -> Column:
    return F.concat_ws("; ", F.concat(F.replace(kind, F.lit("_"), F.lit(" ")), F.lit(" agencies")), F.concat(F.lit("population served "), band), F.lower(urbanicity), F.concat(F.lit("complete reporting in "), year.cast("string")))


def absent_reason(confidence: Column, staffing: Column, population: Column) -> Column:
    """Why a value per 1,000 is absent."""
    return (
        F.when(confidence == "NOT_COMPARABLE", "not_comparable")
        .when(staffing.isNull(), "staffing_not_reported")
        .when(~F.coalesce(population > 0, F.lit(False)), "no_population")
        .otherwise("not_available")
    )
