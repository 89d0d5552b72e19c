"""Data-quality checks as data: each gives entity_id, data_year, observed."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FINDING = ("entity_id", "data_year", "observed")


@dataclass(frozen=True)
class Check:
    """A check of single rows (condition, observed, entity and year as SQL), or a function of the tables."""

    check_id: str
    severity: str
    table: str
    message: str
    condition: str | None = None
    observed: str = "NULL"
    entity: str = "entity_id"
    year: str = "data_year"
    find: Callable[[dict[str, DataFrame]], DataFrame] | None = None


def finding(df: DataFrame, entity: str | Column, year: str | Column | None, observed: str | Column) -> DataFrame:
    c = lambda x: F.col(x) if isinstance(x, str) else x
    y = F.lit(None).cast("int") if year is None else c(year).cast("int")
    return df.select(c(entity).cast("string").alias("entity_id"), y.alias("data_year"), c(observed).cast("string").alias("observed"))


def not_unique(table: str, keys: Sequence[str]) -> Callable[[dict[str, DataFrame]], DataFrame]:
    return lambda t: finding(t[table].groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), F.concat_ws("|", *keys), None, "n")


def orphan(table: str, other: str, keys: Sequence[str], observed: str, entity: str = "entity_id", year: str | None = "data_year", where: str = "true", among: str = "true") -> Callable[[dict[str, DataFrame]], DataFrame]:
    """Rows of table (that meet `where`) whose keys no row of other (that meets `among`) has."""
    return lambda t: finding(t[table].where(where).join(t[other].where(among).select(*keys).distinct(), list(keys), "left_anti"), entity, year, F.expr(observed))


def dropped_to_zero(table: str, value: str, least: int) -> Callable[[dict[str, DataFrame]], DataFrame]:
    def find(t):
        w = Window.partitionBy("entity_id").orderBy("data_year")
        return finding(t[table].withColumn("_p", F.lag(value).over(w)).where((F.col("_p") > least) & (F.col(value) == 0)), "entity_id", "data_year", "_p")

    return find


def jumped(table: str, keys: Sequence[str], value: str, times: float = 10, least: int = 20, where: str = "months_reported = 12") -> Callable[[dict[str, DataFrame]], DataFrame]:
    """The row before among rows that qualify, not the year before: gaps are bridged."""
    def find(t):
        w = Window.partitionBy(*keys).orderBy("data_year")
        rows = t[table].where(where).withColumn("_p", F.lag(value).over(w)).where((F.col("_p") >= least) & (F.col(value) >= times * F.col("_p")))
        return finding(rows, "entity_id", "data_year", F.concat_ws(" -> ", F.col("_p").cast("string"), F.col(value).cast("string")))

    return find


def codes_of(table: str, widths: dict[str, int]) -> str:
    """The condition that a code has not the width of its level; levels without one pass."""
    return " OR ".join(f"(geo_level = '{level}' AND length(geoid) <> {n})" for level, n in widths.items())


# Widths of codes by level, counties that were abolished, bounds of the domain.
GEOID_WIDTHS = {"state": 2, "county": 5, "place": 7, "cousub": 10}
ABOLISHED_COUNTIES = ("09001", "09003", "09005", "09007", "09009", "09011", "09013", "09015")
FIRST_YEAR, LAST_YEAR = 1960, 2025

CHECKS = (
    Check("entity_id_not_unique", "error", "entity", "an entity has several rows", find=not_unique("entity", ["entity_id"])),
    Check("invalid_entity_code", "error", "entity", "the code isn't nine digits", "NOT entity_id RLIKE '^[0-9]{9}$'", "entity_id", year="NULL"),
    Check("geoid_wrong_width", "error", "geography", "a code has lost a zero", codes_of("geography", GEOID_WIDTHS), "geoid", "geo_id", "NULL"),
    Check("abolished_county", "error", "geography", "the county was abolished", f"geo_level = 'county' AND geoid IN {ABOLISHED_COUNTIES}", "geoid", "geo_id", "NULL"),
    Check("unknown_state", "error", "entity", "the state isn't in the list", find=orphan("entity", "nation", ["state"], "state", year=None)),
    Check("negative_population", "error", "population", "a population is negative", "pep < 0", "pep"),
    Check("negative_count", "warning", "crime", "a count is negative", "offenses < 0", "offenses"),
    Check("clearances_exceed_offenses", "warning", "crime", "more cleared than counted", "clearances > offenses * 1.5", "clearances"),
    Check("year_out_of_range", "error", "staffing", "no such year", f"NOT data_year BETWEEN {FIRST_YEAR} AND {LAST_YEAR}", "data_year"),
    Check("year_beyond_cutoff", "error", "crime", "a year isn't complete yet", f"data_year > {LAST_YEAR}", "data_year"),
    Check("zero_sworn_with_civilians", "warning", "staffing", "civilians but no officers", "sworn = 0 AND civilian > 0", "civilian"),
    Check("staffing_dropped_to_zero", "warning", "staffing", "from over 20 officers to none", find=dropped_to_zero("staffing", "sworn", 20)),
    Check("count_jumped", "warning", "crime", "a count grew tenfold at least", find=jumped("crime", ["entity_id", "offense_group"], "offenses")),
    Check("implausible_rate", "warning", "agency_year", "over 10,000 per 100,000", "implausible AND pep >= 1000", "round(violent_rate, 6)"),
    Check("no_denominator_for_year", "info", "agency_year", "no population for the year", "denominator IS NULL AND violent_offenses IS NOT NULL", "violent_offenses"),
    Check("rate_across_years", "error", "agency_year", "a rate without a population of its year", find=orphan("agency_year", "population", ["entity_id", "data_year"], "'rate'", where="violent_rate IS NOT NULL", among="denominator IS NOT NULL")),
    Check("rate_on_unaccepted_link", "error", "agency_year", "a rate on a link under review", "violent_rate IS NOT NULL AND review_status <> 'accepted'", "review_status"),
    Check("rate_on_ineligible_kind", "error", "agency_year", "a rate of a kind without residents", "violent_rate IS NOT NULL AND kind IN ('state_police', 'university_police')", "kind"),
    Check("rate_of_partial_year", "error", "agency_year", "a rate of a partial year", "violent_rate IS NOT NULL AND violent_months_reported < 12", "violent_months_reported"),
    Check("likely_contract_policing", "warning", "agency_year", "over 8 officers per 1,000", "officers_per_1k > 8 AND kind IN ('county_sheriff', 'county_police') AND denominator_basis = 'pep_county_balance'", "round(officers_per_1k, 6)"),
    Check("covered_by_parent", "info", "entity", "reported by another entity", "covered_by IS NOT NULL", "covered_by", year="NULL"),
    Check("unresolved_link", "info", "entity", "the link is under review", "review_status <> 'accepted'", "review_status", year="NULL"),
    Check("amount_not_reported", "info", "finance", "the amount is imputed or from elsewhere", "item = 'E62' AND value_type <> 'reported'", "value_type", "gov_id"),
    Check("fiscal_year_misaligned", "info", "finance", "the fiscal year isn't the calendar's", "item = 'E62' AND fiscal_year_ending <> '1231'", "fiscal_year_ending", "gov_id"),
    Check("population_divergence", "warning", "population", "two populations differ by over a tenth", "pep > 0 AND open IS NOT NULL AND abs(pep - open) * 1.0 / pep > 0.1", "open"),
    Check("missing_source", "error", "staffing", "no source", "source IS NULL", "'none'"),
)
#: Findings of the loaders, which a new run of the checks keeps.
LOAD_TIME = ("zero_filled_year", "duplicate_record", "ambiguous_key", "key_disambiguated")


def run_checks(tables: dict[str, DataFrame], checks: Sequence[Check] = CHECKS, release: str | None = None, most: int | None = None) -> DataFrame:
    """The log: check_id, severity, table_name, entity_id, data_year, observed, message; at most `most` rows a check, if given.

    All checks of single rows of a table are one pass over it, as an array of
    the findings that each row has.
    """
    parts = []
    for name in dict.fromkeys(c.table for c in checks if c.condition):
        found = [
            F.when(F.expr(c.condition), F.struct(F.lit(c.check_id).alias("check_id"), F.lit(c.severity).alias("severity"), F.lit(name).alias("table_name"), F.expr(c.entity).cast("string").alias("entity_id"), F.expr(c.year).cast("int").alias("data_year"), F.expr(c.observed).cast("string").alias("observed"), F.lit(c.message).alias("message")))
            for c in checks if c.table == name and c.condition
        ]
        parts.append(tables[name].select(F.explode(F.array_compact(F.array(*found))).alias("f")).select("f.*"))
    for c in checks:
        if c.find:
            parts.append(c.find(tables).select(F.lit(c.check_id).alias("check_id"), F.lit(c.severity).alias("severity"), F.lit(c.table).alias("table_name"), *FINDING, F.lit(c.message).alias("message")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out if most is None else capped(out, most)
    return out.withColumn("release_id", F.lit(release)) if release else out


def capped(log: DataFrame, most: int) -> DataFrame:
    """At most `most` rows of each check, the latest years first."""
    w = Window.partitionBy("check_id").orderBy(F.desc_nulls_last("data_year"), "entity_id", "observed")
    return log.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def refreshed(log: DataFrame, found: DataFrame, load_time: Sequence[str] = LOAD_TIME) -> DataFrame:
    """The log after a new run of the checks: load-time findings stay, all others are those found now."""
    return log.where(F.col("check_id").isin(*load_time)).unionByName(found, allowMissingColumns=True)


def summary(log: DataFrame, checks: Sequence[Check] = CHECKS) -> DataFrame:
    """Findings of every check, 0 for those without."""
    every = log.sparkSession.createDataFrame([(c.check_id, c.severity) for c in checks], "check_id string, severity string")
    return every.join(log.groupBy("check_id").agg(F.count("*").alias("findings")), "check_id", "left").fillna(0, ["findings"])
