"""The domain's tables over the star schema that is at hand, as DataFrames and as SQL.

Suppliers are the entities, line items their monthly counts (returned and
accepted ones the two offence groups), quantities their populations, parts
their staff.  The SQL gives the same rows and is the oracle's prefix.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measures, policy
from ..functions.codes import cohort_key
from ..operators.canonical import monthly_to_annual, pick_source
from ..sources.sinks import settled

KINDS = ((3, "municipal_police"), (5, "county_sheriff"), (6, "state_police"), (7, "university_police"))
ELIGIBLE = ("municipal_police", "county_sheriff", "county_police")


@dataclass(frozen=True)
class Analog:
    """Lazily planned tables over one folder of Parquet tables."""

    spark: SparkSession
    sf_dir: str

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def entity(self) -> DataFrame:
        k = F.col("s_suppkey")
        kind = F.when(k % 8 <= 3, "municipal_police").when(k % 8 <= 5, "county_sheriff").when(k % 8 == 6, "state_police").otherwise("university_police")
        nation = self.read("nation").join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        level = F.when(k % 8 <= 3, "place").when(k % 8 <= 5, "county").when(k % 8 == 6, "state").otherwise("place")
        return self.read("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.lpad(k.cast("string"), 9, "0").alias("entity_id"), k.alias("suppkey"), F.col("s_name").alias("name"), kind.alias("kind"), F.col("n_name").alias("state"), F.col("r_name").alias("region"),
            level.alias("geo_level"), F.when(k % 11 == 0, "needs_review").otherwise("accepted").alias("review_status"), F.when(k % 3 == 0, "Urban").when(k % 3 == 1, "Rural").alias("urbanicity"),
            (F.col("s_nationkey") * 2 + (k % 10) / 10.0).alias("lat"), (k % 50).cast("double").alias("lon"), F.col("s_acctbal").alias("balance"),
        )

    @cached_property
    def monthly(self) -> DataFrame:
        """Entity, offence group, period MM-YYYY, counts and clearances."""
        li = self.read("lineitem").where(F.col("l_returnflag").isin("R", "A"))
        group = F.when(F.col("l_returnflag") == "R", "violent-crime").otherwise("property-crime")
        counts = li.groupBy(F.col("l_suppkey").alias("suppkey"), group.alias("offense_group"), F.date_format("l_shipdate", "MM-yyyy").alias("period"))
        return counts.agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("cleared"))

    @cached_property
    def crime(self) -> DataFrame:
        offenses = monthly_to_annual(self.monthly, ["suppkey", "offense_group"], "period", "n", also={"clearances": F.sum("cleared")}).withColumnRenamed("total", "offenses")
        return offenses.select(F.lpad(F.col("suppkey").cast("string"), 9, "0").alias("entity_id"), "data_year", "offense_group", "offenses", "clearances", "months_reported", "value_type", F.lit("monthly").alias("source"))

    @cached_property
    def staffing(self) -> DataFrame:
        y = F.year("l_shipdate")
        total = self.read("lineitem").groupBy(F.lpad(F.col("l_suppkey").cast("string"), 9, "0").alias("entity_id"), y.alias("data_year")).agg(F.count_distinct("l_partkey").alias("total"))
        sworn = F.expr("total * 7 div 10")
        return total.select("entity_id", "data_year", sworn.alias("sworn"), (F.col("total") - sworn).alias("civilian"), "total", F.when(F.col("data_year") <= 2000, "pe").otherwise("api").alias("source"))

    @cached_property
    def demographics(self) -> DataFrame:
        """Entity, year, and the bases side by side: pep (every fifth entity has none), acs5 (2000 alone), county balance."""
        li = self.read("lineitem").groupBy(F.col("l_suppkey").alias("k"), F.year("l_shipdate").alias("data_year"))
        q = li.agg((F.sum("l_quantity") * 100).cast("long").alias("q"), (F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))) * 100).cast("long").alias("open"))
        return q.select(F.lpad(F.col("k").cast("string"), 9, "0").alias("entity_id"), "data_year", F.when(F.col("k") % 5 != 0, F.col("q")).alias("pep"), F.when(F.col("data_year") == 2000, F.col("q")).alias("acs5"), "open")

    @cached_property
    def population(self) -> DataFrame:
        """The denominator of an entity and year and its basis, both from the same branch."""
        e = self.entity.select("entity_id", "kind", "geo_level", "review_status")
        return denominators(e.join(self.demographics, "entity_id"))

    @cached_property
    def base(self) -> DataFrame:
        """The same-year star join on (entity, year): counts, staff and population of one year only."""
        groups = {"violent": "violent-crime", "property": "property-crime"}
        wide = self.crime.groupBy("entity_id", "data_year").agg(
            *[F.max(F.when(F.col("offense_group") == g, F.col(c))).alias(f"{name}_{c}") for name, g in groups.items() for c in ("offenses", "clearances", "months_reported")]
        )
        staff = pick_source(self.staffing, ["entity_id", "data_year"], "source", ["pe", "api"]).drop("source")
        years = wide.select("entity_id", "data_year").union(staff.select("entity_id", "data_year")).distinct()
        keys = ["entity_id", "data_year"]
        pop = self.population.select(*keys, "denominator", "denominator_basis", "pep", "balance_population")
        return years.join(self.entity.drop("suppkey"), "entity_id").join(pop, keys, "left").join(staff, keys, "left").join(wide, keys, "left")

    @cached_property
    def agency_year(self) -> DataFrame:
        return apply_policy(self.base)

    @cached_property
    def cohort(self) -> DataFrame:
        return peer_cohorts(self.agency_year)


class Counted(Analog):
    """The same tables, for queries that ask them many times: what is counted from line items is counted once and written."""

    @cached_property
    def crime(self) -> DataFrame:
        return settled(super().crime, "crime")

    @cached_property
    def staffing(self) -> DataFrame:
        return settled(super().staffing, "staffing")

    @cached_property
    def demographics(self) -> DataFrame:
        return settled(super().demographics, "demographics")

    @cached_property
    def agency_year(self) -> DataFrame:
        return settled(super().agency_year, "agency_year")


def denominators(df: DataFrame) -> DataFrame:
    """Adds balance_population, denominator and denominator_basis; accepted links of eligible kinds only."""
    county = F.col("kind").isin(*policy.COUNTY_TYPES)
    balance = F.when(county, F.col("open"))
    use = county & (balance > 0) & (balance < F.col("pep"))
    fit = (F.col("review_status") == "accepted") & F.col("kind").isin(*ELIGIBLE)
    basis = F.when(use, "pep_county_balance").when(F.col("pep").isNotNull(), "pep").when(F.col("acs5").isNotNull(), "acs5")
    return df.withColumns({"balance_population": balance, "denominator": F.when(fit, F.when(use, balance).otherwise(F.coalesce("pep", "acs5"))), "denominator_basis": basis})


def apply_policy(base: DataFrame) -> DataFrame:
    """Rates with their gates as column expressions; a withheld rate is null and says why."""
    d, kind, basis = F.col("denominator"), F.col("kind"), F.col("denominator_basis")
    dtype = policy.denominator_type_for(kind, basis, F.col("geo_level"))
    per_1k = measures.safe_ratio(F.col("sworn"), d, 1000)
    out = base.withColumns({"denominator_type": dtype, "raw_per_1k": per_1k})
    out = out.withColumn("confidence", policy.denominator_confidence(F.col("denominator_type"), basis, F.col("review_status"), F.col("raw_per_1k"), d.isNotNull()))
    gates = {}
    for g in ("violent", "property"):
        months, n = F.col(f"{g}_months_reported"), F.col(f"{g}_offenses")
        allowed = policy.rate_allowed(months, d, F.col("confidence"), n)
        gates[f"{g}_rate_allowed"] = allowed
        gates[f"{g}_rate"] = F.when(allowed, measures.safe_ratio(n, d, 100000))
        gates[f"{g}_withheld"] = policy.rate_withheld_reason(months, d, F.col("confidence"), n, F.col("denominator_type"))
    out = out.withColumns(gates)
    return out.withColumns({
        "coverage": policy.coverage_status(F.col("violent_months_reported")), "officers_per_1k": F.when(F.col("confidence") != "NOT_COMPARABLE", F.col("raw_per_1k")),
        "civilian_share": measures.safe_ratio(F.col("civilian"), F.col("total")), "implausible": F.coalesce(F.col("violent_rate") > policy.IMPLAUSIBLE_PER_100K, F.lit(False)),
        "warning": policy.methodology_warning(kind, F.col("denominator_type"), F.col("raw_per_1k")), "band": measures.band(d),
    }).drop("raw_per_1k")


def peer_cohorts(agency_year: DataFrame) -> DataFrame:
    """Publishable rows with their cohort; read from the policy's output, so withheld rates can't enter."""
    return agency_year.where("violent_rate_allowed and review_status = 'accepted'").withColumn("cohort_id", cohort_key(F.col("kind"), F.col("band"), F.col("urbanicity")))


BAND_SQL = "CASE WHEN {0} < 0 THEN NULL WHEN {0} < 10000 THEN '<10K' WHEN {0} < 25000 THEN '10K-25K' WHEN {0} < 50000 THEN '25K-50K' WHEN {0} < 100000 THEN '50K-100K' WHEN {0} < 250000 THEN '100K-250K' WHEN {0} < 500000 THEN '250K-500K' WHEN {0} < 1000000 THEN '500K-1M' WHEN {0} IS NOT NULL THEN '1M+' END"


def _gate(g: str) -> str:
    ok = f"coalesce({g}_months_reported >= 12 AND denominator > 0 AND confidence <> 'NOT_COMPARABLE' AND NOT coalesce({g}_offenses < 0, false), false)"
    r = policy.REASONS
    return f"""{ok} AS {g}_rate_allowed, CASE WHEN {ok} THEN CAST({g}_offenses AS DOUBLE) * 100000 / denominator END AS {g}_rate,
      CASE WHEN {ok} THEN NULL WHEN confidence = 'NOT_COMPARABLE' THEN '{r["not_comparable"]}' WHEN {g}_months_reported IS NULL OR {g}_months_reported <= 0 THEN '{r["no_reporting"]}'
           WHEN {g}_months_reported < 12 THEN '{r["partial_year"]}' WHEN {g}_offenses < 0 THEN '{r["negative_source_value"]}' ELSE '{r["no_denominator"]}' END AS {g}_withheld"""


SQL = f"""
WITH entity AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS entity_id, s_suppkey AS suppkey, s_name AS name,
    CASE WHEN s_suppkey % 8 <= 3 THEN 'municipal_police' WHEN s_suppkey % 8 <= 5 THEN 'county_sheriff' WHEN s_suppkey % 8 = 6 THEN 'state_police' ELSE 'university_police' END AS kind,
    n_name AS state, r_name AS region, CASE WHEN s_suppkey % 8 <= 3 THEN 'place' WHEN s_suppkey % 8 <= 5 THEN 'county' WHEN s_suppkey % 8 = 6 THEN 'state' ELSE 'place' END AS geo_level,
    CASE WHEN s_suppkey % 11 = 0 THEN 'needs_review' ELSE 'accepted' END AS review_status, CASE WHEN s_suppkey % 3 = 0 THEN 'Urban' WHEN s_suppkey % 3 = 1 THEN 'Rural' END AS urbanicity,
    CAST(s_nationkey * 2 + CAST(s_suppkey % 10 AS DOUBLE) / 10.0 AS DOUBLE) AS lat, CAST(s_suppkey % 50 AS DOUBLE) AS lon, s_acctbal AS balance
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
monthly AS (SELECT l_suppkey AS suppkey, CASE WHEN l_returnflag = 'R' THEN 'violent-crime' ELSE 'property-crime' END AS offense_group, strftime(l_shipdate, '%m-%Y') AS period,
    count(*) AS n, CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS cleared FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1, 2, 3),
crime AS (SELECT lpad(CAST(suppkey AS VARCHAR), 9, '0') AS entity_id, CAST(substr(period, 4, 4) AS INT) AS data_year, offense_group, CAST(sum(n) AS BIGINT) AS offenses, CAST(sum(cleared) AS BIGINT) AS clearances,
    CAST(count(*) AS INT) AS months_reported, CASE WHEN count(*) >= 12 THEN 'reported' ELSE 'partial_year' END AS value_type, 'monthly' AS source FROM monthly GROUP BY 1, 2, 3),
staff0 AS (SELECT lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS entity_id, CAST(year(l_shipdate) AS INT) AS data_year, count(DISTINCT l_partkey) AS total FROM lineitem GROUP BY 1, 2),
staffing AS (SELECT entity_id, data_year, (total * 7 // 10) AS sworn, total - (total * 7 // 10) AS civilian, total, CASE WHEN data_year <= 2000 THEN 'pe' ELSE 'api' END AS source FROM staff0),
demographics AS (SELECT lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS entity_id, CAST(year(l_shipdate) AS INT) AS data_year, CASE WHEN l_suppkey % 5 <> 0 THEN CAST(sum(l_quantity) * 100 AS BIGINT) END AS pep,
    CASE WHEN year(l_shipdate) = 2000 THEN CAST(sum(l_quantity) * 100 AS BIGINT) END AS acs5, CAST(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) * 100 AS BIGINT) AS open
  FROM lineitem GROUP BY l_suppkey, year(l_shipdate)),
population AS (SELECT e.entity_id, kind, geo_level, review_status, data_year, pep, acs5, open, CASE WHEN kind = 'county_sheriff' THEN open END AS balance_population,
    CASE WHEN review_status = 'accepted' AND kind IN ('municipal_police', 'county_sheriff') THEN CASE WHEN kind = 'county_sheriff' AND open > 0 AND open < pep THEN open ELSE coalesce(pep, acs5) END END AS denominator,
    CASE WHEN kind = 'county_sheriff' AND open > 0 AND open < pep THEN 'pep_county_balance' WHEN pep IS NOT NULL THEN 'pep' WHEN acs5 IS NOT NULL THEN 'acs5' END AS denominator_basis
  FROM entity e JOIN demographics d ON e.entity_id = d.entity_id),
wide AS (SELECT entity_id, data_year, max(CASE WHEN offense_group = 'violent-crime' THEN offenses END) AS violent_offenses, max(CASE WHEN offense_group = 'violent-crime' THEN clearances END) AS violent_clearances,
    max(CASE WHEN offense_group = 'violent-crime' THEN months_reported END) AS violent_months_reported, max(CASE WHEN offense_group = 'property-crime' THEN offenses END) AS property_offenses,
    max(CASE WHEN offense_group = 'property-crime' THEN clearances END) AS property_clearances, max(CASE WHEN offense_group = 'property-crime' THEN months_reported END) AS property_months_reported FROM crime GROUP BY 1, 2),
universe AS (SELECT entity_id, data_year FROM wide UNION SELECT entity_id, data_year FROM staffing),
base AS (SELECT u.entity_id, u.data_year, e.name, e.kind, e.state, e.region, e.geo_level, e.review_status, e.urbanicity, e.lat, e.lon, e.balance, p.denominator, p.denominator_basis, p.pep, p.balance_population,
    s.sworn, s.civilian, s.total, w.violent_offenses, w.violent_clearances, w.violent_months_reported, w.property_offenses, w.property_clearances, w.property_months_reported
  FROM universe u JOIN entity e ON e.entity_id = u.entity_id LEFT JOIN population p ON p.entity_id = u.entity_id AND p.data_year = u.data_year
  LEFT JOIN staffing s ON s.entity_id = u.entity_id AND s.data_year = u.data_year LEFT JOIN wide w ON w.entity_id = u.entity_id AND w.data_year = u.data_year),
typed AS (SELECT *, CASE WHEN kind = 'state_police' THEN 'statewide_population' WHEN kind = 'university_police' THEN 'campus_population'
    WHEN kind = 'county_sheriff' THEN CASE WHEN denominator_basis = 'pep_county_balance' THEN 'unincorporated_population' ELSE 'county_population' END ELSE 'municipal_population' END AS denominator_type,
    CASE WHEN denominator > 0 THEN CAST(sworn AS DOUBLE) * 1000 / denominator END AS raw_per_1k FROM base),
judged AS (SELECT *, CASE WHEN denominator_type IN ('statewide_population', 'campus_population') THEN 'NOT_COMPARABLE' WHEN denominator IS NULL THEN 'LIMITED' WHEN review_status <> 'accepted' THEN 'LIMITED'
    WHEN denominator_type = 'unincorporated_population' THEN CASE WHEN raw_per_1k > 8 THEN 'LIMITED' ELSE 'MODERATE' END WHEN denominator_type = 'county_population' THEN 'MODERATE'
    WHEN denominator_basis = 'acs5' THEN 'MODERATE' ELSE 'HIGH' END AS confidence FROM typed),
gated AS (SELECT *, {_gate("violent")}, {_gate("property")} FROM judged),
agency_year AS (SELECT * EXCLUDE (raw_per_1k), CASE WHEN violent_months_reported IS NULL THEN 'UNKNOWN' WHEN violent_months_reported <= 0 THEN 'NONE' WHEN violent_months_reported >= 12 THEN 'COMPLETE' ELSE 'PARTIAL' END AS coverage,
    CASE WHEN confidence <> 'NOT_COMPARABLE' THEN raw_per_1k END AS officers_per_1k, CASE WHEN total > 0 THEN CAST(civilian AS DOUBLE) / total END AS civilian_share, coalesce(violent_rate > 10000, false) AS implausible,
    CASE WHEN denominator_type = 'unincorporated_population' AND raw_per_1k > 8 THEN 'Unusually high: cities policed under contract are not in this denominator' WHEN denominator_type = 'unincorporated_population' THEN 'Denominator is the unincorporated balance of the county' END AS warning,
    {BAND_SQL.format("denominator")} AS band FROM gated),
cohort AS (SELECT *, kind || ' | ' || coalesce(band, 'unknown') || ' | ' || coalesce(urbanicity, 'unknown') AS cohort_id FROM agency_year WHERE violent_rate_allowed AND review_status = 'accepted')
"""
