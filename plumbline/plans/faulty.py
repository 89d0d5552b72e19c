"""The analog's tables with faults planted in some rows, so that every check has something to find; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from ..operators import canonical as C
from ..operators import quality as V
from .analog import Analog, Counted


def every(n: int, at: int, key: str = "entity_id") -> Column:
    """True for one entity in n."""
    return F.col(key).cast("long") % n == at


def finance(a: Analog) -> DataFrame:
    """Amounts by unit, year, item and flag, with the unit's end of the fiscal year."""
    item = F.when(F.col("l_returnflag") == "R", "E62").when(F.col("l_returnflag") == "A", "F62").otherwise("E01")
    flag = F.element_at(F.array(*map(F.lit, "RISAMN")), (F.col("l_suppkey") % 6 + 1).cast("int"))
    amounts = a.read("lineitem").groupBy(F.col("l_suppkey").alias("gov_id"), F.year("l_shipdate").alias("data_year"), item.alias("item")).agg(F.sum(F.floor("l_extendedprice")).cast("long").alias("amount"), F.first(flag).alias("flag")).withColumn("file_year", F.col("data_year"))
    years = a.read("lineitem").select(F.year("l_shipdate").alias("file_year")).distinct()
    end = F.when(F.col("s_suppkey") % 4 == 0, "0630").otherwise("1231")
    units = a.read("supplier").select(F.col("s_suppkey").alias("gov_id"), F.col("s_name").alias("unit"), end.alias("fiscal_year_ending"), "s_nationkey").join(F.broadcast(years.agg(F.collect_set("file_year").alias("ys"))))
    return C.finance(amounts, units.withColumn("file_year", F.explode("ys")).drop("ys"))


def tables(a: Analog) -> dict[str, DataFrame]:
    k = F.col("suppkey")
    entity = a.entity.withColumn("covered_by", F.when(k % 23 == 1, F.lpad((k + 1).cast("string"), 9, "0")))
    entity = entity.unionByName(entity.where(k % 20 == 3)).withColumns({"entity_id": F.when(k % 17 == 5, F.concat(F.lit("X"), F.substring("entity_id", 2, 8))).otherwise(F.col("entity_id")), "state": F.when(k % 19 == 7, "ATLANTIS").otherwise(F.col("state"))})
    code = codes.pad(F.col("n_nationkey"), 5)
    county = F.when(F.col("n_nationkey") == 1, "09001").when(F.col("n_nationkey") % 10 == 3, F.col("n_nationkey").cast("string")).otherwise(code)
    geography = a.read("nation").select(F.lit("county").alias("geo_level"), F.concat(F.lit("county:"), code).alias("geo_id"), county.alias("geoid")).unionByName(a.read("region").select(F.lit("state").alias("geo_level"), F.concat(F.lit("state:"), F.col("r_regionkey").cast("string")).alias("geo_id"), codes.pad(F.col("r_regionkey"), 2).alias("geoid")))
    crime = a.crime.withColumns({
        "offenses": F.when(every(31, 4) & (F.col("data_year") == 1998), -F.col("offenses")).when(every(37, 6) & (F.col("data_year") == 1999), F.col("offenses") * 40).otherwise(F.col("offenses")),
        "clearances": F.when(every(41, 8), F.col("offenses") * 2).otherwise(F.col("clearances")),
        "data_year": F.when(every(43, 9) & (F.col("data_year") == 2001), 2031).otherwise(F.col("data_year")),
    })
    staffing = a.staffing.withColumns({
        "sworn": F.when(every(11, 3) & (F.col("data_year") == 1999), 0).otherwise(F.col("sworn")),
        "source": F.when(every(47, 10) & (F.col("data_year") == 1997), None).otherwise(F.col("source")),
        "data_year": F.when(every(53, 11) & (F.col("data_year") == 2001), 1959).otherwise(F.col("data_year")),
    })
    population = a.population.withColumn("pep", F.when(every(29, 2), -F.col("pep")).otherwise(F.col("pep")))
    agency_year = a.agency_year.withColumns({
        "violent_rate": F.when(F.col("violent_rate").isNull() & every(7, 1), 50.0).when(every(19, 2), F.col("violent_rate") * 1000).otherwise(F.col("violent_rate")),
        "implausible": F.coalesce(F.col("implausible") | (every(19, 2) & F.col("violent_rate").isNotNull()), F.lit(False)),
        "officers_per_1k": F.when(every(3, 1), F.col("officers_per_1k") * 100).otherwise(F.col("officers_per_1k")),
    })
    nation = a.read("nation").select(F.col("n_name").alias("state"))
    return {"entity": entity, "nation": nation, "geography": geography, "population": population, "crime": crime, "staffing": staffing, "agency_year": agency_year, "finance": finance(a)}


def log(a: Analog, most: int | None = None) -> DataFrame:
    """All checks over the tables with faults, whose line items are read once for each table, not for each check."""
    return V.run_checks(tables(Counted(a.spark, a.sf_dir)), most=most)


_K = "CAST(entity_id AS BIGINT)"
FINANCE_SQL = """(SELECT l_suppkey AS gov_id, CAST(year(l_shipdate) AS INT) AS data_year, CASE l_returnflag WHEN 'R' THEN 'E62' WHEN 'A' THEN 'F62' ELSE 'E01' END AS item, CAST(sum(floor(l_extendedprice)) AS BIGINT) AS amount,
    CASE l_suppkey % 6 WHEN 0 THEN 'reported' WHEN 1 THEN 'imputed' WHEN 2 THEN 'alternative_source' WHEN 3 THEN 'analyst_correction' ELSE 'unknown' END AS value_type, year(l_shipdate) % 5 = 2 AS is_cog_year, s_name AS unit, s_nationkey,
    CASE WHEN s_suppkey IS NOT NULL THEN CASE WHEN s_suppkey % 4 = 0 THEN '0630' ELSE '1231' END END AS fiscal_year_ending FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_suppkey, year(l_shipdate), l_returnflag, s_suppkey, s_name, s_nationkey)"""
#: Common tables behind the analog's.
SQL = f""", e0 AS (SELECT *, CASE WHEN suppkey % 23 = 1 THEN lpad(CAST(suppkey + 1 AS VARCHAR), 9, '0') END AS covered_by FROM entity),
f_entity AS (SELECT * REPLACE (CASE WHEN suppkey % 17 = 5 THEN 'X' || substr(entity_id, 2, 8) ELSE entity_id END AS entity_id, CASE WHEN suppkey % 19 = 7 THEN 'ATLANTIS' ELSE state END AS state) FROM (SELECT * FROM e0 UNION ALL SELECT * FROM e0 WHERE suppkey % 20 = 3)),
f_geography AS (SELECT 'county' AS geo_level, 'county:' || lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS geo_id, CASE WHEN n_nationkey = 1 THEN '09001' WHEN n_nationkey % 10 = 3 THEN CAST(n_nationkey AS VARCHAR) ELSE lpad(CAST(n_nationkey AS VARCHAR), 5, '0') END AS geoid FROM nation
    UNION ALL SELECT 'state', 'state:' || CAST(r_regionkey AS VARCHAR), lpad(CAST(r_regionkey AS VARCHAR), 2, '0') FROM region),
c1 AS (SELECT * REPLACE (CASE WHEN {_K} % 31 = 4 AND data_year = 1998 THEN -offenses WHEN {_K} % 37 = 6 AND data_year = 1999 THEN offenses * 40 ELSE offenses END AS offenses, CASE WHEN {_K} % 41 = 8 THEN offenses * 2 ELSE clearances END AS clearances) FROM crime),
f_crime AS (SELECT * REPLACE (CAST(CASE WHEN {_K} % 43 = 9 AND data_year = 2001 THEN 2031 ELSE data_year END AS INT) AS data_year) FROM c1),
f_staffing AS (SELECT * REPLACE (CASE WHEN {_K} % 11 = 3 AND data_year = 1999 THEN 0 ELSE sworn END AS sworn, CASE WHEN {_K} % 47 = 10 AND data_year = 1997 THEN NULL ELSE source END AS source, CAST(CASE WHEN {_K} % 53 = 11 AND data_year = 2001 THEN 1959 ELSE data_year END AS INT) AS data_year) FROM staffing),
f_population AS (SELECT * REPLACE (CASE WHEN {_K} % 29 = 2 THEN -pep ELSE pep END AS pep) FROM population),
f_agency_year AS (SELECT * REPLACE (CASE WHEN violent_rate IS NULL AND {_K} % 7 = 1 THEN 50.0 WHEN {_K} % 19 = 2 THEN violent_rate * 1000 ELSE violent_rate END AS violent_rate, coalesce(implausible OR ({_K} % 19 = 2 AND violent_rate IS NOT NULL), false) AS implausible,
    CASE WHEN {_K} % 3 = 1 THEN officers_per_1k * 100 ELSE officers_per_1k END AS officers_per_1k) FROM agency_year),
f_finance AS {FINANCE_SQL}
"""

_YEAR = "entity_id, data_year, CAST({} AS VARCHAR) AS observed"
_NONE = "entity_id, CAST(NULL AS INT) AS data_year, CAST({} AS VARCHAR) AS observed"
#: By check: its findings over the common tables.
CHECK_SQL = {
    "entity_id_not_unique": f"SELECT {_NONE.format('count(*)')} FROM f_entity GROUP BY 1 HAVING count(*) > 1",
    "invalid_entity_code": f"SELECT {_NONE.format('entity_id')} FROM f_entity WHERE NOT regexp_full_match(entity_id, '[0-9]{{9}}')",
    "geoid_wrong_width": f"SELECT {_NONE.format('geoid').replace('entity_id', 'geo_id AS entity_id')} FROM f_geography WHERE (geo_level = 'state' AND length(geoid) <> 2) OR (geo_level = 'county' AND length(geoid) <> 5)",
    "abolished_county": f"SELECT {_NONE.format('geoid').replace('entity_id', 'geo_id AS entity_id')} FROM f_geography WHERE geo_level = 'county' AND geoid IN ('09001', '09003', '09005', '09007', '09009', '09011', '09013', '09015')",
    "unknown_state": f"SELECT {_NONE.format('state')} FROM f_entity WHERE state NOT IN (SELECT n_name FROM nation)",
    "negative_population": f"SELECT {_YEAR.format('pep')} FROM f_population WHERE pep < 0",
    "negative_count": f"SELECT {_YEAR.format('offenses')} FROM f_crime WHERE offenses < 0",
    "clearances_exceed_offenses": f"SELECT {_YEAR.format('clearances')} FROM f_crime WHERE clearances > offenses * 1.5",
    "year_out_of_range": f"SELECT {_YEAR.format('data_year')} FROM f_staffing WHERE NOT data_year BETWEEN 1960 AND 2025",
    "year_beyond_cutoff": f"SELECT {_YEAR.format('data_year')} FROM f_crime WHERE data_year > 2025",
    "zero_sworn_with_civilians": f"SELECT {_YEAR.format('civilian')} FROM f_staffing WHERE sworn = 0 AND civilian > 0",
    "staffing_dropped_to_zero": f"SELECT {_YEAR.format('p')} FROM (SELECT *, lag(sworn) OVER (PARTITION BY entity_id ORDER BY data_year) AS p FROM f_staffing) WHERE p > 20 AND sworn = 0",
    "count_jumped": "SELECT entity_id, data_year, CAST(p AS VARCHAR) || ' -> ' || CAST(offenses AS VARCHAR) AS observed FROM (SELECT *, lag(offenses) OVER (PARTITION BY entity_id, offense_group ORDER BY data_year) AS p FROM f_crime WHERE months_reported = 12) WHERE p >= 20 AND offenses >= 10 * p",
    "implausible_rate": f"SELECT {_YEAR.format('round(violent_rate, 6)')} FROM f_agency_year WHERE implausible AND pep >= 1000",
    "no_denominator_for_year": f"SELECT {_YEAR.format('violent_offenses')} FROM f_agency_year WHERE denominator IS NULL AND violent_offenses IS NOT NULL",
    "rate_across_years": f"SELECT {_YEAR.format(chr(39) + 'rate' + chr(39))} FROM f_agency_year a WHERE violent_rate IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f_population p WHERE p.entity_id = a.entity_id AND p.data_year = a.data_year AND p.denominator IS NOT NULL)",
    "rate_on_unaccepted_link": f"SELECT {_YEAR.format('review_status')} FROM f_agency_year WHERE violent_rate IS NOT NULL AND review_status <> 'accepted'",
    "rate_on_ineligible_kind": f"SELECT {_YEAR.format('kind')} FROM f_agency_year WHERE violent_rate IS NOT NULL AND kind IN ('state_police', 'university_police')",
    "rate_of_partial_year": f"SELECT {_YEAR.format('violent_months_reported')} FROM f_agency_year WHERE violent_rate IS NOT NULL AND violent_months_reported < 12",
    "likely_contract_policing": f"SELECT {_YEAR.format('round(officers_per_1k, 6)')} FROM f_agency_year WHERE officers_per_1k > 8 AND kind IN ('county_sheriff', 'county_police') AND denominator_basis = 'pep_county_balance'",
    "covered_by_parent": f"SELECT {_NONE.format('covered_by')} FROM f_entity WHERE covered_by IS NOT NULL",
    "unresolved_link": f"SELECT {_NONE.format('review_status')} FROM f_entity WHERE review_status <> 'accepted'",
    "amount_not_reported": "SELECT CAST(gov_id AS VARCHAR) AS entity_id, data_year, value_type AS observed FROM f_finance WHERE item = 'E62' AND value_type <> 'reported'",
    "fiscal_year_misaligned": "SELECT CAST(gov_id AS VARCHAR) AS entity_id, data_year, fiscal_year_ending AS observed FROM f_finance WHERE item = 'E62' AND fiscal_year_ending <> '1231'",
    "population_divergence": f"SELECT {_YEAR.format('open')} FROM f_population WHERE pep > 0 AND open IS NOT NULL AND abs(pep - open) * 1.0 / pep > 0.1",
    "missing_source": f"SELECT {_YEAR.format(chr(39) + 'none' + chr(39))} FROM f_staffing WHERE source IS NULL",
}
