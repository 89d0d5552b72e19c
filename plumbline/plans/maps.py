"""Queries of the map: features of its layers, legends, and rows that can't be placed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import settled
from . import published
from .catalogue import query, r6

YEAR, METRIC = 1999, "violent_rate"

#: Every seventh entity has no coordinates; entities of county level lie in the county that their state's number names, but for one state that has none.
SQL = f"""
, map_year AS (SELECT a.* REPLACE (CASE WHEN CAST(a.entity_id AS BIGINT) % 7 = 3 THEN NULL ELSE a.lat END AS lat), CASE WHEN e.geo_level = 'county' THEN 'county:' || lpad(CAST(n_nationkey AS VARCHAR), 5, '0') END AS geo_id
 FROM agency_year a JOIN entity e USING (entity_id) JOIN nation ON n_name = a.state WHERE a.data_year = {YEAR}),
map_agency AS (SELECT entity_id, name, kind, state, lat, lon, denominator, sworn, violent_months_reported, coverage, violent_rate_allowed, violent_withheld, denominator_type, confidence, {METRIC} AS value FROM map_year WHERE lat IS NOT NULL AND lon IS NOT NULL),
map_state AS (SELECT state, count(*) AS agencies, CAST(sum(sworn) AS BIGINT) AS sworn, CAST(sum(denominator) AS BIGINT) AS population, count(*) FILTER (violent_rate_allowed) AS reporting_agencies, median({METRIC}) AS value FROM map_year GROUP BY 1),
map_county AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS geoid, n_name AS name, r_name AS state, count(*) AS agencies, CAST(sum(sworn) AS BIGINT) AS sworn, median({METRIC}) AS value
 FROM map_year JOIN nation ON geo_id = 'county:' || lpad(CAST(n_nationkey AS VARCHAR), 5, '0') JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey <> 7 GROUP BY 1, 2, 3)
"""
RANKS = ", ".join(f"round(max(CASE WHEN r - 1 = least(n - 1, CAST(round_even({p} * (n - 1), 0) AS BIGINT)) THEN value END), 6) AS p{round(100 * p)}" for p in published.LEGEND)


def _year(a) -> DataFrame:
    number = a.read("nation").select(F.col("n_name").alias("state"), F.concat(F.lit("county:"), F.lpad(F.col("n_nationkey").cast("string"), 5, "0")).alias("county"))
    out = a.agency_year.join(number, "state").withColumn("lat", F.when(F.col("entity_id").cast("long") % 7 != 3, F.col("lat")))
    return out.join(a.entity.select("entity_id", F.col("geo_level").alias("level")), "entity_id").withColumn("geo_id", F.when(F.col("level") == "county", F.col("county"))).drop("level", "county")


def _geographies(a) -> DataFrame:
    """Nations but one as counties, and the regions as states."""
    k = F.lpad(F.col("n_nationkey").cast("string"), 5, "0")
    nation = a.read("nation").where("n_nationkey <> 7").join(a.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    counties = nation.select(F.concat(F.lit("county:"), k).alias("geo_id"), F.lit("county").alias("geo_level"), k.alias("geoid"), F.col("n_name").alias("name"), F.col("r_name").alias("state"))
    r = F.lpad(F.col("r_regionkey").cast("string"), 2, "0")
    return counties.unionByName(a.read("region").select(F.concat(F.lit("state:"), r).alias("geo_id"), F.lit("state").alias("geo_level"), r.alias("geoid"), F.col("r_name").alias("name"), F.col("r_name").alias("state")))


def _layer(a, layer: str) -> dict[str, DataFrame]:
    return published.map_layer(_year(a), YEAR, METRIC, layer, _geographies(a))


@query("q10_agency_map", f"{SQL} SELECT * REPLACE (round(value, 6) AS value) FROM map_agency")
def agency_map(a):
    return _layer(a, "entity")["features"].withColumn("value", F.round("value", 6))


@query("q10_agency_map_of_kind", f"{SQL} SELECT entity_id, round(value, 6) AS value FROM map_agency WHERE kind = 'county_sheriff'")
def agency_map_of_kind(a):
    return published.map_layer(_year(a), YEAR, METRIC, "entity", kind="county_sheriff")["features"].select("entity_id", r6("value"))


@query("q10_state_features", f"{SQL} SELECT * REPLACE (round(value, 6) AS value) FROM map_state")
def state_features(a):
    return _layer(a, "state")["features"].withColumn("value", F.round("value", 6))


@query("q10_county_map", f"{SQL} SELECT * REPLACE (round(value, 6) AS value) FROM map_county")
def county_map(a):
    return _layer(a, "county")["features"].withColumn("value", F.round("value", 6))


@query("q10_legends", f"""{SQL}, every AS (SELECT 'entity' AS layer, value FROM map_agency UNION ALL SELECT 'state', value FROM map_state UNION ALL SELECT 'county', value FROM map_county),
ranked AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY value NULLS LAST) AS r, count(value) OVER (PARTITION BY layer) AS n FROM every)
SELECT layer, count(*) FILTER (value IS NULL) AS without_value, count(value) AS with_value, round(min(value), 6) AS least, round(max(value), 6) AS most, {RANKS}, CASE WHEN layer = 'entity' THEN (SELECT count(*) FROM map_year WHERE lat IS NULL OR lon IS NULL) ELSE 0 END AS unplaced FROM ranked GROUP BY 1""")
def legends(a):
    """A row for each layer: its legend, and how many rows have no place on it."""
    year = settled(_year(a).where(F.col("data_year") == YEAR), "map_year")  # read by all layers
    parts = [published.map_layer(year, YEAR, METRIC, layer, _geographies(a)) for layer in ("entity", "state", "county")]
    rows = reduce(DataFrame.unionByName, (p["legend"].crossJoin(p["unplaced"]) for p in parts))  # a row each
    return rows.select("layer", "without_value", "with_value", *map(r6, ("least", "most", *(f"p{round(100 * p)}" for p in published.LEGEND))), "unplaced")
