"""Queries of the serving extract, releases, landing, source files, derived geography, invariants and resolution routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes
from ..operators import canonical as C
from ..operators import invariants, reconcile
from ..operators import linkage as L
from ..sources import delimited, releases, serving, sinks
from ..streaming.landing import land_new_files
from . import faulty, resolution
from .catalogue import ORACLE_SQL, query
from .registry import BUCKETS, _buckets

KEYS = ("entity_id", "data_year")


def extract(a) -> serving.Extract:
    """Counts of violent offences, staff and populations, in buckets of entity and year; the entities' addresses stay out."""
    crime = a.crime.where("offense_group = 'violent-crime'").select(*KEYS, "offenses", "months_reported")
    staffing = a.staffing.select(*KEYS, "sworn", "civilian")
    population = a.population.select(*KEYS, "denominator")
    return serving.publish_buckets({"crime": crime, "staffing": staffing, "population": population, "entity": a.entity}, dict.fromkeys(("crime", "staffing", "population"), KEYS), 8)


@query("s15_serving_star", "SELECT c.entity_id, c.data_year, offenses, months_reported, sworn, civilian, denominator FROM crime c JOIN staffing s ON s.entity_id = c.entity_id AND s.data_year = c.data_year JOIN population p ON p.entity_id = c.entity_id AND p.data_year = c.data_year WHERE offense_group = 'violent-crime'")
def serving_star(a):
    """The star over the extract, joined bucket by bucket."""
    return extract(a).join(["crime", "staffing", "population"], KEYS)


@query("s15_serving_manifest", "SELECT 'crime' AS table_name, true AS published, count(*) AS rows FROM crime WHERE offense_group = 'violent-crime' UNION ALL SELECT 'staffing', true, count(*) FROM staffing UNION ALL SELECT 'population', true, count(*) FROM population UNION ALL SELECT 'entity', false, NULL")
def serving_manifest(a):
    return extract(a).manifest


def _staff_findings(a):
    """Load-time findings of staffing records: those under a key of several suppliers."""
    rows = a.staffing.where("CAST(entity_id AS BIGINT) % 9 = 0")
    return rows.select(F.lit("duplicate_record").alias("check_id"), F.lit("info").alias("severity"), F.lit("staffing").alias("table_name"), "entity_id", "data_year", F.col("total").cast("string").alias("observed"), F.lit("several records").alias("message"))


def _found(a, share):
    """Findings of a run's checks: partial years, of one entity in `share`."""
    rows = a.crime.where((F.col("months_reported") < 12) & (F.col("entity_id").cast("long") % share == 0))
    return rows.select(F.lit("partial_year").alias("check_id"), F.lit("warning").alias("severity"), F.lit("crime").alias("table_name"), "entity_id", "data_year", F.col("months_reported").cast("string").alias("observed"), F.lit("a year isn't whole").alias("message"))


RELEASED = ("release_2026_01_01_001", "release_2026_01_01_002")


def released(a) -> str:
    """A folder with two releases, the first of which was run twice, the second time with other tables and checks and without its loaders."""
    base, found, loaded = sinks.landing_folder(a.spark), _found(a, 3), _staff_findings(a)
    releases.write_release(base, RELEASED[0], {"crime": a.crime.limit(0), "staffing": a.staffing}, found, loaded)
    releases.write_release(base, RELEASED[1], {"entity": a.entity}, found.limit(0), loaded.limit(0))
    releases.write_release(base, RELEASED[0], {"crime": a.crime, "entity": a.entity}, _found(a, 2))
    return base


@query("s19_release_slices", f"SELECT '{RELEASED[0]}' AS release_id, 'crime' AS table_name, count(*) AS rows FROM crime UNION ALL SELECT '{RELEASED[0]}', 'entity', count(*) FROM entity UNION ALL SELECT '{RELEASED[1]}', 'entity', count(*) FROM entity")
def release_slices(a):
    """A second run replaces a release's rows, and other releases stay."""
    return releases.read_releases(a.spark, released(a), "manifest").select("release_id", "table_name", "rows")


@query("s19_release_validation", f"""SELECT r AS release_id, severity, CASE WHEN r = '{RELEASED[1]}' THEN 0 WHEN severity = 'warning' THEN w WHEN severity = 'info' THEN i ELSE 0 END AS findings, CASE WHEN r = '{RELEASED[1]}' THEN 0 WHEN severity = 'warning' AND w > 0 THEN 1 WHEN severity = 'info' AND i > 0 THEN 1 ELSE 0 END AS checks
 FROM (VALUES ('{RELEASED[0]}'), ('{RELEASED[1]}')) a(r), (VALUES ('error'), ('warning'), ('info')) s(severity), (SELECT count(*) AS w FROM crime WHERE months_reported < 12 AND CAST(entity_id AS BIGINT) % 2 = 0), (SELECT count(*) AS i FROM staffing WHERE CAST(entity_id AS BIGINT) % 9 = 0)""")
def release_validation(a):
    """Load-time findings of the first run are still there after the second one, findings of checks are the second's."""
    return releases.read_releases(a.spark, released(a), "validation").select("release_id", "severity", "findings", "checks")


@query("s18_source_fingerprints", """WITH f AS (SELECT 'region-' || CAST(n_regionkey AS VARCHAR) AS source_id, sha256(n_name || chr(10)) AS h, length(n_name) + 1 AS bytes FROM nation),
p AS (SELECT source_id, substr(h, 1, 3) AS g, count(*) AS n, sum(bytes) AS bytes, sha256(string_agg(h, ',' ORDER BY h)) AS part FROM f GROUP BY 1, 2)
SELECT source_id, CAST(sum(n) AS BIGINT) AS artifacts, CAST(sum(bytes) AS BIGINT) AS bytes, sha256(string_agg(part, ',' ORDER BY g)) AS digest FROM p WHERE source_id <> 'region-4' GROUP BY 1 UNION ALL SELECT 'nothing', 0, 0, NULL
UNION ALL SELECT NULL, CAST(sum(n) AS BIGINT), CAST(sum(bytes) AS BIGINT), sha256(string_agg(part, ',' ORDER BY g)) FROM p WHERE source_id = 'region-4'""", prefix=False)
def fingerprints(a):
    """A file for each nation, in folders of regions; one source has no files, the files of one region have no source."""
    path = sinks.landing_folder(a.spark)
    nation = a.read("nation").select(F.col("n_regionkey").alias("source"), F.col("n_nationkey").alias("file"), F.col("n_name").alias("value"))
    nation.repartition("source", "file").write.partitionBy("source", "file").text(path)
    regions = a.read("region").where("r_regionkey <> 4").select(F.concat(F.lit("region-"), F.col("r_regionkey").cast("string")).alias("source_id"), F.concat(F.lit("source="), F.col("r_regionkey").cast("string")).alias("folder"))
    registry = regions.unionByName(a.spark.createDataFrame([("nothing", "source=nowhere")], "source_id string, folder string"))
    return releases.source_fingerprints(a.spark, path, registry)


@query("s13_landing", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year, o_orderstatus AS status FROM orders", prefix=False)
def landing(a):
    """Files land in two runs; the second takes only those that came meanwhile."""
    source, target = sinks.landing_folder(a.spark), sinks.landing_folder(a.spark)
    orders = a.read("orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("status"))
    for part in (F.col("year") <= 1996, F.col("year") > 1996, F.lit(False)):
        orders.where(part).write.mode("append").json(source)
        land_new_files(a.spark, source, target, f"{target}-checkpoint", "o_orderkey long, year int, status string").awaitTermination()
    return a.spark.read.parquet(target)


@query("s6_pipe_table", "SELECT lpad(CAST(n_nationkey AS VARCHAR), 7, '0') AS geoid, n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 'C' || CAST(n_nationkey % 10 AS VARCHAR) END AS class_code FROM nation", prefix=False)
def pipe_table(a):
    path = sinks.landing_folder(a.spark)
    cls = F.when(F.col("n_nationkey") % 3 == 0, None).otherwise(F.concat(F.lit("C"), (F.col("n_nationkey") % 10).cast("string")))
    a.read("nation").select(F.col("n_nationkey").cast("string").alias("GEOID"), F.concat(F.lit(" "), "n_name").alias("NAME"), cls.alias("CLASSFP")).write.option("header", True).option("sep", "|").csv(path)
    return delimited.pad_codes(delimited.read_delimited(a.spark, path), {"GEOID": 7}).select(F.col("GEOID").alias("geoid"), F.col("NAME").alias("name"), F.col("CLASSFP").alias("class_code"))


@query("s7_latin_csv", "SELECT CAST(s_suppkey AS VARCHAR) AS code, 'Señor ' || s_name || ', Doña' AS name FROM supplier", prefix=False)
def latin_csv(a):
    path = sinks.landing_folder(a.spark)
    a.read("supplier").select(F.col("s_suppkey").cast("string").alias("code"), F.concat(F.lit("Señor "), "s_name", F.lit(", Doña")).alias("name")).write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return delimited.read_delimited(a.spark, path, ",", "ISO-8859-1")


CLASSES = ("C1", "C7", "C8", "C9", "U1")


@query("c2_derived_geography", f"""WITH ua AS (SELECT c_custkey % 40 AS u, max(c_custkey * 700) AS population FROM customer GROUP BY 1),
parts AS (SELECT p_partkey % 200 AS place, lpad(CAST(p_partkey % 40 AS VARCHAR), 5, '0') AS uace, CAST(p_size AS DOUBLE) AS land, 'Area ' || CAST(p_partkey % 40 AS VARCHAR) AS urban_area FROM part WHERE p_partkey % 4 <> 3),
main AS (SELECT place, uace, min(urban_area) AS urban_area FROM parts p WHERE (land, uace) = (SELECT (max(land), (SELECT min(uace) FROM parts q WHERE q.place = p.place AND q.land = (SELECT max(land) FROM parts r WHERE r.place = p.place))) FROM parts s WHERE s.place = p.place) GROUP BY 1, 2),
place AS (SELECT s_suppkey AS k, s_name AS name, s_nationkey, CASE WHEN s_suppkey % 3 <> 2 THEN ({CLASSES!r}::VARCHAR[])[s_suppkey % 5 + 1] END AS class_code FROM supplier)
SELECT 'place:' || lpad(CAST(k AS VARCHAR), 7, '0') AS geo_id, 'place' AS geo_level, name, substr(lpad(CAST(k AS VARCHAR), 7, '0'), 1, 2) AS state_fips, class_code, m.uace, m.urban_area, CASE WHEN population >= 200000 THEN 'Large urban' WHEN population >= 50000 THEN 'Urban' WHEN population >= 5000 THEN 'Small urban' ELSE 'Rural' END AS urbanicity,
 coalesce(class_code = 'C7', false) AS is_independent_city, coalesce(class_code IN ('C8', 'C9'), false) AS is_consolidated FROM place LEFT JOIN main m ON m.place = k LEFT JOIN ua ON ua.u = CAST(m.uace AS INT)
UNION ALL SELECT 'county:' || lpad(CAST(n_nationkey AS VARCHAR), 5, '0'), 'county', n_name, substr(lpad(CAST(n_nationkey AS VARCHAR), 5, '0'), 1, 2), NULL, NULL, NULL, NULL, false, false FROM nation WHERE n_nationkey <> 7
UNION ALL SELECT 'cousub:' || lpad(CAST(c_custkey AS VARCHAR), 10, '0'), 'cousub', c_name, substr(lpad(CAST(c_custkey AS VARCHAR), 10, '0'), 1, 2), NULL, NULL, NULL, NULL, false, false FROM customer
UNION ALL SELECT 'state:' || lpad(CAST(r_regionkey AS VARCHAR), 2, '0'), 'state', r_name, lpad(CAST(r_regionkey AS VARCHAR), 2, '0'), NULL, NULL, NULL, NULL, false, false FROM region""".replace("('C1', 'C7', 'C8', 'C9', 'U1')::VARCHAR[]", "['C1', 'C7', 'C8', 'C9', 'U1']"), prefix=False)
def derived_geography(a):
    """Nations as counties, suppliers as places, customers as subdivisions, regions as states; parts say which urban areas a place lies in."""
    k, of = F.col("s_suppkey"), lambda t, key, name: a.read(t).select(F.col(key).cast("string").alias("geoid"), F.col(name).alias("name"), F.lit("X").alias("state"))
    classes = a.read("supplier").where("s_suppkey % 3 <> 2").select(k.cast("string").alias("geoid"), F.element_at(F.array(*map(F.lit, CLASSES)), (k % 5 + 1).cast("int")).alias("class_code"))
    part = F.col("p_partkey")
    parts = a.read("part").select((part % 200).cast("string").alias("geoid"), F.when(part % 4 != 3, (part % 40).cast("string")).otherwise(" ").alias("uace"), F.concat(F.lit("Area "), (part % 40).cast("string")).alias("urban_area"), F.col("p_size").cast("double").alias("land"))
    areas = a.read("customer").select((F.col("c_custkey") % 40).cast("string").alias("uace"), (F.col("c_custkey") * 700).alias("population"))
    states = a.read("region").select(codes.pad(F.col("r_regionkey"), 2).alias("code"), F.col("r_name").alias("state"))
    out = C.geography_levels(of("nation", "n_nationkey", "n_name"), of("supplier", "s_suppkey", "s_name"), of("customer", "c_custkey", "c_name"), states, classes, parts, areas, ["county:00007"])
    return out.select("geo_id", "geo_level", "name", "state_fips", "class_code", "uace", "urban_area", "urbanicity", "is_independent_city", "is_consolidated")


def spoilt(a) -> dict:
    """The faulty tables with keys, levels of attribution and a year without staff."""
    t = faulty.tables(a)
    k = F.col("suppkey")
    legacy = F.when(k % 4 != 3, F.concat(F.lpad(k.cast("string"), 7, "0"), F.lit("00")))
    entity = a.entity.select("entity_id", legacy.alias("legacy_key"), F.when(k % 13 == 4, F.lit("0000000")).otherwise(F.lpad(k.cast("string"), 7, "0")).alias("key"))
    finance = t["finance"].withColumn("attribution_level", F.when(F.col("gov_id") % 9 == 2, "entity").when(F.col("gov_id") % 9 != 3, "government_unit"))
    staffing = t["staffing"].withColumn("sworn", F.when(F.col("data_year") == 1996, 0).otherwise(F.col("sworn")))
    sources = a.spark.createDataFrame([("monthly",), ("pe",)], "source string")
    return {**t, "entity": entity, "finance": finance, "staffing": staffing, "dim_source": sources}


@query("v27_invariants", f"""{faulty.SQL}, f_staff AS (SELECT * REPLACE (CASE WHEN data_year = 1996 THEN 0 ELSE sworn END AS sworn) FROM f_staffing)
SELECT 'source_is_named' AS invariant, 'crime' AS table_name, count(*) AS violations FROM f_crime WHERE source IS NULL UNION ALL SELECT 'source_is_known', 'crime', count(*) FROM f_crime WHERE source NOT IN ('monthly', 'pe')
UNION ALL SELECT 'source_is_named', 'staffing', count(*) FROM f_staff WHERE source IS NULL UNION ALL SELECT 'source_is_known', 'staffing', count(*) FROM f_staff WHERE source NOT IN ('monthly', 'pe')
UNION ALL SELECT 'no_rate_of_a_partial_year', 'agency_year', count(*) FROM f_agency_year WHERE violent_rate IS NOT NULL AND coalesce(violent_months_reported, 0) < 12 UNION ALL SELECT 'no_rate_on_an_unaccepted_link', 'agency_year', count(*) FROM f_agency_year WHERE violent_rate IS NOT NULL AND review_status <> 'accepted'
UNION ALL SELECT 'attributed_to_governments', 'finance', count(*) FROM f_finance WHERE gov_id % 9 IN (2, 3) UNION ALL SELECT 'key_is_the_legacy_keys_beginning', 'entity', count(*) FROM entity WHERE suppkey % 4 <> 3 AND suppkey % 13 = 4
UNION ALL SELECT 'no_zero_filled_year', 'staffing', count(*) FROM (SELECT data_year FROM f_staff GROUP BY 1 HAVING sum(sworn) = 0)""")
def invariant_counts(a):
    return invariants.check_invariants(spoilt(a))


_RESOLVED = ORACLE_SQL["r10_resolution"]


@query("q11_unmatched_by_kind", f"SELECT kind, review_status, method, count(*) AS n FROM ({_RESOLVED}) JOIN ({resolution.ENTITY_SQL}) USING (entity_id) GROUP BY ALL", prefix=False)
def unmatched_by_kind(a):
    """Kinds by what became of them: status and route of every entity."""
    some = resolution.entities(a)
    out = L.resolve(some, resolution.geographies(a), resolution.TOWN_STATES)
    return out.join(some.select("entity_id", "kind").hint("merge"), "entity_id").groupBy("kind", "review_status", "method").agg(F.count("*").alias("n"))


@query("q11_identifier_routes", f"SELECT p_type AS kind, CASE bucket WHEN 'unique_key' THEN 'unique' WHEN 'ambiguous' THEN 'contested' ELSE 'none' END AS route, count(*) AS records, CAST(sum(amount) AS BIGINT) AS total FROM ({BUCKETS}) JOIN part ON p_partkey = record GROUP BY ALL", prefix=False)
def identifier_routes(a):
    """The ledger's buckets by kind; all routes together are the ledger."""
    kinds = a.read("part").select(F.col("p_partkey").alias("record"), F.col("p_type").alias("kind"))
    return reconcile.routes(_buckets(a).join(kinds.hint("merge"), "record"), "kind", "amount")


@query("q11_identifiers", "SELECT count(*) AS entities, count(*) FILTER (suppkey % 4 <> 3) AS from_legacy, count(*) FILTER (suppkey % 4 = 3) AS fallback, count(*) FILTER (suppkey % 4 = 3) AS no_legacy, (SELECT count(*) FROM (SELECT CASE WHEN suppkey % 13 = 4 THEN '0000000' ELSE lpad(CAST(suppkey AS VARCHAR), 7, '0') END AS k, count(*) AS n FROM entity GROUP BY 1) WHERE n > 1) AS shared_keys FROM entity")
def identifiers(a):
    e = spoilt(a)["entity"].withColumn("origin", F.when(F.col("legacy_key").isNotNull(), "legacy").otherwise("fallback"))
    return reconcile.identifiers(e, "key", "legacy_key", "origin")


@query("k5_headline", f"WITH b AS ({BUCKETS}) SELECT true AS available, CAST(sum(amount) AS BIGINT) AS source_total, CAST(sum(amount) FILTER (bucket = 'unique_key') AS BIGINT) AS platform_total, CAST(coalesce(sum(amount) FILTER (bucket = 'out_of_scope'), 0) AS BIGINT) AS out_of_scope, CAST(coalesce(sum(amount) FILTER (bucket = 'ambiguous'), 0) AS BIGINT) AS ambiguous, CAST(coalesce(sum(amount) FILTER (bucket = 'unresolved'), 0) AS BIGINT) AS unresolved, count(*) FILTER (bucket <> 'unique_key') AS excluded_records, CAST(0 AS BIGINT) AS residual FROM b", prefix=False)
def ledger_headline(a):
    totals = reconcile.bucket_totals(_buckets(a), "amount")
    sums = totals.withColumns({"_all": F.sum("total").over(_whole()), "_own": F.sum(F.when(F.col("bucket") == "unique_key", F.col("total"))).over(_whole())})
    return reconcile.headline(sums, F.col("_own"), F.col("_all"), {b: b for b in ("out_of_scope", "ambiguous", "unresolved")})


def _whole():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))  # a row for each bucket
