"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import codes, measures, names, policy
from ..operators import aggregates as A
from ..operators import canonical as C
from ..operators import linkage as L
from ..operators import quality as V
from ..operators import reconcile as K
from ..operators import windows as W
from ..sources import delimited, fixed_width, records, sinks
from . import analog, faulty, published
from .catalogue import ORACLE_SQL, QUERIES, query, r6

# --- flagship: the count survives, the rate is withheld with a reason ------------------------------------------------

PUBLISHED = ["entity_id", "data_year", "violent_offenses", "violent_months_reported", "denominator", "denominator_basis", "denominator_type", "confidence", "coverage", "violent_rate_allowed", "violent_withheld"]


@query("g9_policy_pass", f"SELECT {', '.join(PUBLISHED)}, round(violent_rate, 6) AS violent_rate, property_rate_allowed, round(property_rate, 6) AS property_rate, property_withheld, round(officers_per_1k, 6) AS officers_per_1k, implausible, warning FROM agency_year")
def policy_pass(a):
    return a.agency_year.select(*PUBLISHED, r6("violent_rate"), "property_rate_allowed", r6("property_rate"), "property_withheld", r6("officers_per_1k"), "implausible", "warning")


# --- sources: records are rendered from the tables, parsed again and compared with the tables -------------------------

ORDER_LAYOUT = {"record_type": (0, 1), "key": (1, 13), "status": (13, 14), "price": (15, 27), "year2": (27, 29), "priority": (30, 46)}


@query("s1_fixed_width_scan", "SELECT o_orderkey AS key, o_orderstatus AS status, CAST(floor(o_totalprice) AS BIGINT) AS price, CAST(year(o_orderdate) AS INT) AS data_year, o_orderpriority AS priority FROM orders WHERE o_orderkey % 7 <> 0", prefix=False)
def fixed_width_scan(a):
    kind = F.when(F.col("o_orderkey") % 7 != 0, "5").otherwise("1")
    line = fixed_width.render(ORDER_LAYOUT, 50, {"record_type": (kind, False), "key": (F.col("o_orderkey"), True), "status": (F.col("o_orderstatus"), False), "price": (F.floor("o_totalprice").cast("long"), True), "year2": (F.date_format("o_orderdate", "yy"), False), "priority": (F.col("o_orderpriority"), False)})
    path = sinks.landing_folder(a.spark)
    a.read("orders").select(line.alias("value")).write.option("encoding", "ISO-8859-1").text(path)
    got = fixed_width.read_fixed_width(a.spark, path, ORDER_LAYOUT, numbers=("key", "price"), least=50, where=lambda c: c.startswith("5"))
    return got.select("key", "status", "price", fixed_width.full_year(F.col("year2")).alias("data_year"), "priority")


@query("s2_finance_amounts", "SELECT lpad(CAST(l_suppkey AS VARCHAR), 12, '0') AS gov_id, CASE WHEN l_returnflag = 'R' THEN 'E62' ELSE 'F62' END AS item, CAST(sum(floor(l_extendedprice)) AS BIGINT) * (CASE WHEN l_returnflag = 'A' THEN -1 ELSE 1 END) AS amount, CAST(year(l_shipdate) AS BIGINT) AS data_year, l_linestatus AS flag FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY l_suppkey, l_returnflag, year(l_shipdate), l_linestatus", prefix=False)
def finance_amounts(a):
    item = F.when(F.col("l_returnflag") == "R", "E62").when(F.col("l_returnflag") == "A", "F62").otherwise("T01")
    sums = a.read("lineitem").groupBy("l_suppkey", "l_returnflag", item.alias("item"), F.year("l_shipdate").alias("y"), "l_linestatus").agg(F.sum(F.floor("l_extendedprice")).cast("long").alias("amount"))
    signed = F.when(F.col("l_returnflag") == "A", -F.col("amount")).otherwise(F.col("amount"))
    line = fixed_width.render(fixed_width.FINANCE_AMOUNTS, 32, {"gov_id": (F.lpad(F.col("l_suppkey").cast("string"), 12, "0"), False), "item": (F.col("item"), False), "amount": (signed, True), "data_year": (F.col("y"), False), "flag": (F.col("l_linestatus"), False)})
    path = sinks.landing_folder(a.spark)
    sums.select(line.alias("value")).write.text(path)
    return fixed_width.read_finance_amounts(a.spark, path, ["E62", "F62"]).select("gov_id", "item", "amount", "data_year", "flag")


@query("s3_unit_directory", "SELECT lpad(CAST(s_suppkey AS VARCHAR), 12, '0') AS gov_id, s_name AS name, n_name AS county, lpad(CAST(s_nationkey AS VARCHAR), 5, '0') AS place_code FROM supplier JOIN nation ON s_nationkey = n_nationkey", prefix=False)
def unit_directory(a):
    s = a.read("supplier").join(a.read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    short = {k: v for k, v in fixed_width.UNIT_DIRECTORY.items() if k in ("gov_id", "name", "county", "place_code")}
    line = F.rtrim(fixed_width.render(short, 116, {"gov_id": (F.lpad(F.col("s_suppkey").cast("string"), 12, "0"), False), "name": (F.col("s_name"), False), "county": (F.col("n_name"), False), "place_code": (F.lpad(F.col("s_nationkey").cast("string"), 5, "0"), False)}))
    path = sinks.landing_folder(a.spark)
    s.select(line.alias("value")).write.text(path)
    return fixed_width.read_unit_directory(a.spark, path).select(*short)


@query("s10_monthly_json", "SELECT suppkey, offense_group, period, CAST(n AS DOUBLE) AS value FROM monthly")
def monthly_json(a):
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("period", "n"))))
    body = F.to_json(F.struct(F.struct(F.create_map(F.lit("X Offenses"), counts).alias("actuals")).alias("offenses")))
    raw = a.monthly.groupBy("suppkey", "offense_group").agg(body.alias("body"))
    path = sinks.landing_folder(a.spark)
    raw.write.option("compression", "gzip").json(path)
    landed = records.read_json(a.spark, path, "suppkey long, offense_group string, body string")
    parsed = C.pick_series(C.monthly_json(landed, ["suppkey", "offense_group"], "body"), ["suppkey", "offense_group"], " Offenses")
    return parsed.select("suppkey", "offense_group", "period", "value")


@query("s17_csv_rows", "SELECT concat_ws(',', entity_id, CAST(data_year AS VARCHAR), '\"' || replace(name, '\"', '\"\"') || '\"', CASE WHEN violent_rate_allowed THEN CAST(CAST(round(violent_rate) AS BIGINT) AS VARCHAR) ELSE '' END, coalesce(violent_withheld, '')) AS line FROM agency_year")
def csv_rows(a):
    quoted = F.concat(F.lit('"'), F.replace("name", F.lit('"'), F.lit('""')), F.lit('"'))
    rate = F.when(F.col("violent_rate_allowed"), F.round("violent_rate").cast("long").cast("string")).otherwise("")
    return a.agency_year.select(F.concat_ws(",", "entity_id", F.col("data_year").cast("string"), quoted, rate, F.coalesce("violent_withheld", F.lit(""))).alias("line"))


@query("s19_release_manifest", "SELECT 'release_2026_01_01_001' AS release_id, * FROM (SELECT 'entity' AS table_name, count(*) AS rows FROM entity UNION ALL SELECT 'crime', count(*) FROM crime UNION ALL SELECT 'staffing', count(*) FROM staffing UNION ALL SELECT 'agency_year', count(*) FROM agency_year)")
def manifest(a):
    from ..sources.sinks import release_manifest

    return release_manifest({"entity": a.entity, "crime": a.crime, "staffing": a.staffing, "agency_year": a.agency_year}, "release_2026_01_01_001")


# --- canonical builders -----------------------------------------------------------------------------------------------


@query("c1_dim_time", "SELECT DISTINCT CAST(year(l_shipdate) AS INT) AS data_year, year(l_shipdate) <= 2000 AS is_complete, year(l_shipdate) <= 2000 AS crime_usable, year(l_shipdate) % 5 = 2 AS is_cog_year, nullif(concat_ws(' ', CASE WHEN year(l_shipdate) > 2000 THEN 'year in progress' END, CASE WHEN year(l_shipdate) % 5 = 2 THEN 'census of governments year' END), '') AS notes FROM lineitem", prefix=False)
def dim_time(a):
    years = a.read("lineitem").select(F.year("l_shipdate").alias("data_year")).distinct()
    return C.dim_time(a.spark, 1985, 2026, 2000).join(years, "data_year", "left_semi")


@query("c2_dim_geography", "SELECT 'county:' || lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS geo_id, 'county' AS geo_level, n_name AS name FROM nation WHERE n_nationkey <> 7 UNION ALL SELECT 'state:' || lpad(CAST(r_regionkey AS VARCHAR), 2, '0'), 'state', r_name FROM region UNION ALL SELECT 'place:' || lpad(CAST(s_suppkey AS VARCHAR), 7, '0'), 'place', s_name FROM supplier", prefix=False)
def dim_geography(a):
    parts = {"county": a.read("nation").select(codes.pad(F.col("n_nationkey"), 5).alias("geoid"), F.col("n_name").alias("name")), "state": a.read("region").select(codes.pad(F.col("r_regionkey"), 2).alias("geoid"), F.col("r_name").alias("name")), "place": a.read("supplier").select(codes.pad(F.col("s_suppkey"), 7).alias("geoid"), F.col("s_name").alias("name"))}
    return C.dim_geography(parts, drop_ids=["county:00007"]).select("geo_id", "geo_level", "name")


@query("c3_argmax_pick", "SELECT l_suppkey, arg_min(l_partkey, l_partkey) AS l_partkey, min(q) AS q FROM (SELECT l_suppkey, l_partkey, sum(l_quantity) AS q, max(sum(l_quantity)) OVER (PARTITION BY l_suppkey) AS top FROM lineitem GROUP BY 1, 2) WHERE q = top GROUP BY 1", prefix=False)
def argmax_pick(a):
    parts = a.read("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    return C.argmax_per(parts, ["l_suppkey"], "q", "l_partkey", ["q"])


@query("c4_urbanicity", "SELECT p_partkey, CASE WHEN p_partkey * 100 >= 200000 THEN 'Large urban' WHEN p_partkey * 100 >= 50000 THEN 'Urban' WHEN p_partkey * 100 >= 5000 THEN 'Small urban' ELSE 'Rural' END AS urbanicity FROM part", prefix=False)
def urban(a):
    return a.read("part").select("p_partkey", measures.urbanicity(F.col("p_partkey") * 100).alias("urbanicity"))


@query("c5_latest_wins", "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1", prefix=False)
def latest(a):
    return C.latest_wins(a.read("orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")


@query("c6_antijoin_append", "SELECT c_custkey AS k, 'ordered' AS label FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'fallback' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", prefix=False)
def append(a):
    spine = a.read("orders").select(F.col("o_custkey").alias("k")).distinct().join(a.read("customer").select(F.col("c_custkey").alias("k")), "k", "left_semi").withColumn("label", F.lit("ordered"))
    return C.append_missing(spine, a.read("customer").select(F.col("c_custkey").alias("k"), F.lit("fallback").alias("label")), ["k"])


@query("c7_enrichment", "SELECT e.entity_id, kind, CASE WHEN kind = 'state_police' THEN 'statewide' WHEN kind = 'county_sheriff' THEN 'county' ELSE 'local' END AS jurisdiction, kind IN ('municipal_police', 'county_sheriff') AS eligible, c.n_links FROM entity e LEFT JOIN (SELECT l_suppkey, count(DISTINCT l_orderkey) AS n_links FROM lineitem GROUP BY 1) c ON c.l_suppkey = e.suppkey")
def enrichment(a):
    n = a.read("lineitem").groupBy(F.col("l_suppkey").alias("suppkey")).agg(F.count_distinct("l_orderkey").alias("n_links"))
    place = F.when(F.col("kind") == "state_police", "statewide").when(F.col("kind") == "county_sheriff", "county").otherwise("local")
    return a.entity.join(n, "suppkey", "left").select("entity_id", "kind", place.alias("jurisdiction"), F.col("kind").isin(*analog.ELIGIBLE).alias("eligible"), "n_links")


@query("c8_change_events", "SELECT o_orderkey, 'cancelled' AS event, o_orderstatus AS detail FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'large', CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) FROM orders WHERE o_totalprice > 300000", prefix=False)
def events(a):
    return C.change_events(a.read("orders"), ["o_orderkey"], {"cancelled": (F.col("o_orderstatus") == "F", F.col("o_orderstatus")), "large": (F.col("o_totalprice") > 300000, F.floor("o_totalprice").cast("long"))})


@query("c10_staffing_fact", "SELECT entity_id, data_year, source, sworn, civilian, total FROM staffing")
def staffing(a):
    return a.staffing.select("entity_id", "data_year", "source", "sworn", "civilian", "total")


@query("c11_conflict_resolution", "SELECT l_orderkey, l_suppkey, CAST(max(l_quantity) AS BIGINT) AS total, count(DISTINCT l_quantity) > 1 AS conflict FROM lineitem GROUP BY 1, 2", prefix=False)
def conflicts(a):
    li = a.read("lineitem").select("l_orderkey", "l_suppkey", F.col("l_quantity").cast("long").alias("total"), "l_linenumber")
    best = C.latest_wins(li, ["l_orderkey", "l_suppkey"], "total", "l_linenumber")
    n = li.groupBy("l_orderkey", "l_suppkey").agg((F.count_distinct("total") > 1).alias("conflict"))
    return best.drop("l_linenumber").join(n, ["l_orderkey", "l_suppkey"])


@query("c12_second_source", "SELECT entity_id, data_year, total, source FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, data_year ORDER BY CASE WHEN source = 'pe' THEN 1 ELSE 2 END) AS r FROM (SELECT entity_id, data_year, total, source FROM staffing UNION ALL SELECT entity_id, data_year, sworn AS total, 'inline' FROM staffing)) WHERE r = 1")
def second_source(a):
    both = a.staffing.select("entity_id", "data_year", "total", "source").unionByName(a.staffing.select("entity_id", "data_year", F.col("sworn").alias("total"), F.lit("inline").alias("source")))
    return C.pick_source(both, ["entity_id", "data_year"], "source", ["pe", "api", "inline"])


ORACLE_SQL["c12_second_source"] = ORACLE_SQL["c12_second_source"].replace("CASE WHEN source = 'pe' THEN 1 ELSE 2 END", "CASE source WHEN 'pe' THEN 1 WHEN 'api' THEN 2 ELSE 3 END")


@query("c13_reporting_flags", "SELECT o_custkey, o_orderpriority IN ('1-URGENT', '2-HIGH') AS participated FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1", prefix=False)
def reporting(a):
    flag = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), " yes").otherwise("n")
    return C.first_wins(a.read("orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", codes.to_flag(flag).alias("participated"))


@query("c14_unpivot_years", "SELECT l_suppkey, CAST(year(l_shipdate) AS INT) AS data_year, CAST(sum(l_quantity) AS BIGINT) AS population FROM lineitem GROUP BY 1, 2", prefix=False)
def unpivot(a):
    years = sorted(r[0] for r in a.read("lineitem").select(F.year("l_shipdate")).distinct().collect())  # one row a year
    wide = a.read("lineitem").groupBy("l_suppkey").agg(*[F.sum(F.when(F.year("l_shipdate") == y, F.col("l_quantity"))).cast("long").alias(f"POPESTIMATE{y}") for y in years])
    return C.unpivot_years(wide, ["l_suppkey"], "POPESTIMATE")


@query("c16_apportioned_balance", """SELECT geo || '#balance' AS geo, data_year, CAST(round_even(greatest(population - coalesce(inside, 0), 0), 0) AS BIGINT) AS population FROM
 (SELECT lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS geo, n_nationkey FROM nation) c CROSS JOIN (SELECT DISTINCT CAST(year(l_shipdate) AS INT) AS data_year FROM lineitem) y
 JOIN (SELECT s_nationkey, CAST(year(l_shipdate) AS INT) AS py, CAST(sum(l_quantity) AS BIGINT) AS population FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2) p ON p.s_nationkey = c.n_nationkey AND p.py = y.data_year
 LEFT JOIN (SELECT county, iy, sum(q / 2.0) AS inside FROM (SELECT s_nationkey AS county, l_suppkey, CAST(year(l_shipdate) AS INT) AS iy, sum(l_quantity) AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_suppkey % 4 = 0 GROUP BY 1, 2, 3
   UNION ALL SELECT (s_nationkey + 1) % 25, l_suppkey, CAST(year(l_shipdate) AS INT), sum(l_quantity) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_suppkey % 4 = 0 GROUP BY 1, 2, 3) GROUP BY 1, 2) i ON i.county = c.n_nationkey AND i.iy = y.data_year""", prefix=False)
def balance(a):
    s, li = a.read("supplier"), a.read("lineitem")
    q = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_nationkey", "s_suppkey", F.year("l_shipdate").alias("data_year")).agg(F.sum("l_quantity").cast("long").alias("population"))
    geo = lambda c: codes.pad(c, 5)
    counties = q.groupBy("s_nationkey", "data_year").agg(F.sum("population").alias("population")).select(geo(F.col("s_nationkey")).alias("geo"), "data_year", "population")
    places = q.select(F.col("s_suppkey").cast("string").alias("geo"), "data_year", "population")
    klass = F.when(F.col("s_suppkey") % 4 == 0, "C1").otherwise("U1")
    bridge = s.select(F.col("s_suppkey").cast("string").alias("place"), F.explode(F.array(geo(F.col("s_nationkey")), geo((F.col("s_nationkey") + 1) % 25))).alias("county"), klass.alias("class_code"))
    return C.apportioned_balance(places, counties, bridge)


@query("c18_finance_fact", f"SELECT gov_id, data_year, item, amount, value_type, is_cog_year, unit FROM {faulty.FINANCE_SQL}", prefix=False)
def finance(a):
    return faulty.finance(a).select("gov_id", "data_year", "item", "amount", "value_type", "is_cog_year", "unit")


@query("m15_police_spending", f"SELECT s_nationkey, data_year, CAST(sum(CASE WHEN item = 'E62' THEN amount END) AS BIGINT) AS operations, CAST(sum(CASE WHEN item = 'F62' THEN amount END) AS BIGINT) AS construction, round(CASE WHEN sum(amount) > 0 THEN CAST(sum(CASE WHEN item = 'E62' THEN amount END) AS DOUBLE) / sum(amount) END, 6) AS share_of_all FROM {faulty.FINANCE_SQL} GROUP BY 1, 2", prefix=False)
def spending(a):
    """Operations and construction, and the share of all amounts that are there."""
    of = lambda item: F.sum(F.when(F.col("item") == item, F.col("amount")))
    sums = faulty.finance(a).groupBy("s_nationkey", "data_year").agg(of("E62").alias("operations"), of("F62").alias("construction"), F.sum("amount").alias("all"))
    return sums.select("s_nationkey", "data_year", "operations", "construction", F.round(measures.safe_ratio(F.col("operations"), F.col("all")), 6).alias("share_of_all"))


@query("c20_monthly_to_annual", "SELECT entity_id, data_year, offense_group, offenses, clearances, months_reported, value_type FROM crime")
def annual(a):
    return a.crime.drop("source")


# --- expressions ------------------------------------------------------------------------------------------------------


@query("p1_code_expressions", """SELECT s_suppkey, CASE WHEN length(CAST(s_suppkey AS VARCHAR)) < 5 THEN lpad(CAST(s_suppkey AS VARCHAR), 5, '0') ELSE CAST(s_suppkey AS VARCHAR) END AS padded, lpad(CAST(s_nationkey AS VARCHAR), 2, '0') || CASE WHEN length(CAST(s_suppkey AS VARCHAR)) < 5 THEN lpad(CAST(s_suppkey AS VARCHAR), 5, '0') ELSE CAST(s_suppkey AS VARCHAR) END AS place, lpad(CAST(s_nationkey AS VARCHAR), 5, '0') AS bare,
 CAST(trunc(s_acctbal) AS BIGINT) AS whole, s_suppkey % 3 = 0 AS flag FROM supplier""", prefix=False)
def code_expressions(a):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    return a.read("supplier").select(
        "s_suppkey", codes.pad(k, 5).alias("padded"), codes.place_geoid(n, k).alias("place"), codes.strip_geoidfq(F.concat(F.lit("0500000US"), F.lpad(n.cast("string"), 5, "0"))).alias("bare"),
        codes.to_int(F.format_string(" %.2f ", "s_acctbal")).alias("whole"), codes.to_flag(F.when(k % 3 == 0, " y ").otherwise("0")).alias("flag"),
    )


@query("p7_classify_names", "SELECT doc_id, CASE WHEN regexp_matches(upper(source), '\\bSRC1\\b') THEN 'one' WHEN regexp_matches(upper(source), 'SRC1') THEN 'teens' ELSE CASE lang WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' ELSE 'other' END END AS kind FROM documents", prefix=False)
def classify(a):
    return a.read("documents").select("doc_id", names.classify(F.col("source"), F.col("lang"), ((r"\bSRC1\b", "one"), ("SRC1", "teens")), {"en": "english", "fr": "french"}).alias("kind"))


@query("p8_normalize_names", r"SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(upper(p_name || ' City, Police Dept.'), '[^A-Z0-9]', ' ', 'g'), '\b(CITY|TOWN|POLICE|DEPT)\b', ' ', 'g'), ' +', ' ', 'g')) AS norm FROM part", prefix=False)
def normal_names(a):
    return a.read("part").select("p_partkey", names.normalize(F.concat("p_name", F.lit(" City, Police Dept.")), ("CITY", "TOWN", "POLICE", "DEPT")).alias("norm"))


@query("p10_display_name", "SELECT p_partkey, CASE WHEN p_brand IS NOT NULL AND trim(p_brand) <> '' AND NOT contains(lower(p_name), lower(p_brand)) THEN p_name || ' (' || p_brand || ')' ELSE p_name END AS display FROM part", prefix=False)
def display(a):
    return a.read("part").select("p_partkey", names.display_name(F.col("p_name"), F.col("p_brand")).alias("display"))


@query("p11_haversine", "SELECT entity_id, round(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(40.0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(40.0)) * pow(sin(radians(20.0 - lon) / 2), 2)))), 6) AS km FROM entity")
def haversine(a):
    return a.entity.select("entity_id", F.round(measures.haversine_km(F.col("lat"), F.col("lon"), F.lit(40.0), F.lit(20.0)), 6).alias("km"))


@query("p13_population_band", f"SELECT entity_id, data_year, {analog.BAND_SQL.format('pep')} AS band FROM population")
def bands(a):
    return a.population.select("entity_id", "data_year", measures.band(F.col("pep")).alias("band"))


@query("p14_guarded_ratios", "SELECT entity_id, data_year, CASE WHEN pep > 0 THEN round(CAST(open AS DOUBLE) * 1000.0 / pep, 6) END AS per_1k, CASE WHEN open <> 0 THEN round(CAST(abs(pep - open) AS DOUBLE) / open, 6) END AS divergence, CASE WHEN open <> 0 THEN round(CAST(pep - open AS DOUBLE) / abs(open) * 100, 6) END AS change FROM population")
def ratios(a):
    pep, o = F.col("pep"), F.col("open")
    return a.population.select("entity_id", "data_year", F.round(measures.safe_ratio(o, pep, 1000), 6).alias("per_1k"), F.round(measures.rel_divergence(pep, o), 6).alias("divergence"), F.round(measures.pct_change(o, pep), 6).alias("change"))


@query("p18_cohort_key", "SELECT entity_id, data_year, kind || ' | ' || coalesce(band, 'unknown') || ' | ' || coalesce(urbanicity, 'unknown') AS cohort_id FROM agency_year")
def cohort_keys(a):
    return a.agency_year.select("entity_id", "data_year", codes.cohort_key(F.col("kind"), F.col("band"), F.col("urbanicity")).alias("cohort_id"))


@query("p20_code_predicates", "SELECT entity_id, regexp_full_match(entity_id, '[0-9]{9}') AS nine, contains(lower(name), 'supplier') AS named, CASE WHEN 2026 - y <= 1 THEN 'current' WHEN 2026 - y <= 2 THEN 'recent' ELSE 'stale' END AS fresh FROM entity JOIN (SELECT entity_id AS i, max(data_year) AS y FROM crime GROUP BY 1) ON i = entity_id")
def predicates(a):
    y = a.crime.groupBy("entity_id").agg(F.max("data_year").alias("y"))
    return a.entity.join(y, "entity_id").select("entity_id", codes.code_ok(F.col("entity_id"), 9).alias("nine"), codes.contains_ci(F.col("name"), "SUPPLIER").alias("named"), codes.freshness(F.col("y"), 2026).alias("fresh"))


# --- joins ------------------------------------------------------------------------------------------------------------


@query("j2_years_by_entity", "SELECT e.entity_id, y.data_year, p.denominator, p.denominator_basis, s.sworn FROM entity e CROSS JOIN (SELECT DISTINCT data_year FROM crime) y LEFT JOIN population p ON p.entity_id = e.entity_id AND p.data_year = y.data_year LEFT JOIN staffing s ON s.entity_id = e.entity_id AND s.data_year = y.data_year")
def years_by_entity(a):
    years = a.read("lineitem").where(F.col("l_returnflag").isin("R", "A")).select(F.year("l_shipdate").alias("data_year")).distinct()
    keys = ["entity_id", "data_year"]
    spine = a.entity.select("entity_id").join(years.agg(F.collect_set("data_year").alias("ys"))).select("entity_id", F.explode("ys").alias("data_year"))
    return spine.join(a.population.select(*keys, "denominator", "denominator_basis"), keys, "left").join(a.staffing.select(*keys, "sworn"), keys, "left")


@query("j3_same_year_star", "SELECT entity_id, data_year, violent_offenses, violent_clearances, violent_months_reported, property_offenses, denominator, sworn, total FROM base")
def star(a):
    return a.base.select("entity_id", "data_year", "violent_offenses", "violent_clearances", "violent_months_reported", "property_offenses", "denominator", "sworn", "total")


@query("j5_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')", prefix=False)
def anti(a):
    return a.read("customer").join(a.read("orders").where("o_orderpriority = '1-URGENT'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("j7_semi_join", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50)", prefix=False)
def semi(a):
    return a.read("supplier").join(a.read("lineitem").where("l_quantity = 50"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").select("s_suppkey", "s_name")


@query("j8_status_inner_join", "SELECT c.entity_id, c.data_year, c.offenses, p.pep FROM crime c JOIN entity e ON e.entity_id = c.entity_id JOIN population p ON p.entity_id = c.entity_id AND p.data_year = c.data_year WHERE e.review_status = 'accepted' AND c.offense_group = 'violent-crime' AND p.pep >= 1000")
def inner(a):
    e = a.entity.where("review_status = 'accepted'").select("entity_id")
    return a.crime.where("offense_group = 'violent-crime'").join(e, "entity_id").join(a.population.where("pep >= 1000").select("entity_id", "data_year", "pep"), ["entity_id", "data_year"]).select("entity_id", "data_year", "offenses", "pep")


@query("j13_nearest", """SELECT entity_id, target_id, round(km, 6) AS km FROM (SELECT entity_id, target_id, km, row_number() OVER (PARTITION BY entity_id ORDER BY km, target_id) AS r FROM (SELECT a.entity_id, b.entity_id AS target_id,
 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS km FROM entity a JOIN entity b ON a.state = b.state AND a.entity_id <> b.entity_id) WHERE km <= 500) WHERE r = 1""")
def near(a):
    return L.nearest(a.entity, a.entity.withColumnRenamed("entity_id", "target_id"), "state", 500.0, others=True).select("entity_id", "target_id", r6("km"))


# --- linkage ----------------------------------------------------------------------------------------------------------


@query("r2_statewide_rule", "SELECT entity_id, CASE WHEN listed THEN 'state:' || state END AS target_id, CASE WHEN listed THEN 'type_rule' ELSE 'none' END AS method, CASE WHEN listed THEN 1.0 ELSE 0.0 END AS score, CASE WHEN listed THEN 'accepted' ELSE 'unmatched' END AS review_status FROM (SELECT e.*, n_nationkey % 4 <> 1 AS listed FROM entity e JOIN nation ON n_name = e.state) WHERE kind = 'state_police'")
def statewide(a):
    states = a.read("nation").where("n_nationkey % 4 <> 1").select(F.col("n_name").alias("state"), F.concat(F.lit("state:"), "n_name").alias("target_id"))
    return L.rule_links(a.entity, states, ["state_police"])


@query("r4_exact_name_links", """SELECT e.p_partkey AS entity_id, CASE WHEN n = 1 THEN lo WHEN n > 1 THEN NULL END AS only_target, coalesce(n, 0) AS n FROM part e LEFT JOIN (SELECT p_brand AS b, p_name AS m, count(*) AS n, min(p_partkey) AS lo FROM part GROUP BY 1, 2) t ON t.b = e.p_brand AND t.m = CASE WHEN e.p_partkey % 5 = 0 THEN e.p_name || ' ANNEX' ELSE e.p_name END""", prefix=False)
def exact_links(a):
    p = a.read("part")
    named = F.when(F.col("p_partkey") % 5 == 0, F.concat("p_name", F.lit(" ANNEX CITY"))).otherwise(F.concat("p_name", F.lit(" CITY")))
    left = p.select(F.col("p_partkey").alias("entity_id"), F.col("p_brand").alias("block"), names.normalize(named, ("CITY",)).alias("norm_name"))
    t = p.groupBy(F.col("p_brand").alias("block"), names.normalize(F.col("p_name"), ("CITY",)).alias("norm_name")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("lo"))
    return left.join(t, ["block", "norm_name"], "left").select("entity_id", F.when(F.col("n") == 1, F.col("lo")).alias("only_target"), F.coalesce("n", F.lit(0)).alias("n"))


@query("r11_unit_decode", "SELECT gov_id, geo_id FROM (SELECT lpad(CAST(s_nationkey AS VARCHAR), 2, '0') || CAST(s_suppkey % 4 AS VARCHAR) || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS gov_id, CASE WHEN s_suppkey % 4 = 1 AND s_suppkey % 5 = 0 THEN 'county:' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') WHEN s_suppkey % 4 IN (2, 3) THEN 'place:' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') || CASE WHEN s_suppkey % 5 = 0 THEN '99' ELSE '01' END || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') END AS geo_id FROM supplier) WHERE geo_id IS NOT NULL", prefix=False)
def decode(a):
    k, st = F.col("s_suppkey"), codes.pad(F.col("s_nationkey"), 2)
    units = a.read("supplier").select(F.concat(st, (k % 4).cast("string"), F.lpad(k.cast("string"), 9, "0")).alias("gov_id"), st.alias("state_fips"), F.concat(F.when(k % 5 == 0, "99").otherwise("01"), F.lpad((k % 1000).cast("string"), 3, "0")).alias("place_code"))
    return L.decode_units(units)


@query("r13_ambiguous_keys", "SELECT p_partkey, p_name, n AS matches FROM (SELECT p_partkey, p_name, count(*) OVER (PARTITION BY p_name, p_brand) AS n FROM part) WHERE n > 1", prefix=False)
def ambiguous(a):
    return L.ambiguous(a.read("part").withColumn("k", F.concat_ws("|", "p_name", "p_brand")), "k").select("p_partkey", "p_name", "matches")


# --- aggregates -------------------------------------------------------------------------------------------------------


def _q(c: str, p: float) -> str:
    return f"round(quantile_cont({c}, {p}), 6)"


@query("a1_cohort_benchmarks", f"SELECT cohort_id, data_year, count(*) AS cohort_size, {_q('officers_per_1k', 0.25)} AS officers_per_1k_p25, {_q('officers_per_1k', 0.5)} AS officers_per_1k_median, {_q('officers_per_1k', 0.75)} AS officers_per_1k_p75, {_q('violent_rate', 0.25)} AS violent_rate_p25, {_q('violent_rate', 0.5)} AS violent_rate_median, {_q('violent_rate', 0.75)} AS violent_rate_p75 FROM cohort GROUP BY 1, 2 HAVING count(*) >= 5")
def benchmarks(a):
    out = A.cohort_benchmarks(a.cohort, ["cohort_id", "data_year"], ["officers_per_1k", "violent_rate"])
    return out.select("cohort_id", "data_year", "cohort_size", *[r6(c) for c in out.columns[3:]])


@query("a2_state_year", "SELECT state, data_year, count(DISTINCT entity_id) AS entities, CASE WHEN count(participated) > 0 THEN count(DISTINCT CASE WHEN participated THEN entity_id END) END AS participants, CAST(sum(violent_offenses) AS BIGINT) AS offenses, round(CASE WHEN sum(CASE WHEN violent_months_reported >= 12 AND denominator > 0 THEN denominator END) > 0 THEN CAST(sum(CASE WHEN violent_months_reported >= 12 THEN violent_offenses END) AS DOUBLE) * 100000 / sum(CASE WHEN violent_months_reported >= 12 AND denominator > 0 THEN denominator END) END, 6) AS rate FROM (SELECT *, CASE WHEN data_year >= 1997 THEN total > 40 END AS participated FROM agency_year) GROUP BY 1, 2")
def by_state(a):
    rows = a.agency_year.select("entity_id", "state", "data_year", F.col("violent_offenses").alias("offenses"), F.col("violent_months_reported").alias("months_reported"), F.col("denominator").alias("population"), F.when(F.col("data_year") >= 1997, F.col("total") > 40).alias("participated"))
    return A.state_year(rows).withColumn("rate", F.round("rate", 6))


@query("a3_coverage", "SELECT state, data_year, CAST(sum(CASE WHEN m >= 12 THEN 1 ELSE 0 END) AS BIGINT) AS full_reporters, CAST(sum(CASE WHEN m > 0 AND m < 12 THEN 1 ELSE 0 END) AS BIGINT) AS partial_reporters, CAST(sum(CASE WHEN m <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS non_reporters, CAST(sum(denominator) AS BIGINT) AS population_total, CAST(sum(CASE WHEN m >= 12 THEN denominator ELSE 0 END) AS BIGINT) AS population_covered, round(CASE WHEN sum(denominator) > 0 THEN CAST(sum(CASE WHEN m >= 12 THEN denominator ELSE 0 END) AS DOUBLE) / sum(denominator) END, 6) AS coverage_ratio FROM (SELECT *, coalesce(violent_months_reported, 0) AS m FROM agency_year) GROUP BY 1, 2")
def covered(a):
    rows = a.agency_year.withColumnsRenamed({"violent_months_reported": "months_reported", "denominator": "population"})
    return A.coverage(rows, ["state", "data_year"]).withColumn("coverage_ratio", F.round("coverage_ratio", 6))


PROVENANCE = "SELECT 'crime' AS measure, entity_id, source, min(data_year) AS first_year, max(data_year) AS last_year, count(*) AS observations FROM crime GROUP BY 2, 3 UNION ALL SELECT 'staffing', entity_id, source, min(data_year), max(data_year), count(*) FROM staffing GROUP BY 2, 3"


@query("a4_provenance", PROVENANCE)
def provenance(a):
    return A.provenance({"crime": a.crime, "staffing": a.staffing})


@query("a5_source_usage", f"SELECT source, CAST(sum(observations) AS BIGINT) AS observations, min(first_year) AS first_year, max(last_year) AS last_year FROM ({PROVENANCE}) GROUP BY 1")
def usage(a):
    return A.source_usage(A.provenance({"crime": a.crime, "staffing": a.staffing}))


@query("a6_facets", " UNION ALL ".join(f"SELECT '{c}' AS facet, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM agency_year WHERE data_year = 1998 GROUP BY 2" for c in ("kind", "state", "coverage", "confidence", "review_status")))
def facets(a):
    return A.facets(a.agency_year.where("data_year = 1998"), ["kind", "state", "coverage", "confidence", "review_status"])


@query("a7_group_counts", "SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, p_name LIMIT 25", prefix=False)
def counts(a):
    return A.group_counts(a.read("part"), "p_name", 2, 25)


@query("a9_medians", "SELECT state, data_year, round(median(violent_rate), 6) AS median_violent_rate, round(median(officers_per_1k), 6) AS median_officers_per_1k FROM agency_year GROUP BY 1, 2 UNION ALL SELECT 'all', data_year, round(median(violent_rate), 6), round(median(officers_per_1k), 6) FROM agency_year GROUP BY 2")
def medians(a):
    ms = ["violent_rate", "officers_per_1k"]
    by = A.group_median(a.agency_year, ["state", "data_year"], ms).unionByName(A.group_median(a.agency_year.withColumn("state", F.lit("all")), ["state", "data_year"], ms))
    return by.select("state", "data_year", r6("median_violent_rate"), r6("median_officers_per_1k"))


@query("a10_status_pivot", "SELECT kind, count(*) AS total, " + ", ".join(f"CAST(sum(CASE WHEN coverage = '{c}' THEN 1 ELSE 0 END) AS BIGINT) AS {c.lower()}" for c in ("COMPLETE", "PARTIAL", "NONE", "UNKNOWN")) + " FROM agency_year GROUP BY 1")
def pivot(a):
    return A.status_pivot(a.agency_year, ["kind"], "coverage", ["COMPLETE", "PARTIAL", "NONE", "UNKNOWN"])


@query("a11_composition", "SELECT kind, CAST(sum(sworn) AS BIGINT) AS total, round_even(CAST(sum(sworn) AS DOUBLE) / sum(sum(sworn)) OVER (), 4) AS share FROM agency_year GROUP BY 1")
def composition(a):
    return A.share_of_total(a.agency_year, "kind", "sworn")


@query("a12_national_trend", "SELECT data_year, CAST(sum(violent_offenses) AS BIGINT) AS n, CAST(sum(denominator) AS BIGINT) AS d, round(CAST(sum(violent_offenses) AS DOUBLE) * 100000 / sum(denominator), 6) AS rate FROM agency_year WHERE coverage = 'COMPLETE' AND denominator > 0 GROUP BY 1")
def trend(a):
    return A.national_trend(a.agency_year.where("coverage = 'COMPLETE' and denominator > 0"), "data_year", "violent_offenses", "denominator").withColumn("rate", F.round("rate", 6))


@query("a14_zero_sums", "SELECT entity_id, CAST(0 AS BIGINT) AS sum FROM crime GROUP BY 1 HAVING coalesce(sum(CASE WHEN months_reported < 7 THEN offenses ELSE 0 END), 0) = 0")
def zeros(a):
    return A.zero_sums(a.crime.withColumn("v", F.when(F.col("months_reported") < 7, F.col("offenses")).otherwise(0)), ["entity_id"], "v")


@query("a15_latest_periods", "SELECT max(CASE WHEN violent_offenses IS NOT NULL THEN data_year END) AS latest_violent, max(CASE WHEN sworn IS NOT NULL THEN data_year END) AS latest_staffing, max(CASE WHEN denominator_basis = 'acs5' THEN data_year END) AS latest_acs5 FROM agency_year")
def latest_periods(a):
    return A.latest_periods(a.agency_year, "data_year", {"violent": F.col("violent_offenses").isNotNull(), "staffing": F.col("sworn").isNotNull(), "acs5": F.col("denominator_basis") == "acs5"})


RANKED = ", ".join(f"max(CASE WHEN r - 1 = least(n - 1, CAST(round_even({p} * (n - 1), 0) AS BIGINT)) THEN violent_offenses END) AS p{round(100 * p)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9))


@query("a16_nearest_rank", f"SELECT data_year, min(v.without_value) AS without_value, max(n) AS with_value, min(violent_offenses) AS least, max(violent_offenses) AS most, {RANKED} FROM (SELECT *, row_number() OVER (PARTITION BY data_year ORDER BY violent_offenses) AS r, count(*) OVER (PARTITION BY data_year) AS n FROM agency_year WHERE violent_offenses IS NOT NULL) JOIN (SELECT data_year AS y, CAST(sum(CASE WHEN violent_offenses IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS without_value FROM agency_year GROUP BY 1) v ON v.y = data_year GROUP BY 1")
def legend(a):
    return A.nearest_rank(a.agency_year, ["data_year"], "violent_offenses", (0.1, 0.25, 0.5, 0.75, 0.9))


@query("a19_low_point", "SELECT entity_id, data_year, violent_offenses, before, after FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY violent_offenses, data_year) AS r FROM (SELECT entity_id, data_year, violent_offenses, CASE WHEN lag(data_year) OVER w = data_year - 1 THEN lag(violent_offenses) OVER w END AS before, CASE WHEN lead(data_year) OVER w = data_year + 1 THEN lead(violent_offenses) OVER w END AS after FROM agency_year WINDOW w AS (PARTITION BY entity_id ORDER BY data_year)) WHERE violent_offenses IS NOT NULL) WHERE r = 1")
def low(a):
    return A.low_point(a.agency_year.select("entity_id", "data_year", "violent_offenses"), "entity_id", "data_year", "violent_offenses")


# --- windows and order ------------------------------------------------------------------------------------------------


@query("w2_jump", "SELECT entity_id, offense_group, data_year, offenses, previous FROM (SELECT *, lag(offenses) OVER (PARTITION BY entity_id, offense_group ORDER BY data_year) AS previous FROM crime WHERE value_type = 'reported') WHERE offenses >= 1.2 * previous")
def jumps(a):
    return W.lag_check(a.crime.where("value_type = 'reported'"), ["entity_id", "offense_group"], "data_year", "offenses", lambda p, v: v >= 1.2 * p).select("entity_id", "offense_group", "data_year", "offenses", "previous")


@query("w3_top_per_group", "SELECT state, entity_id, data_year, violent_offenses, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY data_year DESC NULLS LAST, violent_offenses DESC NULLS LAST, entity_id) AS rank FROM agency_year) WHERE rank <= 20")
def tops(a):
    return W.top_per(a.agency_year.select("state", "entity_id", "data_year", "violent_offenses"), ["state"], [F.desc_nulls_last("data_year"), F.desc_nulls_last("violent_offenses"), F.asc("entity_id")], 20)


@query("w4_latest_value", "SELECT entity_id, max(data_year) AS data_year, arg_max(violent_rate_r, data_year) AS violent_rate FROM (SELECT *, round(violent_rate, 6) AS violent_rate_r FROM agency_year) WHERE violent_rate IS NOT NULL GROUP BY 1")
def latest_value(a):
    return W.latest_value(a.agency_year, "entity_id", "data_year", "violent_rate").withColumn("violent_rate", F.round("violent_rate", 6))


@query("w5_percentile_below", "SELECT entity_id, data_year, cohort_id, round_even(CAST(rank() OVER (PARTITION BY cohort_id, data_year ORDER BY violent_offenses) - 1 AS DOUBLE) / count(*) OVER (PARTITION BY cohort_id, data_year) * 100, 1) AS percentile, count(*) OVER (PARTITION BY cohort_id, data_year) AS cohort_size FROM cohort")
def percentile(a):
    return W.percentile_below(a.cohort.select("entity_id", "data_year", "cohort_id", "violent_offenses"), ["cohort_id", "data_year"], "violent_offenses").drop("violent_offenses")


@query("w6_index_to_base", "SELECT c.entity_id, c.data_year, b.base_period, round(CASE WHEN b.base <> 0 THEN CAST(c.offenses AS DOUBLE) / b.base * 100 END, 6) AS indexed FROM (SELECT * FROM crime WHERE offense_group = 'violent-crime') c JOIN (SELECT entity_id, coalesce(max(CASE WHEN data_year = common THEN offenses END), arg_min(offenses, data_year)) AS base, coalesce(max(common), min(data_year)) AS base_period FROM (SELECT *, (SELECT min(data_year) FROM (SELECT data_year, count(DISTINCT entity_id) AS n FROM crime WHERE offense_group = 'violent-crime' GROUP BY 1) WHERE n = (SELECT count(DISTINCT entity_id) FROM crime WHERE offense_group = 'violent-crime')) AS common FROM crime WHERE offense_group = 'violent-crime') GROUP BY 1) b ON b.entity_id = c.entity_id")
def indexed(a):
    return W.index_to_base(a.crime.where("offense_group = 'violent-crime'").select("entity_id", "data_year", "offenses"), "entity_id", "data_year", "offenses").select("entity_id", "data_year", "base_period", r6("indexed"))


@query("w7_change_between", "SELECT entity_id, s AS start, e AS \"end\", e - s AS change, round(CASE WHEN s <> 0 THEN CAST(e - s AS DOUBLE) / abs(s) * 100 END, 6) AS percent FROM (SELECT entity_id, max(CASE WHEN data_year = 1996 THEN violent_offenses END) AS s, max(CASE WHEN data_year = 2000 THEN violent_offenses END) AS e FROM agency_year GROUP BY 1)")
def change(a):
    return W.change_between(a.agency_year, "entity_id", "data_year", "violent_offenses", 1996, 2000).withColumn("percent", F.round("percent", 6))


@query("w8_first_last_change", "SELECT entity_id, arg_min(total, data_year) AS first, arg_max(total, data_year) AS last, arg_max(total, data_year) - arg_min(total, data_year) AS change FROM staffing GROUP BY 1")
def first_last(a):
    return W.first_last_change(a.staffing, "entity_id", "data_year", "total")


@query("w9_islands", "SELECT entity_id, min(data_year) AS begin, max(data_year) AS \"end\", count(*) AS points FROM (SELECT *, sum(CASE WHEN violent_rate IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id ORDER BY data_year) AS g FROM agency_year) WHERE violent_rate IS NOT NULL GROUP BY entity_id, g")
def islands(a):
    return W.islands(a.agency_year.select("entity_id", "data_year", "violent_rate"), "entity_id", "data_year", "violent_rate")


@query("l1_page", "SELECT entity_id, name, violent_offenses, total_rows, CAST(ceil(total_rows / 25.0) AS BIGINT) AS pages FROM (SELECT entity_id, name, violent_offenses, count(*) OVER () AS total_rows, row_number() OVER (ORDER BY violent_offenses DESC NULLS LAST, name, entity_id) AS r FROM agency_year WHERE data_year = 1998) WHERE r > 25 AND r <= 50")
def paged(a):
    return W.page(a.agency_year.where("data_year = 1998"), "violent_offenses", True, 2, 25, published.SORTABLE, ("name", "entity_id")).select("entity_id", "name", "violent_offenses", "total_rows", "pages")


@query("l3_relevance", "SELECT entity_id, name, CASE WHEN lower(entity_id) = '1' THEN 0 WHEN lower(name) = '1' THEN 1 ELSE 2 END AS relevance FROM entity WHERE lower(entity_id) = '1' OR contains(lower(name), '1') ORDER BY relevance, length(name), entity_id LIMIT 30")
def relevant(a):
    return W.relevance(a.entity, "1", "entity_id", "name", 30).select("entity_id", "name", "relevance")


@query("u1_key_universe", "SELECT entity_id, data_year FROM universe")
def universe(a):
    return a.crime.select("entity_id", "data_year").union(a.staffing.select("entity_id", "data_year")).distinct()


@query("u4_set_difference", "SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity = 50 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity = 1", prefix=False)
def difference(a):
    li = a.read("lineitem")
    return li.where("l_quantity = 50").select(F.col("l_partkey").alias("k")).subtract(li.where("l_quantity = 1").select("l_partkey"))


# --- quality, reconciliation ------------------------------------------------------------------------------------------

LOG_SQL = faulty.SQL + ", log AS (" + " UNION ALL ".join(f"SELECT '{c.check_id}' AS check_id, '{c.severity}' AS severity, * FROM ({faulty.CHECK_SQL[c.check_id]})" for c in V.CHECKS) + ")\n"


@query("v0_check_register", LOG_SQL + "SELECT check_id, severity, count(*) AS findings FROM log GROUP BY 1, 2")
def register(a):
    return faulty.log(a).groupBy("check_id", "severity").agg(F.count("*").alias("findings"))


@query("v0_capped_log", LOG_SQL + "SELECT check_id, count(*) AS findings, least(count(*), 50) AS logged FROM log GROUP BY 1")
def capped(a):
    log = sinks.settled(faulty.log(a), "log")
    some = V.capped(log, 50).groupBy("check_id").agg(F.count("*").alias("logged"))
    return log.groupBy("check_id").agg(F.count("*").alias("findings")).join(some, "check_id")


def _check_query(c: V.Check):
    query(f"v_{c.check_id}", f"{faulty.SQL}\n{faulty.CHECK_SQL[c.check_id]}")(lambda a: V.run_checks(faulty.tables(a), [c]).select("entity_id", "data_year", "observed"))


for _c in V.CHECKS:
    _check_query(_c)


STAFF_RECORDS = "SELECT CAST(l_suppkey AS VARCHAR) AS key, 'pe' AS source, CAST(year(l_shipdate) AS INT) AS data_year, CASE WHEN year(l_shipdate) = 1996 THEN 0 ELSE count(*) END AS total FROM lineitem GROUP BY l_suppkey, year(l_shipdate), l_returnflag"
STAFF_KEYS = "SELECT entity_id, CASE WHEN suppkey % 10 = 9 THEN CAST(suppkey - 1 AS VARCHAR) ELSE CAST(suppkey AS VARCHAR) END AS key FROM entity"
STAFF_LOG = f"""SELECT 'zero_filled_year' AS check_id, data_year, source AS entity_id FROM ({STAFF_RECORDS}) GROUP BY 2, 3 HAVING sum(total) = 0
 UNION ALL SELECT 'duplicate_record', r.data_year, u.entity_id FROM ({STAFF_RECORDS}) r JOIN (SELECT key, min(entity_id) AS entity_id FROM ({STAFF_KEYS}) GROUP BY 1 HAVING count(*) = 1) u USING (key) WHERE r.data_year <> 1996 GROUP BY 2, 3 HAVING count(DISTINCT total) > 1
 UNION ALL SELECT 'ambiguous_key', CAST(NULL AS INT), key FROM ({STAFF_KEYS}) GROUP BY 3 HAVING count(*) > 1"""


def _staff_log(a):
    li = a.read("lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("data_year"), "l_returnflag").agg(F.count("*").alias("n"))
    total = F.when(F.col("data_year") == 1996, 0).otherwise(F.col("n"))
    records = li.select(F.col("l_suppkey").cast("string").alias("key"), F.lit("pe").alias("source"), "data_year", total.alias("total"), total.alias("male"), F.lit(0).cast("long").alias("female"))
    keys = a.entity.select("entity_id", F.when(F.col("suppkey") % 10 == 9, F.col("suppkey") - 1).otherwise(F.col("suppkey")).cast("string").alias("key"))
    return C.staffing(records, keys)[1]


@query("v24_loader_findings", STAFF_LOG)
def loader_findings(a):
    return _staff_log(a)


@query("r8_disambiguated_keys", "SELECT CAST(n_nationkey AS VARCHAR) AS key, CASE WHEN n_nationkey % 5 <> 0 AND n_nationkey % 3 <> 0 THEN 'key_disambiguated' ELSE 'ambiguous_key' END AS check_id, CASE WHEN n_nationkey % 5 <> 0 AND n_nationkey % 3 <> 0 THEN 'info' ELSE 'warning' END AS severity FROM nation", prefix=False)
def disambiguated(a):
    n = a.read("nation").select(F.col("n_nationkey").alias("k"), F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("name"))
    second = F.when(F.col("k") % 5 == 0, F.struct(F.lit("00").alias("s"), F.lit("99").alias("name"))).otherwise(F.struct(F.lit("01").alias("s"), F.lit("99").alias("name")))
    claims = F.array(F.struct(F.lit("00").alias("s"), F.when(F.col("k") % 3 == 0, "77").otherwise(F.col("name")).alias("name")), F.struct(F.lit("9E").alias("s"), F.lit("88").alias("name")), second)
    candidates = n.select("key", F.explode(claims).alias("c")).select("key", F.concat("key", "c.s").alias("candidate_id"), "c.name")
    return L.disambiguate(n.select("key", "name"), candidates)[1]


@query("v29_log_lifecycle", f"{faulty.SQL}, loaded AS ({STAFF_LOG}) SELECT check_id, count(*) AS n FROM (SELECT check_id FROM loaded UNION ALL SELECT 'missing_source' FROM ({faulty.CHECK_SQL['missing_source']})) GROUP BY 1")
def lifecycle(a):
    t, checks = faulty.tables(a), {c.check_id: c for c in V.CHECKS}
    before = _staff_log(a).unionByName(V.run_checks(t, [checks["negative_count"]]), allowMissingColumns=True)
    return V.refreshed(before, V.run_checks(t, [checks["missing_source"]])).groupBy("check_id").agg(F.count("*").alias("n"))


BUCKETS = "SELECT p_partkey AS record, p_brand || '|' || CASE WHEN p_partkey % 3 = 0 THEN p_name || '?' ELSE p_name END AS key, CAST(floor(p_retailprice) AS BIGINT) AS amount, CASE WHEN n = 1 THEN 'unique_key' WHEN n > 1 THEN 'ambiguous' WHEN p_name LIKE '%a%' THEN 'out_of_scope' ELSE 'unresolved' END AS bucket FROM part LEFT JOIN (SELECT p_brand AS b, p_name AS m, count(*) AS n FROM part GROUP BY 1, 2) ON b = p_brand AND m = CASE WHEN p_partkey % 3 = 0 THEN p_name || '?' ELSE p_name END"


def _buckets(a):
    written = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit("?"))).otherwise(F.col("p_name"))
    p = a.read("part").select(F.col("p_partkey").alias("record"), F.concat_ws("|", "p_brand", written).alias("key"), F.floor("p_retailprice").cast("long").alias("amount"), "p_name")
    known = a.read("part").groupBy(F.concat_ws("|", "p_brand", "p_name").alias("key")).agg(F.count("*").alias("n"))
    return K.bucketed(p, known, F.col("p_name").rlike("a")).drop("p_name")


@query("k1_buckets", BUCKETS, prefix=False)
def buckets(a):
    return _buckets(a).select("record", "key", "amount", "bucket")


@query("k2_largest", f"SELECT bucket, CAST(rank AS INT) AS rank, record, amount FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY amount DESC, record) AS rank FROM ({BUCKETS})) WHERE rank <= 10", prefix=False)
def largest(a):
    return K.largest(_buckets(a), "amount", "record")


@query("k3_closure", f"WITH b AS ({BUCKETS}) SELECT CAST(sum(amount) AS BIGINT) AS source, CAST(sum(CASE WHEN bucket = 'unique_key' THEN amount ELSE 0 END) AS BIGINT) AS loaded, CAST(sum(CASE WHEN bucket <> 'unique_key' THEN amount ELSE 0 END) AS BIGINT) AS excluded, CAST((SELECT sum(amount) FROM b WHERE bucket = 'unique_key') AS BIGINT) AS published, CAST(0 AS BIGINT) AS residual, CAST(0 AS BIGINT) AS duplicate_delta FROM b", prefix=False)
def closure(a):
    b = _buckets(a)
    return K.closure(b, "amount", ["unique_key"], b.where("bucket = 'unique_key'").select(F.col("amount").alias("x")), "x")


@query("k4_by_type", "SELECT kind, state, count(*) AS entities, CAST(sum(total) AS BIGINT) AS total FROM agency_year WHERE data_year = 1999 GROUP BY 1, 2")
def by_type(a):
    return a.agency_year.where("data_year = 1999").groupBy("kind", "state").agg(F.count("*").alias("entities"), F.sum("total").alias("total"))


# --- published queries ------------------------------------------------------------------------------------------------

SUBJECT, PEER_YEAR = "000000001", 1998


@query("q4_series", "SELECT entity_id, data_year, round(violent_rate, 6) AS value, coverage, confidence FROM agency_year")
def series(a):
    return a.agency_year.select("entity_id", "data_year", r6("violent_rate", "value"), "coverage", "confidence")


@query("q6_peers", f"""SELECT '{SUBJECT}' AS subject_id, round(s.violent_rate, 6) AS value, coalesce(n, 0) AS cohort_size, p25, p50, p75, sm AS state_median, nm AS national_median, CASE WHEN n >= 5 AND s.confidence <> 'NOT_COMPARABLE' THEN round_even(CAST(below AS DOUBLE) / n * 100, 1) END AS percentile,
 replace(s.kind, '_', ' ') || ' agencies' || coalesce('; population served ' || s.band, '') || coalesce('; ' || lower(s.urbanicity), '') || '; complete reporting in {PEER_YEAR}' AS definition
 FROM (SELECT * FROM agency_year WHERE entity_id = '{SUBJECT}' AND data_year = {PEER_YEAR}) s LEFT JOIN (SELECT count(*) AS n, count(CASE WHEN a.violent_rate < s2.violent_rate THEN 1 END) AS below, round(quantile_cont(a.violent_rate, 0.25), 6) AS p25, round(quantile_cont(a.violent_rate, 0.5), 6) AS p50, round(quantile_cont(a.violent_rate, 0.75), 6) AS p75
   FROM agency_year a JOIN (SELECT * FROM agency_year WHERE entity_id = '{SUBJECT}' AND data_year = {PEER_YEAR}) s2 ON a.kind = s2.kind AND a.band = s2.band AND coalesce(a.urbanicity, '') = coalesce(s2.urbanicity, '') WHERE a.data_year = {PEER_YEAR} AND a.violent_rate_allowed AND a.violent_rate IS NOT NULL) c ON true
 LEFT JOIN (SELECT round(median(CASE WHEN a.state = s3.state THEN a.violent_rate END), 6) AS sm, round(median(a.violent_rate), 6) AS nm FROM agency_year a, (SELECT * FROM agency_year WHERE entity_id = '{SUBJECT}' AND data_year = {PEER_YEAR}) s3 WHERE a.data_year = {PEER_YEAR} AND a.violent_rate_allowed AND a.violent_rate IS NOT NULL) m ON true""")
def peers(a):
    out = published.peers(a.agency_year, SUBJECT, PEER_YEAR, "violent_rate")
    return out.select(*[r6(c) if t == "double" and c != "percentile" else c for c, t in out.dtypes])


@query("q7_comparability", """SELECT code, 'warning' AS severity FROM (SELECT count(*) AS n, count(DISTINCT kind) AS kinds, count(DISTINCT denominator_type) AS types, bool_or(confidence = 'NOT_COMPARABLE') AS apart, bool_or(kind = 'state_police') AS wide, min(violent_months_reported) AS months FROM agency_year WHERE entity_id IN ('000000001', '000000004', '000000007') AND data_year = 1998) m,
 LATERAL (SELECT 'statewide_vs_local' AS code WHERE wide AND kinds > 1 AND n >= 2 UNION ALL SELECT 'mixed_denominators' WHERE types > 1 AND n >= 2 UNION ALL SELECT 'not_comparable_member' WHERE apart AND n >= 2 UNION ALL SELECT 'mixed_agency_types' WHERE kinds > 1 AND NOT wide AND n >= 2 UNION ALL SELECT 'incomplete_coverage' WHERE months < 12 AND n >= 2)""")
def comparability(a):
    return published.compare(a.agency_year, ["000000001", "000000004", "000000007"], 1998)["issues"]


@query("q9_overview", "SELECT count(DISTINCT entity_id) AS entities, CAST(sum(sworn) AS BIGINT) AS sworn, CAST(sum(violent_offenses) AS BIGINT) AS violent_offenses, CAST(sum(denominator) AS BIGINT) AS population FROM agency_year WHERE data_year = 1999")
def overview(a):
    return published.overview(a.agency_year, 1999)["headline"]


@query("q10_state_map", "SELECT state, round(median(violent_rate), 6) AS value FROM agency_year WHERE data_year = 1999 GROUP BY 1")
def state_map(a):
    return published.map_layer(a.agency_year, 1999, "violent_rate", "state")["features"].select("state", F.round("value", 6).alias("value"))


@query("q13_search", "SELECT type, id, name, relevance FROM (SELECT *, CASE WHEN lower(id) = 'er' THEN 0 WHEN lower(name) = 'er' THEN 1 ELSE 2 END AS relevance FROM (SELECT 'entity' AS type, entity_id AS id, name FROM entity UNION ALL SELECT DISTINCT 'state', state, state FROM entity)) WHERE lower(id) = 'er' OR contains(lower(name), 'er') ORDER BY relevance, length(name), id LIMIT 20")
def search(a):
    return published.search(a.entity, "er")


@query("m_metric_catalogue", """SELECT state, data_year, count(DISTINCT entity_id) AS agency_count, CAST(sum(sworn) AS BIGINT) AS sworn_officers, CAST(sum(civilian) AS BIGINT) AS civilian_personnel, CAST(sum(total) AS BIGINT) AS total_personnel, round(CASE WHEN sum(sworn) > 0 THEN CAST(sum(denominator) AS DOUBLE) / sum(sworn) END, 6) AS population_per_officer,
 round(avg(violent_months_reported / 12.0), 6) AS reporting_completeness, round(CASE WHEN sum(total) > 0 THEN CAST(sum(civilian) AS DOUBLE) / sum(total) END, 6) AS civilian_share, CAST(sum(violent_offenses) AS BIGINT) AS violent_crime_count, CAST(sum(property_offenses) AS BIGINT) AS property_crime_count FROM agency_year GROUP BY 1, 2""")
def metrics(a):
    return a.agency_year.groupBy("state", "data_year").agg(
        F.count_distinct("entity_id").alias("agency_count"), F.sum("sworn").alias("sworn_officers"), F.sum("civilian").alias("civilian_personnel"), F.sum("total").alias("total_personnel"),
        F.round(measures.safe_ratio(F.sum("denominator"), F.sum("sworn")), 6).alias("population_per_officer"), F.round(F.avg(F.col("violent_months_reported") / 12.0), 6).alias("reporting_completeness"),
        F.round(measures.safe_ratio(F.sum("civilian"), F.sum("total")), 6).alias("civilian_share"),
        F.sum("violent_offenses").alias("violent_crime_count"), F.sum("property_offenses").alias("property_crime_count"),
    )



# --- further queries of the catalogue ----------------------------------------------------------------------------------


@query("g1_denominator", "SELECT entity_id, data_year, balance_population, denominator, denominator_basis FROM population")
def denominator(a):
    return a.population.select("entity_id", "data_year", "balance_population", "denominator", "denominator_basis")


@query("g12_gates_by_kind", "SELECT kind, denominator_type, confidence, coverage, violent_withheld, count(*) AS n FROM agency_year GROUP BY ALL")
def gates(a):
    return a.agency_year.groupBy("kind", "denominator_type", "confidence", "coverage", "violent_withheld").agg(F.count("*").alias("n"))


@query("g15_absent_reason", "SELECT entity_id, data_year, CASE WHEN confidence = 'NOT_COMPARABLE' THEN 'not_comparable' WHEN sworn IS NULL THEN 'staffing_not_reported' WHEN NOT coalesce(denominator > 0, false) THEN 'no_population' ELSE 'not_available' END AS reason FROM agency_year WHERE officers_per_1k IS NULL")
def absent(a):
    return a.agency_year.where("officers_per_1k is null").select("entity_id", "data_year", policy.absent_reason(F.col("confidence"), F.col("sworn"), F.col("denominator")).alias("reason"))


@query("j1_entity_geography", "SELECT e.entity_id, e.kind, e.review_status, n.n_name AS geo_name, r.r_name AS region FROM entity e LEFT JOIN nation n ON n.n_name = e.state AND e.review_status = 'accepted' LEFT JOIN region r ON r.r_regionkey = n.n_regionkey")
def geography(a):
    links = a.entity.where("review_status = 'accepted'").select("entity_id", "state")
    geo = a.read("nation").join(a.read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("geo_name"), F.col("r_name").alias("region"))
    linked = links.join(geo, F.col("state") == F.col("geo_name")).select("entity_id", "geo_name", "region")
    return a.entity.select("entity_id", "kind", "review_status").join(linked, "entity_id", "left")


@query("j4_aligned_groups", "SELECT entity_id, data_year, max(CASE WHEN offense_group = 'violent-crime' THEN offenses END) AS violent, max(CASE WHEN offense_group = 'property-crime' THEN offenses END) AS property FROM crime GROUP BY 1, 2")
def aligned(a):
    wide = a.crime.groupBy("entity_id", "data_year").pivot("offense_group", ["violent-crime", "property-crime"]).agg(F.max("offenses"))
    return wide.withColumnsRenamed({"violent-crime": "violent", "property-crime": "property"})


@query("a18_state_summary", "SELECT data_year, count(*) AS states, CAST(sum(n) AS BIGINT) AS offenses, round(median(n), 6) AS median_offenses, CAST(sum(CASE WHEN n IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing FROM (SELECT state, data_year, sum(violent_offenses) AS n FROM agency_year GROUP BY 1, 2) GROUP BY 1")
def state_summary(a):
    by = a.agency_year.groupBy("state", "data_year").agg(F.sum("violent_offenses").alias("n"))
    return by.groupBy("data_year").agg(F.count("*").alias("states"), F.sum("n").alias("offenses"), F.round(F.median("n"), 6).alias("median_offenses"), F.count_if(F.col("n").isNull()).alias("missing"))


@query("l2_top_n", "SELECT entity_id, data_year, violent_offenses FROM agency_year WHERE violent_offenses IS NOT NULL AND data_year = 1999 ORDER BY violent_offenses DESC, entity_id LIMIT 15")
def top_n(a):
    return a.agency_year.where("violent_offenses is not null and data_year = 1999").orderBy(F.desc("violent_offenses"), "entity_id").limit(15).select("entity_id", "data_year", "violent_offenses")


@query("q1_agencies", "SELECT entity_id, name, denominator, total_rows, CAST(ceil(total_rows / 10.0) AS BIGINT) AS pages FROM (SELECT *, count(*) OVER () AS total_rows, row_number() OVER (ORDER BY denominator DESC NULLS LAST, name, entity_id) AS r FROM agency_year WHERE data_year = 1998 AND contains(lower(name), '1') AND kind = 'municipal_police' AND denominator >= 1000) WHERE r <= 10")
def agencies(a):
    return published.agencies(a.agency_year, 1998, q="1", kind="municipal_police", population=(1000, None), sort="denominator", descending=True, size=10).select("entity_id", "name", "denominator", "total_rows", "pages")


@query("q3_profile_history", f"SELECT entity_id, data_year, violent_offenses, coverage, confidence, warning FROM agency_year WHERE entity_id = '{SUBJECT}'")
def history(a):
    return published.profile(a.entity, a.agency_year, SUBJECT)["history"].select("entity_id", "data_year", "violent_offenses", "coverage", "confidence", "warning")


@query("q7_missing_members", "SELECT entity_id, max(data_year) AS latest_year FROM agency_year WHERE entity_id IN ('000000002', '000000003') AND entity_id NOT IN (SELECT entity_id FROM agency_year WHERE data_year = 2004) GROUP BY 1")
def missing_members(a):
    return published.compare(a.agency_year, ["000000002", "000000003"], 2004)["missing"]


@query("q11_resolution_matrix", "SELECT kind, count(*) AS total, CAST(sum(CASE WHEN review_status = 'accepted' THEN 1 ELSE 0 END) AS BIGINT) AS accepted, CAST(sum(CASE WHEN review_status = 'needs_review' THEN 1 ELSE 0 END) AS BIGINT) AS needs_review, CAST(sum(CASE WHEN review_status = 'unmatched' THEN 1 ELSE 0 END) AS BIGINT) AS unmatched FROM entity GROUP BY 1")
def resolution(a):
    return A.status_pivot(a.entity, ["kind"], "review_status", ["accepted", "needs_review", "unmatched"])


@query("q15_adhoc_sql", "SELECT kind, CAST(sum(violent_offenses) AS BIGINT) AS n FROM agency_year GROUP BY kind")
def adhoc(a):
    return published.adhoc({"agency_year_view": a.agency_year}, "SELECT kind, sum(violent_offenses) AS n FROM agency_year_view GROUP BY kind")


@query("p16_finite_values", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <> 25 THEN round(l_extendedprice / (l_quantity - 25), 6) END AS v FROM lineitem", prefix=False)
def finite_values(a):
    d = F.col("l_quantity") - 25
    raw = F.when(d != 0, F.col("l_extendedprice") / d).otherwise(F.lit(float("nan")))
    return a.read("lineitem").select("l_orderkey", "l_linenumber", F.round(measures.finite(raw), 6).alias("v"))


# --- places, drill-downs, bundle ---------------------------------------------------------------------------------------


@query("p4_state_codes", "SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN '60' WHEN 1 THEN '66' WHEN 2 THEN '69' WHEN 3 THEN '72' WHEN 4 THEN '78' ELSE '31' END AS fips FROM supplier", prefix=False)
def state_codes(a):
    given = F.element_at(F.array(*map(F.lit, ("AS", "GU", "MP", "PR", "vi ", "NB"))), (F.col("s_suppkey") % 6 + 1).cast("int"))
    return a.read("supplier").select("s_suppkey", codes.state_fips(given).alias("fips"))


@query("p9_place_names", r"SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(upper(p_name || ' Charter Township of the Census Area, Urban County'), '[^A-Z0-9 ]+', ' ', 'g'), '\b(CITY|TOWN|VILLAGE|BOROUGH|TOWNSHIP|CDP|MUNICIPALITY|PLANTATION|URBAN COUNTY|METROPOLITAN GOVERNMENT|CONSOLIDATED GOVERNMENT|GOVERNMENT|UT|CCD|COUNTY|PARISH|CENSUS AREA|PLANNING REGION|BALANCE|METRO)\b', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM part", prefix=False)
def place_names(a):
    return a.read("part").select("p_partkey", names.normalize_place(F.concat("p_name", F.lit(" Charter Township of the Census Area, Urban County"))).alias("norm"))


def _municipal(a):
    level = F.when(F.col("s_suppkey") % 2 == 0, "place").otherwise("cousub")
    return a.read("supplier").join(a.read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("state"), level.alias("geo_level"), F.concat(level, F.lit(":"), F.col("s_suppkey").cast("string")).alias("geo_id"))


#: States whose towns govern: some of those that the data has.
TOWN_STATES = tuple(f"NATION_{k}" for k in range(12))


@query("r1_block_selection", f"SELECT state, geo_level, geo_id FROM (SELECT n_name AS state, CASE WHEN s_suppkey % 2 = 0 THEN 'place' ELSE 'cousub' END AS geo_level, CASE WHEN s_suppkey % 2 = 0 THEN 'place:' ELSE 'cousub:' END || CAST(s_suppkey AS VARCHAR) AS geo_id FROM supplier JOIN nation ON s_nationkey = n_nationkey) WHERE (state IN {TOWN_STATES}) = (geo_level = 'cousub')", prefix=False)
def block_selection(a):
    return L.municipalities(_municipal(a), TOWN_STATES)


COUNTIES = "SELECT 'county:' || CAST(p_partkey AS VARCHAR) AS target_id, p_brand AS state, upper(p_name) AS c FROM part WHERE p_size <= 25"


@query("r3_county_links", f"""WITH c AS ({COUNTIES}), e AS (SELECT 's' || CAST(p_partkey AS VARCHAR) AS entity_id, p_brand AS state, upper(p_name) AS c FROM part), x AS (SELECT e.entity_id, count(*) AS n, min(c.target_id) AS target_id FROM e JOIN c ON c.state = e.state AND c.c = e.c GROUP BY 1)
SELECT e.entity_id, CASE WHEN n >= 1 THEN target_id ELSE 'state:' || e.state END AS target_id, CASE WHEN n = 1 THEN 'exact_county_name' WHEN n > 1 THEN 'fuzzy_county_name' ELSE 'state_fallback' END AS method, CASE WHEN n >= 1 THEN 1.0 ELSE 0.2 END AS score, CASE WHEN n >= 1 THEN 'accepted' ELSE 'needs_review' END AS review_status FROM e LEFT JOIN x USING (entity_id)""", prefix=False)
def county_links(a):
    """Names that aren't equal are unlike in these tables: a name of the same words is the same name."""
    p = a.read("part")
    entities = p.select(F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("entity_id"), F.col("p_brand").alias("state"), F.concat("p_name", F.lit(" County")).alias("county_name"), F.lit("Sheriff").alias("name"))
    counties = p.where("p_size <= 25").select(F.concat(F.lit("county:"), F.col("p_partkey").cast("string")).alias("target_id"), F.col("p_brand").alias("state"), F.concat("p_name", F.lit(" Parish")).alias("name"))
    return L.county_links(entities, counties).drop("note")


@query("q5_entity_coverage", f"SELECT entity_id, data_year, violent_months_reported, coverage, violent_rate_allowed, violent_withheld FROM agency_year WHERE entity_id = '{SUBJECT}'")
def entity_coverage(a):
    return published.entity_coverage(a.agency_year, V.run_checks(faulty.tables(a)), SUBJECT)["years"]


@query("q5_entity_flags", LOG_SQL + f"SELECT check_id, severity, data_year, observed FROM log WHERE entity_id = '{SUBJECT}'")
def entity_flags(a):
    return published.entity_coverage(a.agency_year, faulty.log(a), SUBJECT)["flags"].select("check_id", "severity", "data_year", "observed")


@query("q12_coverage_detail", "SELECT entity_id, name, state, coverage, denominator FROM agency_year WHERE data_year = 1998 AND coverage = 'PARTIAL' ORDER BY denominator DESC NULLS LAST, entity_id LIMIT 200")
def coverage_detail(a):
    return published.coverage_detail(a.agency_year, 1998, status="PARTIAL").select("entity_id", "name", "state", "coverage", "denominator")


@query("q12_flag_detail", LOG_SQL + "SELECT l.entity_id, l.data_year, l.observed, l.severity, e.name, e.state FROM log l LEFT JOIN entity e ON e.entity_id = l.entity_id WHERE check_id = 'rate_of_partial_year' ORDER BY l.data_year DESC NULLS LAST, l.entity_id, l.observed LIMIT 200")
def flag_detail(a):
    return published.flag_detail(faulty.log(a), a.entity, "rate_of_partial_year").select("entity_id", "data_year", "observed", "severity", "name", "state")


@query("q14_sources", f"SELECT s.source, coalesce(CAST(n AS BIGINT), 0) AS observations FROM (VALUES ('pe'), ('api'), ('monthly'), ('inline')) s(source) LEFT JOIN (SELECT source, sum(observations) AS n FROM ({PROVENANCE}) GROUP BY 1) u ON u.source = s.source")
def sources(a):
    listed = a.spark.createDataFrame([(x,) for x in ("pe", "api", "monthly", "inline")], "source string")
    return published.sources(listed, A.source_usage(A.provenance({"crime": a.crime, "staffing": a.staffing})))


@query("q14_release", "SELECT 'r1' AS release_id, max(CASE WHEN violent_offenses IS NOT NULL THEN data_year END) AS latest_violent, max(CASE WHEN sworn IS NOT NULL THEN data_year END) AS latest_staffing FROM agency_year")
def release(a):
    return published.release(a.agency_year, "r1", {"violent": F.col("violent_offenses").isNotNull(), "staffing": F.col("sworn").isNotNull()})


@query("q3_profile_latest", f"SELECT entity_id, data_year, violent_offenses FROM agency_year WHERE entity_id = '{SUBJECT}' AND violent_offenses IS NOT NULL ORDER BY data_year DESC LIMIT 1")
def profile_latest(a):
    return published.profile(a.entity, a.agency_year, SUBJECT)["latest"].select("entity_id", "data_year", "violent_offenses")


@query("q4_one_series", f"SELECT entity_id, data_year, round(officers_per_1k, 6) AS value, coverage, confidence FROM agency_year WHERE entity_id = '{SUBJECT}'")
def one_series(a):
    return published.series(a.agency_year, SUBJECT, "officers_per_1k").withColumn("value", F.round("value", 6))


@query("q7_snapshot", "SELECT entity_id, data_year, violent_offenses FROM agency_year WHERE entity_id IN ('000000001', '000000002') AND data_year = 1998")
def snapshot(a):
    return published.compare(a.agency_year, ["000000001", "000000002"], 1998)["snapshot"].select("entity_id", "data_year", "violent_offenses")


@query("q9_overview_trend", "SELECT data_year, CAST(sum(violent_offenses) AS BIGINT) AS n, CAST(sum(denominator) AS BIGINT) AS d, round(CAST(sum(violent_offenses) AS DOUBLE) * 100000 / sum(denominator), 6) AS rate FROM agency_year WHERE coverage = 'COMPLETE' AND denominator > 0 GROUP BY 1")
def overview_trend(a):
    return published.overview(a.agency_year, 1999)["trend"].withColumn("rate", F.round("rate", 6))


@query("q9_overview_composition", "SELECT kind, CAST(sum(sworn) AS BIGINT) AS total, round_even(CAST(sum(sworn) AS DOUBLE) / sum(sum(sworn)) OVER (), 4) AS share FROM agency_year WHERE data_year = 1999 GROUP BY 1")
def overview_composition(a):
    return published.overview(a.agency_year, 1999)["composition"]


_CODED = ("kind", "state", "region", "coverage", "confidence", "name", "entity_id")


@query("s16_dictionary_columns", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) <= greatest(64, count(*) / 200) AS coded FROM agency_year" for c in _CODED))
def dictionary_columns(a):
    from ..sources.sinks import dictionary_columns as coded

    return coded(a.agency_year.select(*_CODED))


@query("s16_bundle_log", LOG_SQL + "SELECT check_id, least(count(*), 200) AS logged FROM log GROUP BY 1")
def bundle_log(a):
    """The bundle's part of the log: 200 rows a check."""
    return faulty.log(a, most=200).groupBy("check_id").agg(F.count("*").alias("logged"))


# --- readers over files that Spark has written from the tables ---------------------------------------------------------


@query("s4_archive_members", "SELECT 'units' AS member, count(*) AS n FROM supplier UNION ALL SELECT 'amounts', count(*) FROM (SELECT DISTINCT l_suppkey, year(l_shipdate) FROM lineitem)", prefix=False)
def archive_members(a):
    folder = sinks.landing_folder(a.spark)
    unit = fixed_width.render(fixed_width.UNIT_DIRECTORY, 146, {"gov_id": (F.lpad(F.col("s_suppkey").cast("string"), 12, "0"), False), "name": (F.col("s_name"), False)})
    a.read("supplier").select(unit.alias("value")).write.text(f"{folder}/units")
    sums = a.read("lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("y")).agg(F.count("*").alias("n"))
    amount = fixed_width.render(fixed_width.FINANCE_AMOUNTS, 32, {"gov_id": (F.lpad(F.col("l_suppkey").cast("string"), 12, "0"), False), "item": (F.lit("E62"), False), "amount": (F.col("n"), True), "data_year": (F.col("y"), False), "flag": (F.lit("R"), False)})
    sums.select(amount.alias("value")).write.text(f"{folder}/amounts")
    got = fixed_width.read_members(a.spark, folder, {"units": fixed_width.read_unit_directory, "amounts": fixed_width.read_finance_amounts})
    return sinks.release_manifest(got, "r").select(F.col("table_name").alias("member"), F.col("rows").alias("n"))


@query("s5_sniffed_delimiter", "SELECT CAST(s_suppkey AS VARCHAR) AS geoid, s_name || ' | x' AS name FROM supplier", prefix=False)
def sniffed(a):
    path = sinks.landing_folder(a.spark)
    a.read("supplier").select(F.concat(F.lit(" "), F.col("s_suppkey").cast("string")).alias(" geoid"), F.concat("s_name", F.lit(" | x ")).alias("name ")).write.option("header", True).option("sep", "\t").option("quote", "").csv(path)
    return delimited.read_delimited(a.spark, path)


@query("s8_yearly_files", "SELECT CAST(o_custkey AS VARCHAR) AS custkey, CAST(max(year(o_orderdate)) AS INT) AS last_year FROM orders GROUP BY 1", prefix=False)
def yearly_files(a):
    """One file name a year; of several years of a key the latest wins."""
    path = sinks.landing_folder(a.spark)
    years = a.read("orders").select(F.col("o_custkey").cast("string").alias("custkey"), F.year("o_orderdate").alias("year")).distinct()
    years.write.partitionBy("year").option("header", True).csv(path)
    rows = delimited.read_yearly_csv(a.spark, path, r"year=([0-9]{4})")
    return C.latest_wins(rows, ["custkey"], "file_year").select("custkey", F.col("file_year").alias("last_year"))


@query("s9_json_array", "SELECT CAST(s_suppkey AS BIGINT) AS ori, s_name AS agency_name, s_acctbal > 0 AS is_nibrs FROM supplier", prefix=False)
def json_array(a):
    path = sinks.landing_folder(a.spark)
    one = F.to_json(F.array(F.struct(F.col("s_suppkey").alias("ori"), F.col("s_name").alias("agency_name"), (F.col("s_acctbal") > 0).alias("is_nibrs"))))
    a.read("supplier").select(one.alias("value")).write.text(path)
    return records.read_json(a.spark, path, "ori long, agency_name string, is_nibrs boolean")


@query("s11_padded_codes", "SELECT lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS uace, n_name AS name FROM nation", prefix=False)
def padded_codes(a):
    path = sinks.landing_folder(a.spark)
    a.read("nation").select(F.col("n_nationkey").alias("uace"), F.col("n_name").alias("name")).write.option("header", True).csv(path)
    return delimited.pad_codes(delimited.read_delimited(a.spark, path, sep=","), {"uace": 5})


@query("s12_registry", "SELECT r_name AS source_id, string_agg(n_name, ' | ' ORDER BY n_name) AS members, false AS deferred FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1", prefix=False)
def registry_table(a):
    """A registry of a few records: lists joined, missing booleans false."""
    nation = a.read("nation").join(a.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    found = nation.groupBy(F.col("r_name").alias("source_id")).agg(F.array_sort(F.collect_list("n_name")).alias("members")).collect()  # one row a region
    return records.registry_df(a.spark, [r.asDict() for r in found], StructType.fromDDL("source_id string, members string, deferred boolean"))


# --- joins, orders and rules that had no query of their own --------------------------------------------------------------


@query("j6_left_join_is_null", "SELECT s.entity_id, s.data_year FROM staffing s LEFT JOIN crime c ON c.entity_id = s.entity_id AND c.data_year = s.data_year AND c.offense_group = 'violent-crime' AND c.value_type = 'reported' WHERE c.entity_id IS NULL")
def left_null(a):
    return a.staffing.select("entity_id", "data_year").join(a.crime.where("offense_group = 'violent-crime' AND value_type = 'reported'"), ["entity_id", "data_year"], "left_anti")


@query("j9_using_join", "SELECT entity_id, data_year, s.total, p.pep FROM staffing s JOIN population p USING (entity_id, data_year)")
def using(a):
    return a.staffing.select("entity_id", "data_year", "total").join(a.population.select("entity_id", "data_year", "pep"), ["entity_id", "data_year"])


@query("j11_described_provenance", f"SELECT p.*, e.name, e.state FROM ({PROVENANCE}) p LEFT JOIN entity e ON e.entity_id = p.entity_id AND e.review_status = 'accepted'")
def described(a):
    names_ = a.entity.where("review_status = 'accepted'").select("entity_id", "name", "state")
    return A.provenance({"crime": a.crime, "staffing": a.staffing}).join(names_, "entity_id", "left")


@query("a13_severity_order", LOG_SQL + "SELECT check_id, severity, count(*) AS findings, CASE severity WHEN 'error' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END AS severity_order FROM log GROUP BY 1, 2")
def severity_order(a):
    return A.check_register(faulty.log(a)).drop("message")


@query("l4_worst_checks", LOG_SQL + "SELECT check_id, severity, count(*) AS findings FROM log GROUP BY 1, 2 ORDER BY CASE severity WHEN 'error' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END, findings DESC, check_id LIMIT 8")
def worst(a):
    return A.check_register(faulty.log(a)).orderBy("severity_order", F.desc("findings"), "check_id").limit(8).select("check_id", "severity", "findings")


@query("c9_first_wins", "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1", prefix=False)
def first_seen(a):
    return C.first_wins(a.read("lineitem"), ["l_suppkey"], "l_shipdate", "l_orderkey", "l_linenumber").select("l_suppkey", "l_orderkey", "l_linenumber")


DEMOGRAPHICS = "SELECT entity_id, data_year, 'pep' AS basis, pep AS population, CAST(NULL AS DOUBLE) AS margin FROM demographics WHERE pep IS NOT NULL UNION ALL SELECT entity_id, data_year, 'acs5', acs5, round(acs5 * 0.02, 6) FROM demographics WHERE acs5 IS NOT NULL"


def _bases(a):
    pep = a.demographics.select("entity_id", "data_year", F.lit("pep").alias("basis"), F.col("pep").alias("population")).where("population is not null")
    acs = a.demographics.select("entity_id", "data_year", F.lit("acs5").alias("basis"), F.col("acs5").alias("population"), F.round(F.col("acs5") * 0.02, 6).alias("margin")).where("population is not null")
    return C.append_basis(pep, acs)


@query("c15_second_basis", DEMOGRAPHICS)
def second_basis(a):
    return _bases(a)


@query("c17_last_basis_wins", f"SELECT entity_id, basis, max(data_year) AS data_year, arg_max(population, data_year) AS population FROM ({DEMOGRAPHICS}) GROUP BY 1, 2")
def last_basis(a):
    return C.latest_wins(_bases(a), ["entity_id", "basis"], "data_year").select("entity_id", "basis", "data_year", "population")


@query("p17_stripped_keys", "SELECT entity_id, data_year, population FROM (SELECT entity_id, data_year, balance_population AS population FROM population WHERE balance_population IS NOT NULL)")
def stripped(a):
    return a.population.where("balance_population is not null").select(codes.strip_suffix(F.concat("entity_id", F.lit("#balance"))).alias("entity_id"), "data_year", F.col("balance_population").alias("population"))


def _subject_state(a):
    return a.entity.where(F.col("entity_id") == SUBJECT).first()["state"]  # one row


@query("q8_state_largest", f"SELECT entity_id, name, denominator FROM agency_year WHERE state = (SELECT state FROM entity WHERE entity_id = '{SUBJECT}') AND data_year = 1998 ORDER BY denominator DESC NULLS LAST, entity_id LIMIT 10")
def state_largest(a):
    return published.state_profile(a.agency_year, _subject_state(a), 1998)["largest"].select("entity_id", "name", "denominator")


@query("q8_state_trend", f"SELECT data_year, CAST(sum(violent_offenses) AS BIGINT) AS offenses FROM agency_year WHERE state = (SELECT state FROM entity WHERE entity_id = '{SUBJECT}') GROUP BY 1")
def state_trend(a):
    return published.state_profile(a.agency_year, _subject_state(a), 1998)["trend"].select("data_year", "offenses")


@query("q11_coverage_heat", "SELECT state, data_year, count(*) AS total, " + ", ".join(f"CAST(sum(CASE WHEN coverage = '{c}' THEN 1 ELSE 0 END) AS BIGINT) AS {c.lower()}" for c in ("COMPLETE", "PARTIAL", "NONE", "UNKNOWN")) + " FROM agency_year GROUP BY 1, 2")
def coverage_heat(a):
    return A.status_pivot(a.agency_year, ["state", "data_year"], "coverage", ["COMPLETE", "PARTIAL", "NONE", "UNKNOWN"])


@query("g14_allowed_metrics", "SELECT m.metric_id, a.n FROM (VALUES ('violent_rate', true), ('sworn', false)) m(metric_id, ranking_allowed) JOIN (SELECT 'violent_rate' AS metric_id, count(violent_rate) AS n FROM agency_year UNION ALL SELECT 'sworn', count(sworn) FROM agency_year) a ON a.metric_id = m.metric_id WHERE ranking_allowed")
def allowed_metrics(a):
    """How many values each metric has that the registry lets be ranked."""
    listed = records.registry_df(a.spark, [{"metric_id": "violent_rate", "ranking_allowed": True}, {"metric_id": "sworn"}], StructType.fromDDL("metric_id string, ranking_allowed boolean"))
    n = a.agency_year.agg(F.count("violent_rate").alias("violent_rate"), F.count("sworn").alias("sworn")).unpivot([], ["violent_rate", "sworn"], "metric_id", "n")
    return n.join(listed.where("ranking_allowed").select("metric_id"), "metric_id")


from . import resolution  # noqa: E402, F401  its queries register themselves
from . import maps, releases  # noqa: E402, F401, I001
