"""Queries of record linkage: the cascade and the one resolution over parts as entities and geographies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import measures, names
from ..operators import candidates
from ..operators import linkage as L
from .analog import Analog
from .catalogue import query, r6


def likeness_sql(pairs: str) -> str:
    """CTEs up to `likeness` (a, b, score) for a query of pairs (a, b) of names in normal form: subsequences as bits of one number."""
    words = lambda c: f"list_sort(list_distinct(list_filter(string_split({c}, ' '), lambda w: w <> '')))"
    rest = lambda x, y: f"array_to_string(list_sort(list_filter({x}, lambda w: NOT list_contains({y}, w))), ' ')"
    same = "list_sum([CASE WHEN v[j] = c THEN (1::HUGEINT << (j - 1)::INT) ELSE 0::HUGEINT END FOR j IN range(1, length(v) + 1)])::HUGEINT"
    step = "lambda row, hit: (row + (row & hit)) | (row - (row & hit))"
    masks = f"list_transform(string_split(u, ''), lambda c: {same})"
    return f"""asked AS ({pairs}), worded AS (SELECT a, b, {words('a')} AS x, {words('b')} AS y FROM (SELECT DISTINCT a, b FROM asked WHERE a IS NOT NULL AND b IS NOT NULL)),
parted AS (SELECT a, b, len(x) AS nx, len(y) AS ny, array_to_string(list_sort(list_filter(x, lambda w: list_contains(y, w))), ' ') AS s, {rest('x', 'y')} AS u, {rest('y', 'x')} AS v FROM worded),
counted AS (SELECT *, CASE WHEN s <> '' THEN 1 ELSE 0 END AS gap, CASE WHEN u = '' OR v = '' THEN 0 ELSE length(v) - bit_count(list_reduce({masks}, {step}, (1::HUGEINT << length(v)::INT) - 1) & ((1::HUGEINT << length(v)::INT) - 1)) END AS lcs FROM parted),
sized AS (SELECT *, length(s) + CASE WHEN u <> '' THEN gap + length(u) ELSE 0 END AS nu, length(s) + CASE WHEN v <> '' THEN gap + length(v) ELSE 0 END AS nv FROM counted),
likeness AS (SELECT a, b, CASE WHEN nx = 0 OR ny = 0 THEN 0.0 WHEN s <> '' AND (u = '' OR v = '') THEN 100.0
 ELSE greatest(200.0::DOUBLE * (length(s) + gap + lcs) / greatest(nu + nv, 1), CASE WHEN s <> '' THEN 200.0::DOUBLE * length(s) / (length(s) + nu) ELSE 0 END, CASE WHEN s <> '' THEN 200.0::DOUBLE * length(s) / (length(s) + nv) ELSE 0 END) END AS score FROM sized)"""


KM = "CASE WHEN {a}.lat IS NOT NULL AND {b}.lat IS NOT NULL THEN 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))) END"
TOWN_STATES = ("Brand#1", "Brand#2")
LETTERS = ("0123456789", "ABCDEFGHIJ")

ENTITY_SQL = """SELECT 'e' || CAST(p_partkey AS VARCHAR) AS entity_id, CASE WHEN k <= 3 THEN 'municipal_police' WHEN k = 4 THEN 'university_police' WHEN k = 5 THEN 'county_sheriff' WHEN k = 6 THEN 'county_police' ELSE 'state_police' END AS kind, state, upper(name) AS norm, county_norm,
 CASE WHEN p_partkey % 17 <> 0 THEN 30 + (p_partkey * 7919 % 1000) / 1000.0 END AS lat, CASE WHEN p_partkey % 17 <> 0 THEN -100 + (p_partkey * 6007 % 1000) / 1000.0 END AS lon
 FROM (SELECT *, p_partkey % 8 AS k, CASE WHEN p_partkey % 50 <> 49 THEN p_brand END AS state, p_name || ' ' || translate(CAST(p_partkey % 4 AS VARCHAR), '0123456789', 'ABCDEFGHIJ') AS full_name,
  CASE p_partkey % 7 WHEN 0 THEN full_name || 'XS' WHEN 1 THEN substr(full_name, 1, length(full_name) - 3) || 'QQQ' WHEN 2 THEN 'zzyzx ' || translate(CAST(p_partkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') WHEN 3 THEN '' WHEN 4 THEN split_part(full_name, ' ', 3) || ' ' || p_name ELSE full_name END AS name,
  CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN upper(name) ELSE 'NOWHERE' END AS county_norm FROM part)"""
GEO_SQL = """SELECT 'state:' || p_brand AS geo_id, 'state' AS geo_level, p_brand AS state, p_brand AS norm, NULL AS lat, NULL AS lon FROM part WHERE p_brand <> 'Brand#9' GROUP BY p_brand
 UNION ALL SELECT level || ':' || CAST(p_partkey AS VARCHAR), level, p_brand, upper(p_name) || CASE WHEN level = 'county' THEN '' ELSE ' ' || translate(CAST(p_partkey * 3 % 4 AS VARCHAR), '0123456789', 'ABCDEFGHIJ') END, 30 + (p_partkey * 7907 % 1000) / 1000.0, -100 + (p_partkey * 6011 % 1000) / 1000.0
 FROM (SELECT *, CASE p_partkey % 5 WHEN 0 THEN 'county' WHEN 3 THEN 'cousub' ELSE 'place' END AS level FROM part) WHERE level = 'county' OR p_brand <> 'Brand#3'"""


def entities(a: Analog) -> DataFrame:
    """Parts as entities of all kinds: with names of places, spoilt or foreign names, some without coordinates or state."""
    k, text = F.col("p_partkey"), lambda c: F.translate(c.cast("string"), *LETTERS)
    full = F.concat("p_name", F.lit(" "), text(k % 4))
    name = F.when(k % 7 == 0, F.concat(full, F.lit("XS"))).when(k % 7 == 1, F.concat(F.expr("substr(full_name, 1, length(full_name) - 3)"), F.lit("QQQ"))).when(k % 7 == 2, F.concat(F.lit("zzyzx "), text(k))).when(k % 7 == 3, "").when(k % 7 == 4, F.concat(text(k % 4), F.lit(" "), "p_name")).otherwise(full)
    m = k % 8
    kind = F.when(m <= 3, "municipal_police").when(m == 4, "university_police").when(m == 5, "county_sheriff").when(m == 6, "county_police").otherwise("state_police")
    at = lambda times, base: F.when(k % 17 != 0, base + (k * times % 1000) / 1000.0)
    named = a.read("part").withColumn("full_name", full).withColumn("name", name)
    county = F.when(k % 3 == 0, F.concat("p_name", F.lit(" County"))).when(k % 3 == 1, F.lit(None)).otherwise("Nowhere Parish")
    return named.select(F.concat(F.lit("e"), k.cast("string")).alias("entity_id"), kind.alias("kind"), F.when(k % 50 != 49, F.col("p_brand")).alias("state"), "name", names.normalize_agency(F.concat("name", F.lit(" Police Dept."))).alias("norm_name"), county.alias("county_name"), at(7919, 30).alias("lat"), at(6007, -100).alias("lon"))


def geographies(a: Analog) -> DataFrame:
    """Parts as counties, places and county subdivisions of their brands; one brand isn't listed as a state, one has no municipalities."""
    k = F.col("p_partkey")
    none = F.lit(None).cast("double")
    states = a.read("part").where("p_brand <> 'Brand#9'").select(F.concat(F.lit("state:"), "p_brand").alias("geo_id"), F.lit("state").alias("geo_level"), F.col("p_brand").alias("state"), F.col("p_brand").alias("name"), none.alias("lat"), none.alias("lon")).distinct()
    level = F.when(k % 5 == 0, "county").when(k % 5 == 3, "cousub").otherwise("place")
    name = F.when(k % 5 == 0, F.concat("p_name", F.lit(" County"))).otherwise(F.concat("p_name", F.lit(" "), F.translate((k * 3 % 4).cast("string"), *LETTERS), F.when(k % 5 == 3, " town").otherwise(" city")))
    some = a.read("part").where((k % 5 == 0) | (F.col("p_brand") != "Brand#3"))
    return states.unionByName(some.select(F.concat(level, F.lit(":"), k.cast("string")).alias("geo_id"), level.alias("geo_level"), F.col("p_brand").alias("state"), name.alias("name"), (30 + (k * 7907 % 1000) / 1000.0).alias("lat"), (-100 + (k * 6011 % 1000) / 1000.0).alias("lon")))


#: The cascade of places for the entities `o` (entity_id, state, kind, norm, lat, lon) among `town` (geo_id, state, norm, lat, lon), with `likeness`.
CASCADE_SQL = f"""met AS (SELECT o.entity_id, o.norm, t.geo_id, t.norm AS t_norm, {KM.format(a='o', b='t')} AS km FROM o JOIN town t USING (state)),
exact AS (SELECT entity_id, count(*) AS n, min(geo_id) AS only_one, min(struct_pack(km := km, id := geo_id)) FILTER (km <= 25) AS near FROM met WHERE norm = t_norm AND norm <> '' GROUP BY 1),
liked AS (SELECT met.*, score FROM met JOIN likeness ON a = norm AND b = t_norm WHERE entity_id NOT IN (SELECT entity_id FROM exact)),
top AS (SELECT * FROM liked WHERE score >= 88 QUALIFY score = max(score) OVER (PARTITION BY entity_id)),
fuzzy AS (SELECT entity_id, max(score) AS score, CASE WHEN count(km) = 0 THEN min(geo_id) ELSE (min(struct_pack(km := km, id := geo_id)) FILTER (km IS NOT NULL)).id END AS id, min(km) AS km FROM top GROUP BY 1),
chosen AS (SELECT * FROM fuzzy WHERE score >= 97 AND (km IS NULL OR km <= 25) OR score >= 88 AND (km IS NULL OR km <= 75)),
close AS (SELECT entity_id, (min(struct_pack(km := km, id := geo_id, score := score)) FILTER (km <= 10)) AS c FROM liked WHERE entity_id NOT IN (SELECT entity_id FROM chosen) GROUP BY 1),
cascade AS (SELECT o.entity_id, o.state, o.kind, CASE WHEN x.n = 1 THEN x.only_one WHEN x.n > 1 THEN x.near.id WHEN f.id IS NOT NULL THEN f.id WHEN c.c.score >= 55 AND o.kind = 'municipal_police' THEN c.c.id END AS target_id,
 CASE WHEN x.n = 1 THEN 'exact_name' WHEN x.n > 1 AND x.near IS NOT NULL THEN 'exact_name_nearest' WHEN x.n > 1 THEN 'ambiguous_name' WHEN f.id IS NOT NULL THEN 'fuzzy_name' WHEN c.c.score >= 55 AND o.kind = 'municipal_police' THEN 'nearest_place' ELSE 'none' END AS method,
 CASE WHEN x.n = 1 THEN 1.0 WHEN x.n > 1 AND x.near IS NOT NULL THEN 0.98 WHEN x.n > 1 THEN 0.5 WHEN f.id IS NOT NULL THEN f.score / 100 WHEN c.c.score >= 55 AND o.kind = 'municipal_police' THEN c.c.score / 100 ELSE 0.0 END AS score,
 CASE WHEN x.n = 1 OR x.near IS NOT NULL THEN 'accepted' WHEN x.n > 1 THEN 'needs_review' WHEN f.id IS NOT NULL THEN CASE WHEN f.score >= 97 AND (f.km IS NULL OR f.km <= 25) THEN 'accepted' ELSE 'needs_review' END WHEN c.c.score >= 55 AND o.kind = 'municipal_police' THEN 'needs_review' ELSE 'unmatched' END AS review_status
 FROM o LEFT JOIN exact x USING (entity_id) LEFT JOIN chosen f USING (entity_id) LEFT JOIN close c USING (entity_id))"""

TABLES_SQL = f"""WITH e AS ({ENTITY_SQL}), g AS ({GEO_SQL}), town AS (SELECT * FROM g WHERE geo_level = CASE WHEN state IN {TOWN_STATES} THEN 'cousub' ELSE 'place' END), county AS (SELECT * FROM g WHERE geo_level = 'county'),
o AS (SELECT * FROM e WHERE state IS NOT NULL AND kind IN ('municipal_police', 'university_police'))"""


@query("p12_token_set_ratio", f"WITH p AS (SELECT DISTINCT p_name, 'the ' || split_part(p_name, ' ', 2) || 's ' || split_part(p_name, ' ', 1) AS other FROM part), {likeness_sql('SELECT p_name AS a, other AS b FROM p')} SELECT a AS p_name, b AS other, round(score, 6) AS score FROM likeness", prefix=False)
def similarity(a):
    words = F.split("p_name", " ")
    q = a.read("part").select("p_name", F.concat(F.lit("the "), words[1], F.lit("s "), words[0]).alias("other")).distinct()
    return q.select("p_name", "other", r6(measures.token_set_ratio(F.col("p_name"), F.col("other")), "score"))


@query("j12_alike_names", f"{TABLES_SQL}, {likeness_sql('SELECT o.norm AS a, t.norm AS b FROM o JOIN town t USING (state)')} SELECT DISTINCT o.state AS block, a AS l_name, b AS r_name, round(score, 6) AS score FROM likeness JOIN o ON o.norm = a JOIN town t ON t.state = o.state AND t.norm = b WHERE score >= 88", prefix=False)
def alike_names(a):
    """All pairs of alike names of a state, found through the index."""
    left, right = _others(a).select("block", F.col("norm_name").alias("l_name")), _towns(a).select("block", F.col("norm_name").alias("r_name"))
    return candidates.alike_pairs(left, right, 88.0).select("block", "l_name", "r_name", r6("like", "score"))


def _others(a: Analog) -> DataFrame:
    return entities(a).where("state is not null and kind in ('municipal_police', 'university_police')").withColumnRenamed("state", "block")


def _towns(a: Analog) -> DataFrame:
    return L.municipalities(geographies(a), TOWN_STATES).select(F.col("geo_id").alias("target_id"), F.col("state").alias("block"), names.normalize_place(F.col("name")).alias("norm_name"), "lat", "lon")


@query("r6_link_cascade", f"{TABLES_SQL}, {likeness_sql('SELECT o.norm AS a, t.norm AS b FROM o JOIN town t USING (state)')}, {CASCADE_SQL} SELECT entity_id, target_id, method, round(score, 6) AS score, review_status FROM cascade", prefix=False)
def cascade(a):
    out = L.link(_others(a), _towns(a), by_place=F.col("kind") == "municipal_police")
    return out.select("entity_id", "target_id", "method", r6("score"), "review_status")


@query("r10_resolution", f"""{TABLES_SQL}, {likeness_sql("SELECT o.norm AS a, t.norm AS b FROM o JOIN town t USING (state) UNION SELECT e.county_norm, c.norm FROM e JOIN county c USING (state) WHERE kind IN ('county_sheriff', 'county_police')")}, {CASCADE_SQL},
same AS (SELECT state, norm, count(*) AS n, min(geo_id) AS id FROM county GROUP BY 1, 2),
sheriff AS (SELECT e.*, CAST(substr(entity_id, 2) AS BIGINT) % 3 <> 1 AS given FROM e WHERE state IS NOT NULL AND kind IN ('county_sheriff', 'county_police')),
best AS (SELECT s.entity_id, max(struct_pack(score := score, own := c.norm = s.county_norm)) AS m FROM sheriff s JOIN same c USING (state) JOIN likeness ON a = s.county_norm AND b = c.norm WHERE score >= 97 GROUP BY 1),
likeliest AS (SELECT s.entity_id, m.score AS score, min(c.id) AS id FROM best JOIN sheriff s USING (entity_id) JOIN same c USING (state) JOIN likeness ON a = s.county_norm AND b = c.norm AND score = m.score AND (c.norm = s.county_norm) = m.own GROUP BY 1, 2),
counties AS (SELECT s.entity_id, s.state, CASE WHEN given AND x.n = 1 THEN x.id ELSE l.id END AS target_id, CASE WHEN given AND x.n = 1 THEN 'exact_county_name' WHEN l.id IS NOT NULL THEN CASE WHEN given THEN 'fuzzy_county_name' ELSE 'fuzzy_entity_name' END ELSE 'state_fallback' END AS method,
 CASE WHEN given AND x.n = 1 THEN 1.0 WHEN l.id IS NOT NULL THEN l.score / 100 ELSE 0.2 END AS score FROM sheriff s LEFT JOIN same x ON x.state = s.state AND x.norm = s.county_norm LEFT JOIN likeliest l USING (entity_id)),
found AS (SELECT entity_id, target_id, method, score, CASE WHEN method = 'state_fallback' THEN 'needs_review' ELSE 'accepted' END AS review_status, state FROM counties
 UNION ALL SELECT entity_id, CASE WHEN method <> 'none' THEN target_id END, CASE WHEN method = 'none' THEN 'state_fallback' ELSE method END, CASE WHEN method = 'none' THEN 0.2 ELSE score END, CASE WHEN method = 'none' AND state NOT IN (SELECT state FROM town) THEN 'needs_review' ELSE review_status END, state FROM cascade
 UNION ALL SELECT entity_id, g.geo_id, CASE WHEN g.geo_id IS NULL THEN 'none' ELSE 'type_rule' END, CASE WHEN g.geo_id IS NULL THEN 0.0 ELSE 1.0 END, CASE WHEN g.geo_id IS NULL THEN 'unmatched' ELSE 'accepted' END, e.state FROM e LEFT JOIN g ON g.state = e.state AND g.geo_level = 'state' WHERE e.state IS NOT NULL AND kind = 'state_police'
 UNION ALL SELECT entity_id, NULL, 'none', 0.0, 'unmatched', NULL FROM e WHERE state IS NULL)
SELECT f.entity_id, CASE WHEN method = 'state_fallback' THEN s.geo_id ELSE target_id END AS target_id, t.norm AS target_name, method, round(f.score, 6) AS score, review_status FROM found f LEFT JOIN g s ON s.state = f.state AND s.geo_level = 'state' LEFT JOIN g t ON t.geo_id = CASE WHEN method = 'state_fallback' THEN s.geo_id ELSE target_id END""", prefix=False)
def resolution(a):
    """One row for each entity, of every method and status."""
    out = L.resolve(entities(a), geographies(a), TOWN_STATES)
    norm = F.when(F.col("target_id").startswith("state:"), F.col("target_name")).otherwise(names.normalize_place(F.col("target_name")))
    return out.select("entity_id", "target_id", norm.alias("target_name"), "method", r6("score"), "review_status")
