import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import codes, measures, names, policy


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_expressions(spark):
    cases = [
        (codes.pad(F.lit("1"), 2), "01"), (codes.pad(F.lit("12345"), 2), "12345"), (codes.pad(F.lit(" "), 2), None),
        (codes.place_geoid(F.lit("1"), F.lit("124")), "0100124"), (codes.county_geoid(F.lit("6"), F.lit("37")), "06037"), (codes.county_geoid(F.lit("6"), F.lit(None).cast("string")), None),
        (codes.strip_geoidfq(F.lit("1600000US0100100")), "0100100"), (codes.strip_geoidfq(F.lit(None).cast("string")), None),
        (codes.canonical_state_abbr(F.lit("NB")), "NE"), (codes.canonical_state_abbr(F.lit("ne")), "NE"), (codes.state_fips(F.lit("ne")), "31"), (codes.state_abbr(F.lit("31")), "NE"),
        (codes.to_int(F.lit("12.9")), 12), (codes.to_int(F.lit("x")), None), (codes.to_int_strict(F.lit("12.9")), None), (codes.to_flag(F.lit(" yes ")), True), (codes.to_flag(F.lit(None).cast("string")), False),
        (codes.cohort_key(F.lit("a"), F.lit(None).cast("string"), F.lit("u")), "a | unknown | u"), (codes.cohort_key(F.lit(None).cast("string"), F.lit("b"), F.lit("u")), None),
        (names.normalize_place(F.lit("Dover city")), "DOVER"), (names.normalize_place(F.lit("Dover town")), "DOVER"), (names.normalize_place(F.lit("Autauga County")), "AUTAUGA"),
        (names.normalize_agency(F.lit("Camden Police Department")), "CAMDEN"), (names.normalize_agency(F.lit("CAMDEN PD")), "CAMDEN"), (names.normalize_agency(F.lit("Camden Police Dept.")), "CAMDEN"),
        (names.classify(F.lit("Alameda County Sheriff's Office"), F.lit("County")), "county_sheriff"), (names.classify(F.lit("Dover Police Department"), F.lit("City")), "municipal_police"),
        (names.classify(F.lit("University of Delaware Police"), F.lit("University or College")), "university_police"), (names.classify(F.lit("Metro Transit Police"), F.lit("Other")), "transit_police"),
        (names.classify(F.lit("Whatcom County Sheriff"), F.lit("City")), "county_sheriff"), (names.classify(F.lit("Prince County Police"), F.lit("County")), "county_police"),
        (names.display_name(F.lit("Dover"), F.lit("Unit 2")), "Dover (Unit 2)"), (names.display_name(F.lit("Dover"), F.lit("dover")), "Dover"),
        (measures.haversine_km(*[F.lit(x).cast("double") for x in (1.0, None, 2.0, 3.0)]), None),
        (measures.finite(F.lit(float("nan"))), None), (measures.safe_ratio(F.lit(1), F.lit(0)), None), (measures.pct_change(F.lit(-4), F.lit(-2)), 50.0), (measures.rel_divergence(F.lit(3), F.lit(2)), 0.5),
    ]
    got = spark.range(1).select(*[c.alias(f"c{k}") for k, (c, _) in enumerate(cases)]).first()
    assert list(got) == [want for _, want in cases]


def test_haversine(spark):
    km = one(spark, measures.haversine_km(F.lit(38.9072), F.lit(-77.0369), F.lit(39.2904), F.lit(-76.6122)))
    assert 50 < km < 70


def test_bands(spark):
    got = values(spark, measures.band(F.col("n")), [(x,) for x in (0, 9999, 10000, 49999, 570053, 8596825, None, -1)], "n long")
    assert got == ["<10K", "<10K", "10K-25K", "25K-50K", "500K-1M", "1M+", None, None]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(row[j] + 1 if x == y else max(row[j + 1], now[-1]))
        row = now
    return row[-1]


def token_set(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    s, u, v = (" ".join(sorted(t)) for t in (x & y, x - y, y - x))
    if s and (not u or not v):
        return 100.0
    su, sv = " ".join(filter(None, [s, u])), " ".join(filter(None, [s, v]))
    r = lambda p, q: 200.0 * lcs(p, q) / (len(p) + len(q))
    return max([r(su, sv)] + ([r(s, su), r(s, sv)] if s else []))


def test_token_set_ratio(spark):
    pairs = [("BOSTON", "BOSTON"), ("BOSTON", "SUFFOLK"), ("NEW YORK", "YORK NEW NEW"), ("A B C", "B C D"), ("", "A"), ("NORTH METRO TRANSIT", "METRO TRANSIT AUTHORITY"), ("BALTIMORE", "BALTIMOR"), ("AB", "C")]
    got = values(spark, measures.token_set_ratio(F.col("a"), F.col("b")), pairs, "a string, b string")
    assert got == pytest.approx([token_set(*p) for p in pairs])


@pytest.mark.parametrize(
    "kind, basis, level, want",
    [
        ("municipal_police", "pep", "place", "municipal_population"), ("municipal_police", "acs5", "place", "municipal_population"), ("municipal_police", None, "place", "municipal_population"),
        ("county_sheriff", "pep_county_balance", "county", "unincorporated_population"), ("county_sheriff", "pep", "county", "county_population"), ("county_police", "pep_county_balance", "county", "unincorporated_population"),
        ("state_police", "pep", "state", "statewide_population"), ("university_police", "pep", "place", "campus_population"), ("transit_police", "pep", "place", "transit_population"), ("federal", None, None, "not_applicable"),
    ],
)
def test_denominator_type(spark, kind, basis, level, want):
    assert values(spark, policy.denominator_type_for(F.col("k"), F.col("b"), F.col("l")), [(kind, basis, level)], "k string, b string, l string") == [want]


def test_confidence(spark):
    rows = [("municipal_population", "pep", "accepted", 2.0, True), ("municipal_population", "acs5", "accepted", 2.0, True), ("municipal_population", "pep", "needs_review", 2.0, True), ("municipal_population", None, "accepted", None, False),
            ("unincorporated_population", "pep_county_balance", "accepted", 3.1, True), ("unincorporated_population", "pep_county_balance", "accepted", 8.1, True), ("statewide_population", "pep", "accepted", 0.4, True)]
    got = values(spark, policy.denominator_confidence(*[F.col(c) for c in "dbsph"]), rows, "d string, b string, s string, p double, h boolean")
    assert got == ["HIGH", "MODERATE", "LIMITED", "LIMITED", "MODERATE", "LIMITED", "NOT_COMPARABLE"]


def test_coverage_and_gates(spark):
    assert values(spark, policy.coverage_status(F.col("m")), [(m,) for m in (12, 13, 11, 1, 0, None)], "m int") == ["COMPLETE", "COMPLETE", "PARTIAL", "PARTIAL", "NONE", "UNKNOWN"]
    rows = [(12, 100, "HIGH", 5), (7, 100, "HIGH", 5), (12, None, "LIMITED", 5), (12, 100, "HIGH", -1), (12, 100, "NOT_COMPARABLE", 5), (None, 100, "HIGH", None), (12, 100, "HIGH", None)]
    columns = [F.col(c) for c in ("m", "d", "c", "o")]
    assert values(spark, policy.rate_allowed(*columns), rows, "m int, d int, c string, o int") == [True, False, False, False, False, False, True]
    why = values(spark, policy.rate_withheld_reason(*columns), rows, "m int, d int, c string, o int")
    assert why == [None, *(policy.REASONS[k] for k in ("partial_year", "no_denominator", "negative_source_value", "not_comparable", "no_reporting")), None]
    assert values(spark, policy.percentile_allowed(F.col("n"), F.col("c")), [(5, "HIGH"), (4, "HIGH"), (None, "HIGH"), (5, "NOT_COMPARABLE")], "n int, c string") == [True, False, False, False]


def test_common_subsequence_of_any_length(spark):
    """By bits for short texts, by rows for long ones."""
    rng = random.Random(5)
    pairs = [("".join(rng.choices("ABC é", k=rng.randint(0, 75))), "".join(rng.choices("ABC é", k=rng.randint(0, 75)))) for _ in range(120)]

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            after = [0]
            for j, y in enumerate(b):
                after.append(row[j] + 1 if x == y else max(after[-1], row[j + 1]))
            row = after
        return row[-1]

    got = values(spark, measures.indel_ratio(F.col("a"), F.col("b")), pairs, "a string, b string")
    assert got == pytest.approx([200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100 for a, b in pairs])
