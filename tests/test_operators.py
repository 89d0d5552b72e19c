import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.functions import measures
from plumbline.operators import candidates, canonical, linkage, quality, quantiles, reconcile, windows
from plumbline.sources import delimited, fixed_width, records, sinks
from plumbline.streaming.landing import land_new_files

BODY = '{"offenses":{"actuals":{"Testville Offenses":{"01-2024":10,"02-2024":12,"03-2024":null,"01-2025":5,"02-2025":5,"bad":1},"Testville Clearances":{"01-2024":4,"02-2024":3}}}}'


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_monthly_reduction(spark):
    raw = spark.createDataFrame([("A", BODY), ("B", None)], "ori string, body string")
    months = canonical.pick_series(canonical.monthly_json(raw, ["ori"], "body"), ["ori"], " Offenses")
    out = canonical.monthly_to_annual(months, ["ori"], "period", "value")
    assert rows(out, "data_year", "total", "months_reported", "value_type") == [(2024, 22, 2, "partial_year"), (2025, 10, 2, "partial_year")]


def test_police_record(spark, tmp_path):
    line = "5" + "02" + "AK00101" + "1 " + " " + "24" + "00001" + "   " + "000291247" + "ANCHORAGE".ljust(24) + "ALASKA" + "00322" + "00044" + "00366" + "00044" + "00124" + "00168" + "00534" + "013" + "018"
    (tmp_path / "a.txt").write_text("\n".join([line, "1" + "0" * 200, "5short"]), encoding="latin-1")
    got = fixed_width.read_police_employees(spark, str(tmp_path)).first()
    assert (got.ori7, got.data_year, got.male_officers, got.male_civilians, got.female_officers, got.female_civilians, got.total_employees, got.agency_name) == ("AK00101", 2024, 322, 44, 44, 124, 534, "ANCHORAGE")
    assert fixed_width.read_police_employees(spark, str(tmp_path)).count() == 1
    assert [r[0] for r in spark.createDataFrame([("80",), ("79",)], "y string").select(fixed_width.full_year(F.col("y"))).collect()] == [1980, 2079]


def test_finance_records(spark, tmp_path):
    (tmp_path / "f.txt").write_text("172031162236E62     22384832024R\n011001100001E62        60492024I\n011001100001T01        60492024I\nshort")
    got = rows(fixed_width.read_finance_amounts(spark, str(tmp_path), ["E62"]), "gov_id", "amount", "data_year", "flag", "state_fips", "gov_type", "county_fips", "pid6")
    assert got == [("011001100001", 6049, 2024, "I", "01", "County", "001", "100001"), ("172031162236", 2238483, 2024, "R", "17", "City", "031", "162236")]


def test_unit_directory_and_members(spark, tmp_path):
    unit = "011001100001" + "AUTAUGA COUNTY".ljust(64) + "Autauga".ljust(35) + "99001" + "59759".rjust(9) + " " * 15 + "0930" + "24"
    (tmp_path / "units.txt").write_text(unit + "\n" + "022002200002SHORT TOWN")
    (tmp_path / "amounts.txt").write_text("172031162236E62     22384832024R")
    got = fixed_width.read_members(spark, str(tmp_path), {"units.txt": fixed_width.read_unit_directory, "amounts.txt": fixed_width.read_finance_amounts})
    assert rows(got["units.txt"], "gov_id", "name", "population", "fiscal_year_ending") == [("011001100001", "AUTAUGA COUNTY", 59759, "0930"), ("022002200002", "SHORT TOWN", None, "")]
    assert got["amounts.txt"].count() == 1


def test_yearly_files_and_codes(spark, tmp_path):
    (tmp_path / "agencies_2023.csv").write_text("ori,place\nA, 124\n")
    (tmp_path / "agencies_2024.csv").write_text("ori,place\nA,00125\nB,\n")
    got = delimited.pad_codes(delimited.read_yearly_csv(spark, str(tmp_path)), {"place": 5})
    assert sorted((r.ori, r.place or "", r.file_year) for r in got.collect()) == [("A", "00124", 2023), ("A", "00125", 2024), ("B", "", 2024)]


def test_registry_and_gate(spark):
    schema = StructType.fromDDL("metric_id string, sources string, comparison_allowed boolean, ranking_allowed boolean")
    registry = records.registry_df(spark, [{"metric_id": "rate", "sources": ["a", "b"], "comparison_allowed": True}, {"metric_id": "rank", "sources": "c"}], schema)
    assert rows(registry, "metric_id", "sources", "comparison_allowed", "ranking_allowed") == [("rank", "c", False, False), ("rate", "a | b", True, False)]
    records.gate_metric(registry, "rate", "comparison")
    for metric, use in (("rate", "ranking"), ("rank", "comparison"), ("none", "comparison")):
        with pytest.raises(ValueError):
            records.gate_metric(registry, metric, use)


def test_delimited_sniffing(spark, tmp_path):
    (tmp_path / "a.txt").write_text("GEOID | NAME \n01| Autauga \n")
    (tmp_path / "b.txt").write_text("GEOID\tNAME\n02\tBaldwin|x\n")
    assert rows(delimited.read_delimited(spark, str(tmp_path / "a.txt")), "GEOID", "NAME") == [("01", "Autauga")]
    assert rows(delimited.read_delimited(spark, str(tmp_path / "b.txt")), "GEOID", "NAME") == [("02", "Baldwin|x")]


def test_first_and_latest(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", None, "z")], "k string, t int, v string")
    assert rows(canonical.latest_wins(df, ["k"], "t", "v"), "k", "v") == [("a", "y"), ("b", "z")]
    assert rows(canonical.first_wins(df, ["k"], "t", "v"), "k", "v") == [("a", "x"), ("b", "z")]


def test_staffing_rules(spark):
    entities = spark.createDataFrame([("K1", "E1"), ("K2", "E2"), ("K2", "E3")], "key string, entity_id string")
    records_ = spark.createDataFrame([("K1", "pe", 2020, 5, 3, 10), ("K1", "pe", 2020, 5, 4, 12), ("K1", "pe", 2021, 0, 0, 0), ("K2", "pe", 2020, 1, 1, 2), ("K1", "pe", 2022, 1, None, None)], "key string, source string, data_year int, male int, female int, total int")
    facts, log = canonical.staffing(records_, entities)
    assert rows(facts, "entity_id", "data_year", "sworn", "total") == [("E1", 2020, 9, 12)]
    assert {r.check_id for r in log.collect()} == {"zero_filled_year", "duplicate_record", "ambiguous_key"}


def test_disambiguation(spark):
    rec = spark.createDataFrame([("k1", "BOSTON"), ("k2", "SOMEWHERE ELSE"), ("k3", "METRO TRANSIT AUTHORITY"), ("k4", "CHP")], "key string, name string")
    cand = spark.createDataFrame(
        [("k1", "MA0130100", "BOSTON"), ("k1", "MA013019E", "SUFFOLK UNIVERSITY"), ("k2", "X00", "BOSTON"), ("k2", "X9E", "SUFFOLK"), ("k3", "N00", "NORTH METRO TRANSIT AUTHORITY"), ("k3", "S01", "SOUTH METRO TRANSIT AUTHORITY"), ("k4", "C5A", "CHP"), ("k4", "C5B", "CHP"), ("k4", "C5C", "CHP")],
        "key string, candidate_id string, name string",
    )
    chosen, log = linkage.disambiguate(rec, cand)
    assert rows(chosen, "key", "candidate_id") == [("k1", "MA0130100")]
    assert rows(log, "key", "check_id")[1:] == [("k2", "ambiguous_key"), ("k3", "ambiguous_key"), ("k4", "ambiguous_key")]


def test_link_cascade_statuses(spark):
    entities = spark.createDataFrame([("a", "S", "DOVER", 1.0, 1.0), ("b", "S", "TWIN", 1.0, 1.0), ("c", "S", "SMITHFIELDS", 2.0, 2.0), ("d", "S", "QQQQ", None, None), ("e", "S", "TWIN", 40.0, 1.0)], "entity_id string, block string, norm_name string, lat double, lon double")
    targets = spark.createDataFrame([("t1", "S", "DOVER", 1.0, 1.0), ("t2", "S", "TWIN", 1.1, 1.0), ("t3", "S", "TWIN", 5.0, 5.0), ("t4", "S", "SMITHFIELD", 2.0, 2.0)], "target_id string, block string, norm_name string, lat double, lon double")
    got = {r.entity_id: (r.target_id, r.method, r.review_status) for r in linkage.link(entities, targets).collect()}
    assert got == {"a": ("t1", "exact_name", "accepted"), "b": ("t2", "exact_name_nearest", "accepted"), "c": ("t4", "fuzzy_name", "needs_review"), "d": (None, "none", "unmatched"), "e": (None, "ambiguous_name", "needs_review")}


def test_the_nearest_target_is_asked_for_its_name(spark):
    """A near target of another name hides a farther one of a like name; only kinds of places ask at all."""
    entities = spark.createDataFrame([("a", "S", "m", "GREENVALE", 1.0, 1.0), ("b", "S", "m", "GREENVALE", 3.0, 3.0), ("c", "S", "x", "GREENVALE", 3.0, 3.0)], "entity_id string, block string, kind string, norm_name string, lat double, lon double")
    targets = spark.createDataFrame([("t1", "S", "QQQQQQ", 1.005, 1.0), ("t2", "S", "GREENVOLT", 1.06, 1.0), ("t3", "S", "GREENVOLT", 3.06, 3.0)], "target_id string, block string, norm_name string, lat double, lon double")
    got = {r.entity_id: (r.target_id, r.method) for r in linkage.link(entities, targets, by_place=F.col("kind") == "m").collect()}
    assert got == {"a": (None, "none"), "b": ("t3", "nearest_place"), "c": (None, "none")}


@pytest.mark.parametrize("small", [10_000, 3])
def test_exact_quantiles(spark, monkeypatch, small):
    """Against percentile(), with large groups, ties, nulls, NaN, wild values and null keys; brackets are used where groups exceed `small`."""
    monkeypatch.setattr(quantiles, "SMALL", small)
    rng = random.Random(6)
    rows = [("big", 1, rng.gauss(0, 1) * 10 ** rng.randint(-300, 300), rng.randint(0, 4)) for _ in range(12_000)] + [("big", 2, float(k), None) for k in range(3000)] + [("tied", None, 7.0, 1) for _ in range(4000)]
    rows += [(None, 1, x, 2) for x in (1.0, None, 2.0, 10.0)] + [("none", 1, None, None), ("one", 1, -0.5, 3), ("nan", 1, float("nan"), 1), ("nan", 1, 1.0, 2)]
    df = spark.createDataFrame(rows, "k string, y int, a double, b int").repartition(5)
    shares = (0.0, 0.25, 0.5, 0.9, 1.0)
    want = df.groupBy("k", "y").agg(*(F.percentile(c, F.array(*map(F.lit, shares))).alias(c) for c in ("a", "b")))
    got = quantiles.exact_quantiles(df, ["k", "y"], ["a", "b"], shares)
    table = lambda x: {(r.k, r.y): (r.a and [repr(v) for v in r.a], r.b and [repr(v) for v in r.b]) for r in x.collect()}
    assert table(got) == table(want)
    (row,) = quantiles.exact_quantiles(df, [], ["a"], (0.5,)).collect()
    assert row.a[0] == df.agg(F.median("a")).first()[0]
    assert quantiles.exact_quantiles(df.limit(0), ["k"], ["a"], (0.5,)).count() == 0


def test_every_entity_is_resolved_once(spark):
    geo = "geo_id string, geo_level string, state string, name string, lat double, lon double"
    places = spark.createDataFrame(
        [("st:A", "state", "A", "Astate", None, None), ("st:B", "state", "B", "Bstate", None, None), ("st:T", "state", "T", "Tstate", None, None), ("c1", "county", "A", "Clay County", None, None), ("p1", "place", "A", "Dover city", 1.0, 1.0), ("p2", "place", "A", "Twin town", 1.0, 1.0),
         ("p3", "place", "A", "Twin city", 5.0, 5.0), ("p4", "place", "T", "Hull CDP", 1.0, 1.0), ("s4", "cousub", "T", "Hull town", 1.0, 1.0)], geo)
    entities = [
        ("statewide", "state_police", "A", "x", "X", None, None, None), ("unlisted", "federal", "Z", "x", "X", None, None, None), ("sheriff", "county_sheriff", "A", "x", "X", "CLAY", None, None), ("lost county", "county_police", "A", "x", "X", "Mud", None, None),
        ("exact", "municipal_police", "A", "Dover PD", "DOVER", None, None, None), ("tie", "municipal_police", "A", "Twin PD", "TWIN", None, 1.1, 1.0), ("open tie", "other", "A", "Twin PD", "TWIN", None, None, None), ("town", "municipal_police", "T", "Hull PD", "HULL", None, None, None),
        ("nobody", "municipal_police", "A", "Zzz", "ZZZ", None, 1.0, 1.0), ("no towns", "municipal_police", "B", "Dover PD", "DOVER", None, 1.0, 1.0), ("no state", "municipal_police", None, "Dover PD", "DOVER", None, None, None), ("no name", None, "A", None, None, None, None, None),
    ]
    df = spark.createDataFrame(entities, "entity_id string, kind string, state string, name string, norm_name string, county_name string, lat double, lon double")
    got = {r.entity_id: (r.target_id, r.target_name, r.method, r.score, r.review_status) for r in linkage.resolve(df, places, ("T",)).collect()}
    assert got == {
        "statewide": ("st:A", "Astate", "type_rule", 1.0, "accepted"), "unlisted": (None, None, "none", 0.0, "unmatched"), "sheriff": ("c1", "Clay County", "exact_county_name", 1.0, "accepted"), "lost county": ("st:A", "Astate", "state_fallback", 0.2, "needs_review"),
        "exact": ("p1", "Dover city", "exact_name", 1.0, "accepted"), "tie": ("p2", "Twin town", "exact_name_nearest", 0.98, "accepted"), "open tie": (None, None, "ambiguous_name", 0.5, "needs_review"), "town": ("s4", "Hull town", "exact_name", 1.0, "accepted"),
        "nobody": ("st:A", "Astate", "state_fallback", 0.2, "unmatched"), "no towns": ("st:B", "Bstate", "state_fallback", 0.2, "needs_review"), "no state": (None, None, "none", 0.0, "unmatched"), "no name": ("st:A", "Astate", "state_fallback", 0.2, "unmatched"),
    }
    assert linkage.resolve(df.limit(0), places, ("T",)).count() == 0


@pytest.mark.parametrize("least", [97.0, 88.0, 55.0])
def test_index_finds_what_all_pairs_have(spark, least):
    rng = random.Random(int(least))
    words = ["SPRING", "FIELD", "NORTH", "A", "B", "SAINT", "CLAIR", "NEW", "YORK", "RIVER", "X", "LAKE", "SUPPLIER"]

    def name():
        t = " ".join(rng.choice(words) + rng.choice(["", "", "S", "VILLE", str(rng.randint(0, 40))]) for _ in range(rng.randint(1, 3)))
        k = rng.randrange(len(t))
        return t if rng.random() < 0.6 else t[:k] + rng.choice(["", "Q", "  "]) + t[k + 1 :]

    def side(column):
        return spark.createDataFrame([*((rng.choice("ST"), name()) for _ in range(150)), ("S", None), ("S", ""), ("S", " "), (None, "NORTH")], f"block string, {column} string").repartition(2)

    left, right = side("l_name"), side("r_name")
    every = left.distinct().join(right.distinct(), "block").withColumn("like", measures.token_set_ratio(F.col("l_name"), F.col("r_name")))
    want = {tuple(r) for r in every.where(F.col("like") >= least).select("block", "l_name", "r_name", "like").collect()}
    assert {tuple(r) for r in candidates.alike_pairs(left, right, least).select("block", "l_name", "r_name", "like").collect()} == want
    if least > 80:
        assert candidates.candidate_pairs(left, right, least).count() * 8 < every.count()


def test_nearest_meets_all_within_reach(spark):
    """Against all pairs, around poles and the date line too."""
    rng = random.Random(8)
    points = [(f"p{k:03d}", "S", rng.choice([rng.uniform(-90, 90), rng.uniform(86, 90), rng.uniform(40, 43)]), rng.choice([rng.uniform(-180, 180), rng.uniform(178, 180), rng.uniform(-180, -178)])) for k in range(250)]
    df = spark.createDataFrame([*points, ("lost", "S", None, 1.0)], "entity_id string, block string, lat double, lon double")
    for most in (30.0, 400.0, 3000.0):
        want = {}
        for i, _, a, b in points:
            km = lambda p: 12742.0 * math.asin(math.sqrt(min(1.0, math.sin(math.radians(p[2] - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(p[2])) * math.sin(math.radians(p[3] - b) / 2) ** 2)))  # noqa: B023, E731
            d, j = min((round(km(p), 9), p[0]) for p in points if p[0] != i)
            if d <= most:
                want[i] = d
        got = {r.entity_id: round(r.km, 9) for r in linkage.nearest(df, df.withColumnRenamed("entity_id", "target_id"), "block", most, others=True).collect()}
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-6) for i in want)


def test_county_links(spark):
    counties = spark.createDataFrame([("c1", "AL", "Autauga County"), ("c2", "AL", "St. Clair County"), ("c3", "LA", "Acadia Parish"), ("c4", "AL", "Twin County"), ("c5", "AL", "Twin")], "target_id string, state string, name string")
    entities = spark.createDataFrame([("a", "AL", "AUTAUGA", "x"), ("b", "AL", "St Clair", "x"), ("c", "AL", None, "Autauga County Sheriff's Office"), ("d", "LA", "Orleans", "x"), ("e", "AL", "Twin", "x")], "entity_id string, state string, county_name string, name string")
    got = {r.entity_id: (r.target_id, r.method, r.score, r.review_status) for r in linkage.county_links(entities, counties).collect()}
    assert got == {
        "a": ("c1", "exact_county_name", 1.0, "accepted"), "b": ("c2", "exact_county_name", 1.0, "accepted"), "c": ("c1", "fuzzy_entity_name", 1.0, "accepted"),
        "d": ("state:LA", "state_fallback", 0.2, "needs_review"), "e": ("c4", "fuzzy_county_name", 1.0, "accepted"),
    }


def test_bundle(spark, tmp_path):
    df = spark.createDataFrame([(f"e{k % 70}", 2000 + k, "x" if k % 2 else "y") for k in range(200)], "entity_id string, data_year int, kind string")
    log = spark.createDataFrame([("c", f"e{k}", 2000, "1") for k in range(30)], "check_id string, entity_id string, data_year int, observed string")
    sinks.export_bundle({"t": df}, log, str(tmp_path / "b"), most=5)
    assert spark.read.parquet(str(tmp_path / "b/t")).count() == 200 and spark.read.parquet(str(tmp_path / "b/data_quality_log")).count() == 5
    assert rows(sinks.dictionary_columns(df), "column_name", "n_distinct", "coded") == [("entity_id", 70, False), ("kind", 2, True)]


def test_islands_and_lags(spark):
    df = spark.createDataFrame([("e", y, v) for y, v in [(2001, 1), (2002, None), (2003, 3), (2004, 30), (2006, 31)]], "e string, y int, v int")
    assert rows(windows.islands(df, "e", "y", "v"), "begin", "end", "points") == [(2001, 2001, 1), (2003, 2006, 3)]
    assert rows(windows.lag_check(df, ["e"], "y", "v", lambda p, v: v >= 10 * p), "y") == [(2004,)]
    assert rows(windows.lag_check(df, ["e"], "y", "v", lambda p, v: v > p, strict=True), "y") == [(2004,)]


def test_ledger_closes(spark):
    r = spark.createDataFrame([("a", 5), ("b", 7), ("b2", 1), ("fed", 9)], "key string, amount int")
    counts = spark.createDataFrame([("a", 1), ("b", 2)], "key string, n int")
    b = reconcile.bucketed(r, counts, F.col("key") == "fed")
    assert rows(b, "key", "bucket") == [("a", "unique_key"), ("b", "ambiguous"), ("b2", "unresolved"), ("fed", "out_of_scope")]
    out = reconcile.closure(b, "amount", ["unique_key"], b.where("bucket = 'unique_key'"), "amount").first()
    assert (out.source, out.loaded, out.excluded, out.residual, out.duplicate_delta) == (22, 5, 17, 0, 0)


def test_ledger_that_publishes_nothing(spark):
    """What nothing was published of is unknown, not 0; the ledger closes all the same."""
    b = spark.createDataFrame([("ambiguous", 7), ("unresolved", 1)], "bucket string, amount long")
    closed = lambda df: tuple(reconcile.closure(df, "amount", ["unique_key"], df.where("bucket = 'unique_key'"), "amount").select("source", "loaded", "excluded", "published", "residual", "duplicate_delta").first())
    assert closed(b) == (8, 0, 8, None, 0, 0)
    assert closed(b.where("false")) == (None, None, None, None, 0, 0)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", 2.0, False), (2, "y", 3.0, True)], "entity_id int, name string, rate double, ok boolean")
    sinks.write_table(df, str(tmp_path / "t"), df.schema)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    sinks.export_csv(df, {"rate": "ok"}, str(tmp_path / "csv"), {"release": "r1"})
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "csv/data")), "entity_id", "rate") == [("1", None), ("2", "3.0")]
    assert {r["table"]: r["rows"] for r in sinks.publish({"t": df, "u": df}, ["t"], str(tmp_path / "pub")).collect()} == {"t": 2, "u": None}
    assert sinks.next_release_id(["release_2026_01_02_004"], "2026-01-02") == "release_2026_01_02_005"
    sinks.replace_slice(df.withColumn("s", F.lit("a")), str(tmp_path / "sl"), ["s"])
    sinks.replace_slice(df.limit(1).withColumn("s", F.lit("b")), str(tmp_path / "sl"), ["s"])
    assert spark.read.parquet(str(tmp_path / "sl")).count() == 3
    assert sinks.fingerprint(spark, str(tmp_path / "t")).where("length(sha256) = 64").count() > 0


def test_landing_skips_what_was_there(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k, name in enumerate("ab"):
        (src / f"{name}.json").write_text('{"ori": "%s", "body": "{}"}' % name)
        land_new_files(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp"), records.RESPONSE).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == k + 1


def test_checks_find_what_is_wrong(spark):
    t = {"crime": spark.createDataFrame([("e", 2020, "v", -1, 5, "reported")], "entity_id string, data_year int, offense_group string, offenses int, clearances int, value_type string")}
    some = [c for c in quality.CHECKS if c.check_id in ("negative_count", "clearances_exceed_offenses", "year_beyond_cutoff")]
    log = quality.run_checks(t, some, release="r")
    assert rows(log, "check_id") == [("clearances_exceed_offenses",), ("negative_count",)]
    assert rows(quality.summary(log, some), "check_id", "findings") == [("clearances_exceed_offenses", 1), ("negative_count", 1), ("year_beyond_cutoff", 0)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_links_broadcast_nothing_that_grows(spark):
    """Files say little of how many rows come out of them, so sides that grow with the input meet by sorting."""
    e = spark.createDataFrame([(f"e{k}", "S", f"NAME {k % 7}", 40.0 + k % 3, 20.0) for k in range(40)], "entity_id string, block string, norm_name string, lat double, lon double")
    t = e.withColumnRenamed("entity_id", "target_id")
    for df in (linkage.nearest(e, t, "block", 30.0), linkage.nearest(e, t, "block", 30.0, others=True), linkage.link(e, t), candidates.candidate_pairs(e.select("block", F.col("norm_name").alias("l_name")), t.select("block", F.col("norm_name").alias("r_name")), 88.0)):
        assert "SortMergeJoin" in _plan(df) and "Broadcast" not in _plan(df)


def test_resolution_broadcasts_states_alone(spark):
    geo = spark.createDataFrame([("state:S", "state", "S", "S", None, None), ("county:1", "county", "S", "Twin County", 40.0, 20.0), ("place:1", "place", "S", "Name city", 40.0, 20.0)], "geo_id string, geo_level string, state string, name string, lat double, lon double")
    e = spark.createDataFrame([("e1", "county_sheriff", "S", "x", "X", "Twin", 40.0, 20.0), ("e2", "municipal_police", "S", "Name", "NAME", None, 40.0, 20.0), ("e3", "municipal_police", None, "Name", "NAME", None, 40.0, 20.0)], "entity_id string, kind string, state string, name string, norm_name string, county_name string, lat double, lon double")
    out = linkage.resolve(e, geo)
    assert _plan(out).count("BroadcastExchange") == 2  # states, and states that have municipalities
    assert rows(out, "entity_id", "target_id", "method") == [("e1", "county:1", "exact_county_name"), ("e2", "place:1", "exact_name"), ("e3", None, "none")]
    county = geo.where("geo_level = 'county'").withColumnRenamed("geo_id", "target_id")
    assert "Broadcast" not in _plan(linkage.county_links(e.where("kind = 'county_sheriff'"), county))


def test_nearest_of_many_rows_in_few_spots(spark):
    """Copies in one spot make no more pairs; ties go to the smallest id, and nobody is nearest to itself."""
    e = spark.createDataFrame([(f"e{k:03d}", "S", 40.0 + k % 4 * 0.1, 20.0) for k in range(80)] + [("far", "S", 10.0, 20.0), ("lost", "S", None, 20.0), ("other", "T", 40.0, 20.0)], "entity_id string, block string, lat double, lon double")
    t = spark.createDataFrame([(f"t{k:03d}", "S", 40.05 + k % 2 * 0.2, 20.0) for k in range(400)], "target_id string, block string, lat double, lon double")
    near = linkage.nearest(e, t, "block", 30.0)
    got = {r.entity_id: (r.target_id, round(r.km, 3)) for r in near.collect()}
    assert got == {f"e{k:03d}": ("t000" if k % 4 < 2 else "t001", 5.56) for k in range(80)}
    assert 0 < max(_metrics(near, "SortMergeJoin")) <= 80  # four points, two spots; 80 rows get their point's answer
    twins = {r.entity_id: (r.target_id, r.km) for r in linkage.nearest(e, e.withColumnRenamed("entity_id", "target_id"), "block", 30.0, others=True).collect()}
    assert twins == {f"e{k:03d}": (f"e{k % 4 if k >= 4 else k + 4:03d}", 0.0) for k in range(80)}


def _metrics(df, node):
    """Rows out of each node of this name, after the query has run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found, stack = [], [plan]
    while stack:
        p = stack.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            stack.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            stack.append(p.plan())
        if p.nodeName() == node:
            found.append(p.metrics().apply("numOutputRows").value())
        children = p.children()
        stack += [children.apply(i) for i in range(children.size())]
    return found
