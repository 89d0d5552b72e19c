"""Serving extract, releases, source files, derived geography, invariants."""

import hashlib

import pytest
from pyspark.sql import functions as F

from plumbline.operators import canonical, invariants, reconcile
from plumbline.plans import releases as plans
from plumbline.plans.analog import Analog
from plumbline.sources import releases, serving

from .conftest import SMALL


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_star_over_the_extract_shuffles_nothing(spark):
    x = plans.extract(Analog(spark, SMALL))
    star = x.join(["crime", "staffing", "population"], plans.KEYS)
    plan = star._jdf.queryExecution().executedPlan().toString()
    assert star.count() > 0 and "Exchange" not in plan and plan.count("SortMergeJoin") == 2 and "entity" not in x.names
    folders = {r.table_name: r.rows for r in x.manifest.collect()}
    assert folders["entity"] is None and folders["crime"] == x.read("crime").count()
    x.drop()
    assert not spark.catalog.tableExists(x.names["crime"])


def test_a_missing_table_is_an_error(spark):
    with pytest.raises(ValueError, match="missing tables"):
        serving.publish_buckets({"a": spark.range(3)}, {"a": ["id"], "b": ["id"]}, 2)


def test_extract_of_empty_and_null_keys(spark):
    a = spark.createDataFrame([("x", 1, 1), (None, 1, 2), ("y", None, 3)], "entity_id string, data_year int, v int")
    x = serving.publish_buckets({"a": a, "b": a.withColumnRenamed("v", "w"), "c": a.limit(0).withColumnRenamed("v", "u")}, dict.fromkeys("abc", ("entity_id", "data_year")), 2)
    assert rows(x.join(["a", "b"], ["entity_id", "data_year"]), "entity_id", "data_year", "v", "w") == [("x", 1, 1, 1)]
    assert x.join(["a", "c"], ["entity_id", "data_year"]).count() == 0


LOG = "check_id string, severity string, table_name string, entity_id string, data_year int, observed string, message string"


def test_a_release_is_replaced_whole(spark, tmp_path):
    base, a, b = f"file://{tmp_path}/r", "release_2026_01_01_001", "release_2026_01_01_002"
    log = lambda *ids: spark.createDataFrame([(i, "warning" if i != "bad" else "error", "t", "e", 2000, None, "m") for i in ids], LOG)
    releases.write_release(base, a, {"t": spark.range(3), "u": spark.range(1)}, log("bad", "odd", "odd"), log("ambiguous_key"))
    releases.write_release(base, b, {"t": spark.range(7)}, log("odd"))
    releases.write_release(base, a, {"t": spark.range(4)}, log())
    read = lambda t, *c: rows(releases.read_releases(spark, base, t), *c)
    assert read("manifest", "release_id", "table_name", "rows") == [(a, "t", 4), (b, "t", 7)]
    assert read("data_quality_log", "release_id", "check_id") == [(a, "ambiguous_key"), (b, "odd")]
    assert read("validation", "release_id", "severity", "findings", "checks") == [(a, "error", 0, 0), (a, "info", 0, 0), (a, "warning", 1, 1), (b, "error", 0, 0), (b, "info", 0, 0), (b, "warning", 1, 1)]
    releases.write_release(base, a, {"t": spark.range(4)}, log(), log())
    assert read("data_quality_log", "release_id", "check_id") == [(b, "odd")]
    with pytest.raises(ValueError):
        releases.replace_release(log(), base, "../elsewhere")


def test_fingerprint_changes_with_any_file(spark, tmp_path):
    for name, text in (("one/a", "x"), ("one/deep/b", "y"), ("two/c", "z"), ("stray/d", "q")):
        (tmp_path / "raw" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "raw" / name).write_text(text)
    registry = spark.createDataFrame([("s1", "one"), ("s2", "two"), ("s3", "three")], "source_id string, folder string")
    got = lambda: {r.source_id: (r.artifacts, r.bytes, r.digest) for r in releases.source_fingerprints(spark, f"file://{tmp_path}/raw", registry).collect()}
    before = got()
    assert {k: v[:2] for k, v in before.items()} == {"s1": (2, 2), "s2": (1, 1), "s3": (0, 0), None: (1, 1)} and before["s3"][2] is None
    h = hashlib.sha256(b"z").hexdigest()
    assert before["s2"][2] == hashlib.sha256(hashlib.sha256(h.encode()).hexdigest().encode()).hexdigest()
    (tmp_path / "raw/one/a").rename(tmp_path / "raw/one/renamed")
    assert got() == before
    (tmp_path / "raw/one/deep/b").write_text("Y")
    after = got()
    assert after["s1"][2] != before["s1"][2] and after["s2"] == before["s2"]


def test_geography_levels(spark):
    geo = lambda *r: spark.createDataFrame(list(r), "geoid string, name string, state string")
    states = spark.createDataFrame([("01", "AL"), ("51", "VA")], "code string, state string")
    classes = spark.createDataFrame([("5101000", "C7"), ("103076", "C8"), ("0100001", "C1")], "geoid string, class_code string")
    parts = spark.createDataFrame([("0103076", "9", "Small", 1.0), ("0103076", "8", "Big", 5.0), ("0100001", " ", "none", 9.0), ("5101000", "7", "Tie B", 2.0), ("5101000", "6", "Tie A", 2.0)], "geoid string, uace string, urban_area string, land double")
    areas = spark.createDataFrame([("00008", 60_000), ("6", 4_000)], "uace string, population long")
    out = canonical.geography_levels(geo(("1001", "Autauga", "AL"), ("09001", "Old", "CT"), ("", "x", "x"), (None, "x", "x")), geo(("103076", "Auburn", "AL"), ("5101000", "Alexandria", "VA"), ("100001", "Rural", "AL")), geo(("100190171", "Sub", "AL")), states, classes, parts, areas, ["county:09001"])
    got = {r.geo_id: (r.state_fips, r.county_fips, r.place_fips, r.cousub_fips, r.uace, r.urban_area, r.urbanicity, r.is_independent_city, r.is_consolidated) for r in out.collect()}
    assert got == {
        "county:01001": ("01", "001", None, None, None, None, None, False, False), "cousub:0100190171": ("01", "001", None, "90171", None, None, None, False, False), "state:01": ("01", None, None, None, None, None, None, False, False), "state:51": ("51", None, None, None, None, None, None, False, False),
        "place:0103076": ("01", None, "03076", None, "00008", "Big", "Urban", False, True), "place:5101000": ("51", None, "01000", None, "00006", "Tie A", "Rural", True, False), "place:0100001": ("01", None, "00001", None, None, None, "Rural", False, False),
    }


def test_invariants_of_sound_and_empty_tables(spark):
    sound = {
        "crime": spark.createDataFrame([("s",)], "source string"), "staffing": spark.createDataFrame([("s", 2000, 3)], "source string, data_year int, sworn int"), "dim_source": spark.createDataFrame([("s",), ("s",), (None,)], "source string"),
        "agency_year": spark.createDataFrame([(1.0, 12, "accepted"), (None, 3, "x")], "violent_rate double, violent_months_reported int, review_status string"),
        "finance": spark.createDataFrame([("government_unit",)], "attribution_level string"), "entity": spark.createDataFrame([("ABCDEFG00", "ABCDEFG"), (None, "x")], "legacy_key string, key string"),
    }
    for tables in (sound, {k: v.limit(0) for k, v in sound.items()}):
        got = invariants.check_invariants(tables).collect()
        assert len(got) == len(invariants.INVARIANTS) and all(r.violations == 0 for r in got)
    worse = {**sound, "entity": spark.createDataFrame([("ABCDEFG00", None), ("ABCDEFG00", "ABCDEFX")], "legacy_key string, key string"), "crime": spark.createDataFrame([("s",), ("t",), (None,)], "source string")}
    assert {(r.invariant, r.table_name): r.violations for r in invariants.check_invariants(worse).collect() if r.violations} == {("key_is_the_legacy_keys_beginning", "entity"): 2, ("source_is_named", "crime"): 1, ("source_is_known", "crime"): 1}


def test_headline_without_a_ledger(spark):
    buckets = spark.createDataFrame([("unique_key", 3, 10), ("ambiguous", 1, 4)], "bucket string, records long, total long")
    names = {"ambiguous": "ambiguous", "unresolved": "unresolved"}
    (r,) = reconcile.headline(buckets, F.lit(10), F.lit(14), names).collect()
    assert tuple(r) == (True, 14, 10, 4, 0, 1, 0)
    (r,) = reconcile.headline(buckets, F.lit(10), F.lit(None).cast("long"), names).collect()
    assert r.residual is None and r.platform_total == 10
    (r,) = reconcile.headline(buckets.limit(0), F.lit(10), F.lit(14), names).collect()
    assert tuple(r) == (False, None, None, None, None, None, None)
