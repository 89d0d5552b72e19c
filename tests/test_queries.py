"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from plumbline.plans import registry

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str(v)


#: Queries that the smallest tables have no rows for.
EMPTY = {"a1_cohort_benchmarks", "j13_nearest", "l1_page", "v_missing_source", "v_rate_across_years", "v_rate_on_ineligible_kind", "v_rate_on_unaccepted_link", "v_year_out_of_range"}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got or name in EMPTY  # nothing equals nothing
    if name not in registry.ORACLE_SQL:
        return
    found = db.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


def test_no_rate_without_its_rules(spark):
    from plumbline.plans.analog import Analog

    ay = Analog(spark, SMALL).agency_year
    assert ay.where("violent_rate is not null and (violent_months_reported < 12 or denominator is null or review_status <> 'accepted' or confidence = 'NOT_COMPARABLE')").isEmpty()
    assert ay.where("violent_offenses is not null and violent_rate is null and violent_withheld is null").isEmpty()
    assert not ay.where("violent_withheld is not null").isEmpty()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
