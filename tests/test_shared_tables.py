"""Queries that ask the same tables many times read the line items once for each table."""

from plumbline.plans import faulty, registry
from plumbline.plans.analog import Analog

from .conftest import SMALL


def scans(df):
    """How often the plan reads the line items."""
    return df._jdf.queryExecution().executedPlan().toString().count("lineitem.parquet")


def test_checks_share_their_tables(spark):
    """Of all checks, the finances alone (amounts, years) still read line items; the rest reads what was counted once."""
    log = faulty.log(Analog(spark, SMALL))
    assert scans(log) <= 2
    assert log.groupBy("check_id").count().count() > 10


def test_capped_log_runs_the_checks_once(spark):
    assert scans(registry.QUERIES["v0_capped_log"](spark, SMALL)) == 0


def test_legends_share_the_year(spark):
    assert scans(registry.QUERIES["q10_legends"](spark, SMALL)) == 0
