"""Every query of the reference's operators against its SQL twin, on the smallest tables."""

import oracle
import pytest

import __spark_entry__ as entry
from callharmony.plans.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, con, name):
    assert oracle.difference(entry.queries()[name](spark, SF_DIR), con, entry.oracle_sql()[name]) == ""


def test_a_session_without_filter_pushdown(spark, con, conf):
    conf(spark__sql__python__filterPushdown__enabled="false")
    name = "paged_rows_filtered"
    assert oracle.difference(entry.queries()[name](spark, SF_DIR), con, entry.oracle_sql()[name]) == ""


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()


def test_entry(spark):
    df = entry.entry(spark)
    assert len(df.columns) == 14 and df.count() > 0


@pytest.mark.parametrize("name", ["FEATURES", "DATASTORE", "ROW_ARRAY"])
def test_services_are_read_in_several_tasks(spark, name):
    from callharmony.plans import queries

    bodies = queries.paged_events(spark, "/root/testdata/sf0.01", getattr(queries, name), "[]")
    assert bodies.rdd.getNumPartitions() > 1
