"""Every registered query against its SQL on the smallest tables."""

import check
import pytest

from metaloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_matches_sql(spark, con, name):
    message, ok = check.compare(spark, con, SF, catalog.QUERIES[name], catalog.ORACLE.get(name))
    assert ok, message


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
