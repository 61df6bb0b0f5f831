"""The registered queries: SQL where there is some, shape and completeness for the rest."""

import check
import pytest

import __spark_entry__ as entry
from metaloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query_matches_sql(spark, con, name):
    message, ok = check.compare(spark, con, SF, queries.QUERIES[name], queries.ORACLE[name])
    assert ok, message


def test_all_are_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 14)} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
