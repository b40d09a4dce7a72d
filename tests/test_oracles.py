"""Every registered query against its SQL on the small tables."""

import pytest
from check import compare, connect

from dossier.workload import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees(name, spark, sf, con):
    assert compare(QUERIES[name](spark, sf), con, ORACLES[name]) is None


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["profile_id", "name", "resume_type"]
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
