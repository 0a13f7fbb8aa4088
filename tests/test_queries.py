"""Every registered query against its statement, on the small tables (NEWSWEAVE_SF picks others)."""

import os

import pytest
from check_queries import compare, duck

from __spark_entry__ import entry, oracle_sql, queries
from newsweave.plans import COVERS, ORACLES, QUERIES

SF = os.environ.get("NEWSWEAVE_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    statement = ORACLES.get(name)
    if statement is None:
        assert df.columns and df.count() > 0
    else:
        difference = compare(df, con, statement)
        assert difference in (None, "EMPTY"), difference


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    assert set(ORACLES) <= set(QUERIES) == set(COVERS)
