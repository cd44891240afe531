"""Every registered query against its SQL in DuckDB."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from tests.oracle_compare import connect, differences

SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, con, name):
    assert differences(contract.queries()[name](spark, sf_dir), con, SQL[name]) == []
