"""Every registered query against DuckDB on the same tables, row by row."""

import os

import pytest

import __spark_entry__ as registered
import check_oracle

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("test tables are not here")
    return check_oracle.connect(SF)


def test_each_query_has_a_statement():
    assert set(registered.audit_queries()) <= set(registered.oracle_sql())


@pytest.mark.parametrize("name", list(registered.audit_queries()))
def test_same_rows_as_duckdb(spark, con, name):
    assert check_oracle.differences(spark, con, SF, name) is None


def test_flagship(spark):
    rows = registered.entry(spark).collect()
    assert rows and [r["n"] for r in rows] == sorted((r["n"] for r in rows), reverse=True)
