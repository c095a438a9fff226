"""Every registered query at the smallest size: against SQL where there is SQL."""

import os

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
RUNS, SQL = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are not here")


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(RUNS)


@pytest.mark.parametrize("name", sorted(RUNS))
def test_query(spark, connection, name):
    ok, message = compare(spark, connection, FOLDER, name, RUNS[name], SQL.get(name))
    assert ok, message
