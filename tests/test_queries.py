"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.check import connect, difference

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def sql():
    return connect(SF_DIR)


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, sql, name):
    result = queries()[name](spark, SF_DIR).toArrow()
    assert result.num_rows > 0
    if name in oracle_sql():
        assert difference(result, sql.sql(oracle_sql()[name]).to_arrow_table()) is None
