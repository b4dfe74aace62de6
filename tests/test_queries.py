"""Every registered query on the smallest tables, against its SQL where it has one."""

import pytest
from check_oracle import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    assert compare(spark, con, SF, entry.queries()[name], entry.oracle_sql().get(name)) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0
