"""Every registered query against its SQL check, over whole tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(SQL))
def test_query(spark, duck, name):
    assert compare(entry.queries()[name](spark, SF_DIR), duck, SQL[name]) is None


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
