"""Every registered query that has SQL agrees with it on the small tables."""

import pytest

import __spark_entry__ as entry
from tools.check_queries import compare, duck

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_names():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    message, _ = compare(spark, con, name, SF_DIR, QUERIES, ORACLES)
    assert message.startswith("ok"), message


def test_entry(spark):
    assert entry.entry(spark).count() > 0
