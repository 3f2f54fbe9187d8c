"""Every registered query against its oracle on the smallest test tables."""

import pathlib

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from codequarry.plans.catalog import QUERIES
from tests.check_oracles import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="test tables are absent")


@pytest.fixture(scope="module")
def oracle():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_oracle(spark, oracle, name):
    assert compare(queries()[name](spark, SF), oracle, oracle_sql()[name]) == ""
    spark.catalog.clearCache()


def test_entry(spark):
    assert entry(spark).count() > 0
