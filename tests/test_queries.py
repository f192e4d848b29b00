"""Every reference query against DuckDB on the sf0.01 tables."""

import pytest

from hashloom.plans.catalog import ORACLES, QUERIES
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, name):
    ansi = spark.conf.get("spark.sql.ansi.enabled")
    compare(spark, QUERIES[name], ORACLES[name])
    assert spark.conf.get("spark.sql.ansi.enabled") == ansi


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
