"""The queries that SQL can express, against DuckDB; the others run whole."""

import pytest

from hashloom.llm.queries import oracle_sql, queries
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracle(spark, name):
    compare(spark, queries()[name], oracle_sql()[name], "/root/testdata/sf0.001")


def test_every_operator_has_a_query():
    assert {q.split("_")[0] for q in queries()} == {f"op{i}" for i in range(1, 11)}
