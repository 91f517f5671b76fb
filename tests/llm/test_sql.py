"""Queries with SQL against it, on the smallest tables."""

import pytest

from tessera.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import compare, connection

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    compare(spark, SMALL, QUERIES[name], ORACLE_SQL[name], connection(SMALL))


def test_names():
    assert sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0])) == [n for k in range(1, 11) for n in QUERIES if n.startswith(f"op{k}_")]
