"""Every registered query against its SQL on the smallest tables, or at least run."""

import pytest

from tessera.queries import ORACLE_SQL, QUERIES
from tests.compare import compare, connection

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLE_SQL:
        compare(spark, SMALL, QUERIES[name], ORACLE_SQL[name], con)
    else:
        assert QUERIES[name](spark, SMALL).columns
        QUERIES[name](spark, SMALL).collect()
