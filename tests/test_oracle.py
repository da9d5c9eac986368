import pytest

from netspark import catalog, queries
from tests.oracle import differs, duck

SF = "/root/testdata/sf0.01"


QUERIES, ORACLE_SQL = queries.QUERIES | catalog.QUERIES, queries.ORACLE_SQL | catalog.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert differs(spark, duck(SF), name, QUERIES[name], ORACLE_SQL[name], SF) is None
