import pytest
from oracle import connect, differences

from sparkloom.llm.queries import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert not differences(spark, connect(D), D, QUERIES[name], ORACLE_SQL[name])
