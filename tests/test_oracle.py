"""Every query with an oracle: Spark result == DuckDB result at sf0.001 (row count,
column names, coarse types, order-insensitive values)."""
import pytest

from seqscore.plans import all_queries
from seqscore.plans.check import compare, duck_connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = all_queries()


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], ORACLE[name], SF)
    assert r["status"] == "ok", r
