import pytest
from kbforge import plans

from tests.oracle import SF, same

QUERIES, ORACLES = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_the_oracle(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_the_rest_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
