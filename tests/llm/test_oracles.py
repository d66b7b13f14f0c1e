import pytest
from kbforge.llm import registry

from tests.oracle import same


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_rows_equal_the_oracle(spark, name):
    same(spark, registry.queries()[name], registry.oracle_sql()[name])
