"""The queries against their SQL."""

import pytest
from oracle import SF, same

from arbora.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    same(queries.QUERIES[name](spark, SF), queries.SQL[name], SF)
