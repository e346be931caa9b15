"""Every network query against its SQL."""

import pytest
from oracle import SF, same

from arbora import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql(spark, name):
    same(catalog.QUERIES[name](spark, SF), catalog.SQL[name], SF)


def test_search_finds_the_injected_skeleton(spark):
    found = {frozenset((r.u, r.v)) for r in catalog.QUERIES["hill_climb_edges"](spark, "/root/testdata/sf0.01").collect()}
    assert {frozenset((0, 2)), frozenset((1, 2)), frozenset((2, 4)), frozenset((3, 4))} <= found


def test_sid_of_equal_networks_is_zero(spark):
    from arbora.plans.evaluation import sid

    truth = [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4)]
    assert sid(spark, 5, truth, truth).groupBy().sum("errors").first()[0] == 0
    assert sid(spark, 5, truth, []).groupBy().sum("errors").first()[0] > 0
