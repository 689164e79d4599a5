"""Every query of the versioned-dataset engine against its SQL, on the smallest tables."""

import pytest

from chronolith.plans import catalog, exchange, forks, history, objects, states
from chronolith.streaming import follow, radar

from .oracle import connect, same

SF = "/root/testdata/sf0.001"
ALL = {**history.QUERIES, **states.QUERIES, **forks.QUERIES, **objects.QUERIES, **exchange.QUERIES, **catalog.QUERIES, **radar.QUERIES, **follow.QUERIES}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n, (_, sql) in ALL.items() if sql])
def test_query_matches_sql(spark, con, name):
    query, sql = ALL[name]
    same(query(spark, SF), con, sql)


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(ALL) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
