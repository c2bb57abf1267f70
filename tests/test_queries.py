import functools

import pytest

from tests.compare import connect, same
from textlineage import queries
from textlineage.oracles import ORACLES
from textlineage.queries import QUERIES

SF = "/root/testdata/sf0.001"
#: Run as they are; the others share one lineage, whose stages are kept.
WHOLE = ["q_quality", "q_pair_hits_bounded"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def shared():
    build = queries.lineage
    plans = []

    @functools.cache
    def once(spark, d):
        plans.append(build(spark, d))
        queries._plans.clear()  # not released with the first result
        return plans[-1]

    queries.lineage = once
    yield
    queries.lineage = build
    queries.release(plans)


@pytest.mark.parametrize("name", WHOLE)
def test_query_alone_equals_its_sql(spark, con, name):
    assert same(QUERIES[name](spark, SF), con, ORACLES[name]) == ""
    spark.catalog.clearCache()


def test_what_a_query_keeps_goes_with_its_result(spark):
    kept = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    spark.catalog.clearCache()
    found = QUERIES["q_vocab"](spark, SF)
    found.collect()
    assert kept() > 0
    del found
    assert kept() == 0


@pytest.mark.parametrize("name", sorted(set(ORACLES) - set(WHOLE)))
def test_query_equals_its_sql(spark, con, shared, name):
    assert same(QUERIES[name](spark, SF), con, ORACLES[name]) == ""


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLES)
