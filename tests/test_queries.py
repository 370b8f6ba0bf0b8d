"""Every registered query against its SQL, or at least with a stable schema."""

import pytest

from lodestone.plans import registry
from tests.oracle import connect, same

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert same(QUERIES[name](spark, SF), duck.sql(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    rows = QUERIES[name](spark, SF)
    assert rows.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert registry.FLAGSHIP in QUERIES
