"""Every query that SQL can state, against that SQL on whole tables; the others by shape."""

import pytest

from checking import connect, difference
from plumbline.plans import catalog
from plumbline.plans.checks import CHECKS
from plumbline.plans.oracles import ORACLES

QUERIES = {**catalog.QUERIES, **CHECKS}
NO_SQL = sorted(set(QUERIES) - set(ORACLES))


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), duck.sql(ORACLES[name])) is None


def test_every_check_is_stated():
    assert set(CHECKS) <= set(ORACLES)


@pytest.mark.parametrize("name", NO_SQL)
def test_query_returns_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
