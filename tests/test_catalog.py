import pytest

from quillstack.plans import catalog

from .support import SMALL, assert_same, views


@pytest.fixture(scope="module")
def con():
    return views(SMALL)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, con, name):
    assert_same(catalog.QUERIES[name](spark, SMALL), con, catalog.SQL[name])
