import pytest

from ridgeline import registry

from . import oracle


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_equal(spark, con, name):
    oracle.same(spark, con, registry.QUERIES[name], registry.ORACLES[name])
