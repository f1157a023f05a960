"""Every registered query with an oracle equals it on the smallest tables."""

import os

import pytest

from tests.oracle import connection, differences
from wallscan.plans import registry
from wallscan.plans.fixtures import Fixtures

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
registry.load()


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.fixture(scope="module")
def fixtures(spark):
    """The inputs, derived once for all queries."""
    return Fixtures(spark, SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(fixtures, con, name):
    df = registry.BUILDS[name](fixtures)
    if name in registry.ORACLES:
        assert not differences(df, con, registry.ORACLES[name])
    else:
        assert df.count() > 0


def test_query_by_name(spark, con):
    """As the entry calls it, with inputs of its own."""
    assert not differences(registry.QUERIES["a10_group_centroids"](spark, SF), con, registry.ORACLES["a10_group_centroids"])
