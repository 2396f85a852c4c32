"""Each query against its SQL, on the smallest tables."""

import os

import compare  # noqa: I001
import pytest

from tidemark.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, duck, name):
    assert compare.compare(registry.QUERIES[name](spark, SF), duck, registry.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry_has_oracles_of_known_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
