"""The queries that SQL can express, against it, on the smallest tables."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import compare
import pytest

from tidemark.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    assert compare.compare(queries.QUERIES[name](spark, SF), compare.connect(SF), queries.ORACLES[name]) == ""
