"""Queries of the subpackage that have SQL give what it gives."""

import os

import pytest
from compare import connect, same

from marlstone.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    same(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLE_SQL[name])
