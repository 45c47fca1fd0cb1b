"""Every query that has SQL gives what the SQL gives; the others run."""

import os

import pytest
from compare import connect, same

from marlstone.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    sql = catalogue.oracle_sql().get(name)
    if sql:
        same(df, con, sql)
    else:
        assert df.count() >= 0 and len(df.columns)


def test_names_are_paired():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
