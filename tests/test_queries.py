"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from comparing import compare, connect
from gleanery.plans import all_checks, all_queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CHECKS = all_checks()
ROWS_ONLY = sorted(set(all_queries()) - set(CHECKS))


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_equals_sql(spark, con, name):
    problem = compare(all_queries()[name](spark, SF_DIR), con, CHECKS[name])
    assert problem in (None, "EMPTY"), problem


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_has_rows(spark, name):
    assert all_queries()[name](spark, SF_DIR).limit(1).count() == 1
