"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

import oracle
from ledgerspark.registry import ORACLE, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def link():
    return oracle.connect(SF_DIR)


def test_every_check_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, link, name):
    assert oracle.differences(spark, SF_DIR, name, link) is None
