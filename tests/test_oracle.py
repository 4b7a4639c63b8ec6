"""Every registered query against its oracle at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from harness.check import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = sorted(entry.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_oracle_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    ok, note = compare(spark, con, name, SF)
    assert ok, note
