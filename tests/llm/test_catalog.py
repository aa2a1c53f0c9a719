"""Registered queries against their SQL, and the entry points."""

import os

import pytest

import __spark_entry__ as entry
from cohortlab.llm.catalog import ORACLES, QUERIES
from verify import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, name).startswith("ok")


def test_all_operators_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
    assert set(QUERIES) <= set(names)
