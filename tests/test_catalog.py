"""Every registered query against its SQL on the smallest tables, and its plan."""

import os

import pytest

from catalog import ORACLES, QUERIES
from verify import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    assert name in ORACLES
    assert compare(spark, con, FOLDER, name).startswith("ok")


@pytest.mark.parametrize("name", ["q_matched_negatives", "q_zero_shot_scores", "q_split_integrity", "q_exact_quantiles",
                                  "q_cooccurrence", "q_value_proportions", "q_eval_report"])
def test_plans_pair_no_rows_by_force(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
