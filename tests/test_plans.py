"""Plans stay inside Spark's own expressions and avoid joins that do not scale."""

import pytest

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
PYTHON_ALLOWED = ("provider_batches", "provider_answers")
CHECKED = [
    "route_documents", "column_profile", "column_roles", "row_batches", "answer_scores",
    "rule_answers", "y_bands", "text_blocks", "block_records", "admission", "duplicate_files",
    "session_documents", "documents_for_jobs", "review_pages", "review_grid", "row_records",
]


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHECKED)
def test_no_python_and_no_cross_join(spark, name):
    plan = plan_of(contract.queries()[name](spark, FOLDER))
    assert "Python" not in plan and "InPandas" not in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(contract.queries()["jobs_of_document"](spark, FOLDER))
    assert "EqualTo(o_custkey,22)" in plan
    assert "o_orderpriority" not in plan
