"""What the plans read: columns that a query does not use stay in the files."""

import pytest

import __spark_entry__ as driver


def read_columns(df):
    """Names of the columns of every file scan of a plan."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.inputPlan()
    leaves = plan.collectLeaves()
    scans = [leaves.apply(i) for i in range(leaves.size())]
    return [set(s.schema().fieldNames()) for s in scans if "Scan" in s.nodeName()]


@pytest.mark.parametrize(
    "name, unread",
    [
        ("status_counts", "raw_response"), ("verdict_summary", "raw_response"), ("capped_rollouts", "raw_response"), ("group_advantage", "raw_response"), ("transition_matrix", "raw_response"),
        ("rollout_metrics", "raw_response"), ("pass_at_k", "raw_response"), ("override_join", "raw_response"), ("id_distribution", "prompt"), ("id_distribution", "tests"), ("source_distribution", "prompt"),
        ("prompt_hints", "tests"), ("testcase_dedup", "prompt"), ("distribution", "tests"), ("source_index_parse", "prompt"), ("split_assign", "prompt"), ("split_assign", "tests"),
    ],
)
def test_unused_columns_are_not_read(spark, small, name, unread):
    scans = read_columns(driver.queries()[name](spark, small))
    assert scans and not any(unread in columns for columns in scans)
