"""Every registered query against its SQL, and the plans of those that matter most at scale."""

import pytest

import __spark_entry__ as contract
from batchloom.queries import ORACLES, QUERIES
from check_oracles import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).columns == ["batch_id", "estimated_input_tokens", "wave", "lane_id"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_item_totals_read_two_columns_and_combine_early(spark, sf):
    plan = plan_of(QUERIES["job_totals"](spark, sf))
    assert "ReadSchema: struct<source:string,n_chars:bigint>" in plan
    assert "partial_sum" in plan and plan.count("Exchange") == 1


def test_lane_plans_meet_lanes_by_equal_keys(spark, sf):
    for name in ("waves", "waves_big_lanes", "waves_mixed_caps", "eligible_big_lanes"):
        plan = plan_of(QUERIES[name](spark, sf))
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        assert "collect_list" not in plan


def test_oversize_items_are_found_without_their_texts(spark, sf):
    from batchloom.operators.items import split_oversize
    from batchloom.queries import views

    items = views.items(spark, sf).select("job_id", "work_item_id", "estimated_input_tokens")
    plan = plan_of(split_oversize(items, 2_000)[1])
    assert "ReadSchema: struct<doc_id:bigint,source:string,n_chars:bigint>" in plan


def test_recent_events_keep_a_few_rows_per_task(spark, sf):
    assert "TakeOrderedAndProject" in plan_of(QUERIES["recent_events"](spark, sf))


@pytest.mark.parametrize("name", ["pack_global", "day_quota", "waves_mixed_caps", "attempt_history"])
def test_no_window_sorts_a_group_in_one_task(spark, sf, name):
    plan = plan_of(QUERIES[name](spark, sf))
    assert "Window" not in plan and "CartesianProduct" not in plan
