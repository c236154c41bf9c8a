"""What the planner has to do for the queries: filters and columns reach the scan, no cross products, no one-task windows over rows."""

import re

import pytest

from textloom import plans

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("name", "pushed"), [("scan_source_filter", "EqualTo(source,src3)"), ("scan_source_prefix", "StringStartsWith(source,src1)")])
def test_filters_reach_the_scan(spark, name, pushed):
    text = plan(spark, name)
    assert pushed in text
    assert re.search(r"ReadSchema: struct<doc_id:bigint,source:string,n_chars:bigint>", text)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - {"src_list_shards"}))
def test_no_products_of_tables(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text
    for join in re.findall(r"BroadcastNestedLoopJoin[^\n]*", text):
        assert "Inner" in join or "Cross" in join  # one row with totals


@pytest.mark.parametrize("name", ["pack_linear", "shard_assign", "mix_weighted", "batch_collate"])
def test_running_sums_use_many_tasks(spark, name):
    text = plan(spark, name)
    windows = re.findall(r"Window \[[^\n]*", text)
    assert windows and any("__part" in w for w in windows)
