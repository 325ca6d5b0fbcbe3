import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
CHEAP = ("root_stats", "octree_child_hist", "octree_path4_hist", "grid_cell_key", "cell_conflicts", "node_box", "points_in_tile", "merge_fill_zero", "obb_transform", "quadric_sum", "p1_found", "p3_found", "p4_found", "p5_found", "p5_regions")


def plan(spark, name):
    return entry.queries()[name](spark, D)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHEAP)
def test_no_joins_of_everything_with_everything(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_read_what_they_need(spark):
    text = plan(spark, "octree_child_hist")
    assert "l_shipdate" not in text and "l_orderkey" not in text and text.count("Exchange") <= 2
    text = plan(spark, "points_in_tile")
    assert "GreaterThanOrEqual(l_quantity,10.0)" in text and "l_extendedprice" not in text
    text = plan(spark, "p3_found")
    assert "IsNotNull(line)" in text and "delivered_at" not in text


def test_counts_are_reduced_before_the_shuffle(spark):
    text = plan(spark, "grid_cell_key")
    assert "partial_count" in text


def test_top_per_tile_is_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(spark, "spatial_bucket20")
