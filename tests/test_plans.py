"""Plan shape: every lazily built query scans the fact table at most once and
contains no cartesian product, nested-loop join or row-at-a-time Python UDF."""

import pytest

from revcast import plans
from revcast.plans.report import EAGER_PREFIXES, plan_stats

from .conftest import SF_SMALL

# queries whose input is two "sources" carved from the same table (U1, P1), or that check estimates against exact counts
MULTI_SOURCE = {"u1_union_by_name", "p1_harmonise_spellings", "a13_sketch_rollups"}

LAZY = [n for n in sorted(plans.QUERIES) if not n.startswith(EAGER_PREFIXES)]


@pytest.mark.parametrize("name", LAZY)
def test_plan_shape(spark, name):
    df = plans.QUERIES[name](spark, SF_SMALL)
    s = plan_stats(df)
    assert not s["flags"], s
    if name not in MULTI_SOURCE:
        if s["lineitem"] > 1:  # branches over one exchange: what counts is the plan that runs
            s = plan_stats(df, executed=True)
        assert s["lineitem"] <= 1, s


def test_flagship_shuffles_once_after_rollup(spark):
    df = plans.QUERIES["w5_training_matrix"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # everything after the roll-up (gap fill, windows, trim) shares one
    # hash partitioning on series_id
    assert plan.count("hashpartitioning(series_id") == 1, plan


def test_rollup_expands_no_rows_and_never_broadcasts_the_lines(spark):
    big = "/root/testdata/sf0.1"
    for name in ("a2_daily_grouping_sets", "w5_training_matrix", "j1_gap_fill_null"):
        plan = plans.QUERIES[name](spark, big)._jdf.queryExecution().executedPlan().toString()
        assert "Expand" not in plan, plan
        # what is broadcast here are the dimensions: the join with the lines is a merge of both sides
        assert "SortMergeJoin [l_orderkey" in plan, plan
        for block in plan.split("BroadcastExchange")[1:]:
            assert "l_orderkey" not in block.split("SortMergeJoin")[0].split("Exchange hashpartitioning")[0], block
