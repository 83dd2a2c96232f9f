"""Shapes of plans that hold at scale."""

import pytest
from codeloom.plans import catalogue

DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["adjacency", "rank_symbols", "vector_topk", "example_rank"])
def test_top_k_is_cut_before_the_shuffle(spark, name):
    p = plan(catalogue.queries()[name](spark, DIR))
    # One constant repository turns the cut into a heap per task.
    assert "WindowGroupLimit" in p or "TakeOrderedAndProject" in p


@pytest.mark.parametrize("name", ["resolve_calls", "file_cycles", "verify_claims", "known_names",
                                  "ungrounded_words", "alternatives_verdict", "manifest_merge"])
def test_no_cross_joins(spark, name):
    p = plan(catalogue.queries()[name](spark, DIR))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_scans_read_only_their_columns(spark):
    p = plan(catalogue.queries()["file_cycles"](spark, DIR))
    assert "l_extendedprice" not in p and "o_totalprice" not in p
