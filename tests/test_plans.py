"""Physical-plan properties that matter at scale: pruning, bounded broadcasts, no nested loops,
no full sort for fixed-size samples, per-task partial counts."""

import pytest

import __spark_entry__ as E
from bytelake.operators import split
from bytelake.plans import splits as ps

from .conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_histogram_reads_only_text(spark):
    plan = _plan(E.queries()["byte_histogram"](spark, SF_SMALL))
    scans = [l for l in plan.split("\n") if "FileScan parquet" in l]
    assert scans and all("ReadSchema: struct<text:string>" in l for l in scans)
    assert "PythonMapInArrow" in plan or "MapInArrow" in plan


@pytest.mark.parametrize("key", ["reward_dataset", "top_p_business", "cross_entropy_masked", "stream_blocks_packed", "split_three_way", "metrics_history"])
def test_no_nested_loop_or_cartesian(spark, key):
    plan = _plan(E.queries()[key](spark, SF_SMALL))
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_fixed_n_sample_filters_before_sorting(spark):
    p = ps.pairs(spark, SF_SMALL)
    plan = _plan(split.sample_fixed_n(p, "pair_id", 5, 42))
    # a top-n over rows that passed the threshold on the draw, and no range shuffle of the table
    top = plan.find("TakeOrderedAndProject")
    assert top >= 0 and "rangepartitioning" not in plan
    below = plan[top:]
    assert any("Filter" in line and "< " in line and "subquery" in line.lower() for line in below.split("\n")), below


def test_filter_pushdown_on_scan(spark):
    plan = _plan(E.queries()["placeholder_if_empty"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(n_chars), GreaterThan(n_chars,1000000000)" in plan
