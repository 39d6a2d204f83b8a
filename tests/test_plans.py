"""Plan properties that matter at scale, checked on the registered queries (sf0.001 inputs)."""

import contextlib
import io

import pytest

from tidemark.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
SKIP = {"baseline"}  # fits models; its metrics reuse classification_metrics


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SKIP))
def test_no_cartesian_or_nested_loop_join(spark, name):
    plan = _plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_outlier_scan_pushes_bounds_to_parquet(spark):
    df = QUERIES["numeric_outliers"](spark, SF)
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    assert "PushedFilters: [Or(" in out.getvalue()


def test_top_k_per_column_is_limited_before_the_shuffle(spark):
    for name, limited in (("category_frequencies", "WindowGroupLimit"), ("date_failures", "WindowGroupLimit"), ("type_profile", "TakeOrderedAndProject")):
        plan = _plan(QUERIES[name](spark, SF))
        assert limited in plan, name


def test_python_only_on_distinct_values(spark):
    # The fold UDF sits above an aggregate of (column, value), never directly on the scan.
    plan = QUERIES["text_problems"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    idx = next(i for i, ln in enumerate(lines) if "ArrowEvalPython" in ln or "BatchEvalPython" in ln)
    below = "\n".join(lines[idx + 1 :])
    assert "Aggregate" in below
