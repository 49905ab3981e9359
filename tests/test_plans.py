"""Physical plans: one shuffle where one is enough, early limits, pruned scans."""

import re

from duecast.operators.history import add_training_history
from duecast.plans.catalog import all_queries
from duecast.sources import lenses


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_training_history_shuffles_once(spark, small):
    plan = _plan(add_training_history(lenses.invoices(spark, small)))
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "Join" not in plan and "SinglePartition" not in plan
    assert len(re.findall(r"\bSort \[", plan)) == 1


def test_last_orders_are_cut_before_the_shuffle(spark, small):
    plan = _plan(lenses.credit(spark, small))
    assert plan.count("WindowGroupLimit") == 2


def test_scans_are_pruned_and_filtered(spark, small):
    plan = _plan(all_queries()["filter_tiers"](spark, small))
    assert "o_totalprice" not in re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    demand = _plan(all_queries()["demand_short_features"](spark, small))
    line = next(l for l in demand.splitlines() if "l_quantity" in l and "FileScan" in l)
    assert "l_tax" not in line and "l_extendedprice" not in line


def test_no_pairwise_joins(spark, small):
    names = [
        "history_training_features", "history_serving_features", "history_simple", "filter_demand_problems", "quality_row_diagnostics",
        "quality_demand_series", "combine_overlap", "join_company_profiles", "join_assessments", "demand_long_features", "forecast_flags",
        "forecast_projection", "score_drivers", "models_active", "measure_classification",
    ]
    for name in names:
        plan = _plan(all_queries()[name](spark, small))
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name
