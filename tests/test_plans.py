"""Plans: nothing runs in Python but the ordered walk of `pack` and the calls of a model, and nothing is joined without a key."""

import re

import pytest

from threadloom import registry

SF = "/root/testdata/sf0.001"
#: The ordered walk, and the calls of a model.
PYTHON = {"pack", "llm_run", "vis_describe"}
#: One row beside at most three: what stands in when a month has no day.
BESIDE_ONE_ROW = {"agg_taper", "vw_history"}  # the second is the view of the first


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_plan(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert name in PYTHON or not re.search(r"Python|Pandas|ArrowEval", plan)
    assert name in BESIDE_ONE_ROW or not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_scans_read_what_is_asked(spark):
    plan = registry.queries()["flt_service"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(event_type" in plan and "ReadSchema: struct<event_id:bigint,event_type:string>" in plan
    plan = registry.queries()["agg_expiry"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"EqualTo\(o_orderstatus,O\)", plan)
