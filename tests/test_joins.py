"""Sides of joins that grow with the products go to the tasks by key, never whole through the driver; short rows that are long to compute are spread over the cores."""

import __spark_entry__ as entry
import pytest

from tests.conftest import SF

#: Queries and how many of their sides are small by nature (a plan of categories or slots).
JOINED = {
    "A02_category_gaps": 1,
    "G11_weak_batches": 0,
    "A13_golden_findings": 0,
    "A14_policy_drops": 0,
    "A03_supplement_targets": 0,
    "A03_gap_totals": 1,
    "A03_slot_gaps": 1,
    "A13_golden_diff": 0,
    "A17_run_overlap": 0,
    "D05_selection_summary": 0,
    "D04_select_rows": 0,
    "R05_survivors": 0,
}


@pytest.mark.parametrize("name", JOINED)
def test_sent_whole(spark, name):
    """The tables are small here, so Spark would send any side that may be sent."""
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    lines = [x for x in plan.splitlines() if "BroadcastExchange" in x]
    assert "BroadcastHashJoin" not in plan
    assert len(lines) == JOINED[name] and "BuildLeft" not in plan


@pytest.mark.parametrize("name", ["G04_slot_plan", "G06_phrase_bank", "E04_pack_facts", "I01_interpretation", "E05_text_entries"])
def test_spread_over_cores(spark, name, monkeypatch):
    from keyloom.plans import deep

    seen = []
    real = deep.dealt
    monkeypatch.setattr(deep, "dealt", lambda df, *keys: seen.append(real(df, *keys)) or seen[-1])
    entry.queries()[name](spark, SF)
    assert seen and all(x.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism for x in seen)
