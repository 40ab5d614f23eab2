"""What grows with the corpus is not gathered by the driver, however small its file looks."""

import re

from sheetmill.plans import registry


def broadcast_joins(spark, sf, name):
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    return [line.strip() for line in plan.splitlines() if "BroadcastHashJoin" in line]


def test_pairs_of_the_cascade_are_not_broadcast(spark, sf):
    assert broadcast_joins(spark, sf, "ex1_cascade") == []


def test_names_and_chips_of_the_fallback_look_up_are_not_broadcast(spark, sf):
    # Only texts shorter than a gram are sent to all tasks.
    found = broadcast_joins(spark, sf, "jn3_fallback_lookup")
    assert [x for x in found if not re.search(r"BroadcastHashJoin \[needle#\d+\], \[needle#\d+\], LeftSemi", x)] == []
