"""What the physical plans must and must not hold."""

from __future__ import annotations

import re

import pytest

from sessionmeter.functions.ranges import Range
from sessionmeter.operators import usage
from sessionmeter.registry import all_queries
from sessionmeter.registry import tables as T

SF = "/root/testdata/sf0.001"
# these only have a one-row aggregate or a page of results in one task; walking folders and state need Python
BATCH = sorted(n for n in all_queries() if not n.startswith(("streamed_", "stored_", "home_")))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_python_no_cross_join_no_global_window(spark, name):
    text = plan(all_queries()[name](spark, SF))
    for word in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroups", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in text
    assert not re.search(r"\n[^\n]*Window [^\n]*\n[^\n]*Sort [^\n]*\n[^\n]*Exchange SinglePartition", text)


def test_window_scan_prunes_and_preaggregates(spark):
    scanned = usage.scan_window(T.token_events(spark, SF), Range("7d", T.NOW).cutoff)
    text = plan(scanned)
    assert "ReadSchema" in text
    # partial aggregation below the first exchange, numbers only in its buffers
    assert text.count("HashAggregate(keys=[agent") >= 2
