"""Plan-shape guard for every registered report: no cartesian products or
nested-loop joins, in both join modes."""

import os

import pytest

import __spark_entry__ as E
from podium.sources.fixtures import derived_tables

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no sf0.001 data")


@pytest.mark.parametrize("bound", [1_000_000, 0], ids=["broadcast", "shuffle"])
def test_no_cross_joins(spark, bound):
    t = derived_tables(spark, SF, broadcast_max_rows=bound)
    offenders = []
    for key, fn in E._QUERIES.items():
        plan = E._text_arrays(fn(t))._jdf.queryExecution().executedPlan().toString()
        if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
            offenders.append(key)
    assert offenders == []
