"""Joins of exploded rows: their estimated size is too small by the entries of their arrays."""

import pytest

from plumbline.plans.catalog import QUERIES


@pytest.mark.parametrize("name", ["join_explanations", "align_explanations"])
def test_exploded_rows_are_never_broadcast(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
