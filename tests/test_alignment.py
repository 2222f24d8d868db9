"""Explanations that meet by feature: packed where they lie, shuffled once, and whole wherever their entries are."""

import pytest
from pyspark.errors import PySparkException

from plumbline.operators.stability import align_explanations
from plumbline.plans.catalog import QUERIES

NAMES = ["a", "b", "c"]


def tables(spark, copies, original):
    return (
        spark.createDataFrame(original, "id string, feature string, phi double"),
        spark.createDataFrame(copies, "id string, rep int, feature string, phi double"),
    )


COPIES = [
    ("x", 1, "b", 2.0), ("x", 2, "a", 3.0), ("y", 1, "other", 9.0), ("x", 1, "a", 1.0), (None, 1, "a", 5.0), ("x", 2, "c", None), ("z", 1, "a", 1.0)
]
ORIGINAL = [("x", "c", -1.0), ("y", "a", 0.5), ("x", "a", float("nan")), (None, "a", 1.0)]


@pytest.mark.parametrize("parts", [1, 5])
def test_scattered_entries_meet(spark, parts):
    original, copies = tables(spark, COPIES, ORIGINAL)
    rows = align_explanations(original.repartition(parts), copies.repartition(parts), NAMES).orderBy("id", "rep").collect()
    assert [(r["id"], r["rep"], r["phi"]) for r in rows] == [
        ("x", 1, [1.0, 2.0, None]), ("x", 2, [3.0, None, None]), ("y", 1, [None, None, None])
    ]
    assert str(rows[0]["phi_original"]) == "[nan, None, -1.0]" and rows[2]["phi_original"] == [0.5, None, None]


def test_a_repeated_feature_is_refused(spark):
    original, copies = tables(spark, [*COPIES, ("x", 1, "a", 1.0)], ORIGINAL)
    with pytest.raises(PySparkException):
        align_explanations(original, copies, NAMES).collect()


def test_each_side_is_shuffled_once(spark, sf_dir):
    plan = QUERIES["align_explanations"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
