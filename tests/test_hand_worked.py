"""Small inputs with results worked by hand."""

import math

from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.vectors import rank_matrix, similarity_function
from plumbline.operators import fidelity, metrics
from plumbline.operators.profiling import bucket, pairwise_correlation
from plumbline.operators.stability import pair_stability


def impacts(spark, rows):
    """Rows (id, rank, importance, impact)."""
    df = spark.createDataFrame(rows, "id long, rank int, importance double, impact double")
    sizes = df.groupBy("id").agg(F.count("*").cast("int").alias("n_ranked"))
    return df.join(sizes, "id")


def fidelity_of(spark, importance, impact):
    rows = [(1, i + 1, float(a), float(b)) for i, (a, b) in enumerate(zip(importance, impact))]
    return fidelity.row_fidelity(impacts(spark, rows)).first()


def test_area_is_a_trapezoid_from_the_second_feature_on(spark):
    assert fidelity_of(spark, [3, 2, 1], [0.4, 0.3, 0.1])["aufc"] == pytest.approx(0.55)
    assert fidelity_of(spark, [3], [0.4])["aufc"] == 0


def test_correlation_and_its_guards(spark):
    assert fidelity_of(spark, [3, 2, 1], [0.4, 0.3, 0.1])["correlation"] == pytest.approx(0.9819805)
    assert fidelity_of(spark, [0, 0, 0], [0.4, 0.3, 0.1])["correlation"] == 0
    assert fidelity_of(spark, [3, 2, 1], [0, 0, 0])["correlation"] == 0
    assert fidelity_of(spark, [3], [0.4])["correlation"] == 0
    assert fidelity_of(spark, [1, 1, 1], [1, 2, 3])["correlation"] is None
    assert fidelity_of(spark, [3, 2, 1], [0.4, math.nan, math.nan])["correlation"] == 0


class Shares:
    """Scores a row by the sum of its features."""

    def score(self, df, x="x"):
        total = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)
        return df.withColumn("margin", total).withColumn("p", total)

    def batch_function(self, space="p"):
        return partial(np.sum, axis=1)


def test_curve_is_the_squared_change_after_each_replacement(spark):
    row = spark.createDataFrame([(1, [0.3, 0.6], [1.0, 5.0], 0.9)], "id long, x array<double>, phi array<double>, p double")
    curve = fidelity.fidelity_curve(row, Shares(), F.array(F.lit(0.2), F.lit(0.3)))
    losses = {r["k"]: r["loss"] for r in curve.collect()}
    assert losses == {1: pytest.approx(0.09), 2: pytest.approx(0.16)}


def test_absent_features_are_not_perturbed(spark):
    row = spark.createDataFrame([(1, [0.3, 0.6, 0.1], [None, 5.0, -7.0])], "id long, x array<double>, phi array<double>")
    rows = fidelity.perturb_single(row, F.array(*[F.lit(0.0)] * 3)).orderBy("rank").collect()
    assert [(r["rank"], r["feature_pos"], r["x"]) for r in rows] == [
        (1, 3, [0.3, 0.6, 0.0]),
        (2, 2, [0.3, 0.0, 0.1]),
    ]


def test_ranks_keep_feature_order_on_ties_and_skip_absent_features():
    phi = np.array([[-2.0, 2.0, 1.0], [0.0, 0.0, 0.0], [np.nan, 1.0, -3.0]])
    assert rank_matrix(phi).tolist() == [[1, 2, 3], [1, 2, 3], [0, 2, 1]]


def similarity(spark, a, b, k=(3,)):
    df = spark.createDataFrame([(1, 1, a, b)], "id long, rep int, phi_original array<double>, phi array<double>")
    return pair_stability(df, k).first()


def test_cosine(spark):
    assert similarity(spark, [1.0, 0.0], [1.0, 1.0])["cosine"] == pytest.approx(0.7071068)
    assert similarity(spark, [0.0, 0.0], [1.0, 1.0])["cosine"] == 0


def test_jaccard(spark):
    assert similarity(spark, [3.0, 2.0, 1.0, None], [None, 3.0, 2.0, 1.0])["jaccard_3"] == 0.5
    assert similarity(spark, [None, None], [None, None])["jaccard_3"] == 0
    assert similarity_function((5,)) is not None


def scored(spark, rows):
    return spark.createDataFrame(rows, "p double, Class int")


def test_curve_areas(spark):
    area = metrics.curve_areas(scored(spark, [(0.9, 1), (0.8, 0), (0.7, 1), (0.6, 0)])).first()
    assert area["auc_roc"] == pytest.approx(0.75)
    assert area["auc_pr"] == pytest.approx(0.7916667, abs=1e-6)
    assert area["average_precision"] == pytest.approx(0.8333333, abs=1e-6)


def test_curve_areas_with_a_tie(spark):
    area = metrics.curve_areas(scored(spark, [(0.9, 1), (0.7, 1), (0.7, 0), (0.2, 0)])).first()
    assert area["auc_roc"] == pytest.approx(0.875)
    assert area["auc_pr"] == pytest.approx(0.9166667, abs=1e-6)
    assert area["average_precision"] == pytest.approx(0.8333333, abs=1e-6)


def test_curve_areas_without_one_class(spark):
    area = metrics.curve_areas(scored(spark, [(0.9, 0), (0.2, 0)])).first()
    assert area["auc_roc"] is None and area["average_precision"] is None


def test_last_bucket_is_closed(spark):
    row = spark.range(1).select(bucket(F.lit(4.0), F.lit(0.0), F.lit(4.0), 4).alias("b")).first()
    assert row["b"] == 3


def test_confusion_of_one_class_keeps_all_cells(spark):
    df = spark.createDataFrame([(0, 0.0), (0, 1.0), (0, 0.0)], "Class int, prediction double")
    cells = {(r["actual"], r["predicted"]): r["n"] for r in metrics.confusion_matrix(df).collect()}
    assert cells == {(0, 0): 2, (0, 1): 1, (1, 0): 0, (1, 1): 0}
    row = metrics.class_metrics(metrics.confusion_counts(df)).first()
    assert row["recall_1"] == 0 and row["precision_1"] == 0 and row["f1_1"] == 0


def test_correlation_of_a_constant_or_a_single_row_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.1, None), (2.0, 0.1, 3.0), (4.0, 0.1, None)], "a double, b double, c double")
    cells = {(r["col_a"], r["col_b"]): r["r"] for r in pairwise_correlation(df).collect()}
    assert cells == {("a", "b"): None, ("a", "c"): None, ("b", "c"): None}
