"""Surrogates at size: what a row sends on, how bins are counted, and sums over bins of every shape."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.arrays import vectorize
from plumbline.operators import surrogate
from plumbline.operators.surrogate import GRID, Lime, Sampler, surrogate_bins, weighted_products

NAMES = ["a", "b", "c"]


class Flat:
    """A scorer that knows one probability."""

    def batch_function(self):
        return lambda x: np.full(len(x), 0.7)


def explained(spark):
    cuts = np.array([[0.0, 1.0, 2.0]] * 3)
    lime = Lime(NAMES, Sampler(cuts, np.tile([0.25, 0.5, 0.75], (3, 1)), np.zeros((3, 4, GRID))), Flat())
    rows = [(1, [0.5, None, 3.0], [0.1, None, -0.2]), (2, [float("nan"), 1.5, 0.0], [None, None, 0.3]), (3, [1.0, 1.0, 1.0], [None] * 3)]
    return lime, spark.createDataFrame(rows, "id long, x array<double>, phi array<double>")


def test_long_values_are_the_weighted_features_with_their_texts(spark):
    lime, rows = explained(spark)
    found = lime.long_values(rows.repartition(1)).orderBy("id", "rank").collect()
    assert [tuple(r) for r in found] == [
        (1, 1, "c", 3, "c > 2.00", -0.2),
        (1, 2, "a", 1, "0.00 < a <= 1.00", 0.1),
        (2, 1, "c", 3, "c <= 0.00", 0.3),
    ]


def test_only_weighted_features_leave_a_row(spark):
    lime, rows = explained(spark)
    plan = lime.long_values(rows)._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and "inline" in plan


def test_bins_are_counted_without_a_join(spark):
    rows = spark.createDataFrame([(i, float(i), float(i % 3), None) for i in range(40)], "id int, a double, b double, c double")
    found = surrogate_bins(rows, NAMES)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    by_bin = {(r["feature"], r["bin"]): r for r in found.collect()}
    assert [by_bin["a", k]["n"] for k in range(4)] == [10, 10, 10, 10] and not any(f == "c" for f, _ in by_bin)
    assert (by_bin["a", 0]["low"], by_bin["a", 0]["high"], by_bin["a", 3]["high"]) == (0.0, 9.75, 39.0)
    assert {k: r["n"] for (f, k), r in by_bin.items() if f == "b"} == {0: 14, 1: 13, 2: 13}
    assert surrogate_bins(rows.where("id < 0"), NAMES).collect() == []


def test_a_deviation_of_rounding_is_none():
    values = surrogate._bin_quantiles(0.03000000000000101, 2.6651906258685494e-18, 0.02, 0.03)
    assert values == pytest.approx(np.full(GRID, 0.03))
    assert np.isfinite(surrogate._bin_quantiles(0.5003, 1e-6, 0.0, 1.0)).all()


@pytest.mark.parametrize("width, samples", [(1, 41), (2, 40), (7, 333), (7, 1)])
def test_sums_where_bins_are_empty_odd_or_alone(width, samples):
    rng = np.random.default_rng(width)
    bins = rng.choice(4, (samples, width), p=[0.0, 0.1, 0.6, 0.3]).astype(np.int8)
    own, scores = rng.integers(0, 4, (600, width)), rng.uniform(size=samples)
    by_matches = np.linspace(0.2, 1.0, width + 1)
    weight, with_score, products, scored = weighted_products(bins, scores, own, by_matches)
    for i in range(0, 600, 37):
        z = (bins == own[i]).astype(float)
        w = by_matches[z.sum(axis=1).astype(int)]
        assert weight[i] == pytest.approx(w.sum()) and with_score[i] == pytest.approx(w @ scores)
        assert products[i] == pytest.approx(z.T @ (z * w[:, None]), abs=1e-12) and scored[i] == pytest.approx(z.T @ (w * scores), abs=1e-12)


def test_bytes_are_looked_up_in_pairs():
    by_matches, matches = np.random.default_rng(1).uniform(size=26), np.random.default_rng(2).integers(0, 26, (5, 8)).astype(np.uint8)
    pairs = surrogate.paired_weights(by_matches)
    for part in (matches, np.ascontiguousarray(matches[:, :7]), matches.astype(np.uint16)):
        assert (surrogate.weights_of(part, by_matches, pairs) == by_matches[part]).all()
