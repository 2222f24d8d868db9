"""Surrogates of many rows at once: sums by matrix products against one row after the other."""

import numpy as np
import pytest

from plumbline.operators.surrogate import GRID, Lime, Sampler, weighted_products

WIDTH, SAMPLES = 6, 400


@pytest.fixture
def lime():
    rng = np.random.default_rng(3)
    cuts = np.sort(rng.normal(size=(WIDTH, 3)), axis=1)
    values = np.sort(rng.normal(size=(WIDTH, 4, GRID)), axis=-1)
    shares = np.tile([0.2, 0.2, 0.8], (WIDTH, 1))
    return Lime([f"f{i}" for i in range(WIDTH)], Sampler(cuts, shares, values), None, n_samples=SAMPLES, n_features=3)


def drawn(lime, n):
    x = np.random.default_rng(5).normal(size=(n, WIDTH))
    bins, scores = lime.samples(lambda v: 1 / (1 + np.exp(-v[:, 0] + v[:, 1] * v[:, 2])))
    return bins, scores, x, 1 / (1 + np.exp(-x[:, 0]))


def test_products_are_the_sums_over_all_samples_of_each_row(lime):
    bins, scores, x, _ = drawn(lime, 700)
    own, by_matches = lime.sampler.bins(x), np.linspace(0.3, 1.0, WIDTH + 1)
    weight, with_score, products, scored = weighted_products(bins, scores, own, by_matches)
    for i in range(0, len(x), 97):
        z = (bins == own[i]).astype(float)
        w = by_matches[z.sum(axis=1).astype(int)]
        assert weight[i] == pytest.approx(w.sum()) and with_score[i] == pytest.approx(w @ scores)
        assert products[i] == pytest.approx(z.T @ (z * w[:, None])) and scored[i] == pytest.approx(z.T @ (w * scores))


def test_a_row_has_the_same_weights_in_any_batch(lime):
    bins, scores, x, p = drawn(lime, 700)
    whole, classes = lime.solve(bins, scores, x, p, None)
    parts = np.vstack([lime.solve(bins, scores, x[i : i + 33], p[i : i + 33], None)[0] for i in range(0, 700, 33)])
    assert whole == pytest.approx(parts, nan_ok=True) and (classes == (p > 0.5)).all()
    assert (~np.isnan(whole)).sum(axis=1).tolist() == [3] * 700
    assert lime.solve(bins, scores, x[:0], p[:0], None)[0].shape == (0, WIDTH)


def test_the_gap_is_how_far_the_weights_are_moved(lime):
    bins, scores, x, p = drawn(lime, 20)
    phi, classes = lime.solve(bins, scores, x, p, 1 - (p > 0.5).astype(int))
    assert lime.newton_gaps(bins, scores, phi, x, p, classes) == pytest.approx(np.zeros(20), abs=1e-12)
    moved = phi.copy()
    moved[np.arange(20), np.argmax(~np.isnan(phi), axis=1)] += 0.01
    assert lime.newton_gaps(bins, scores, moved, x, p, classes) == pytest.approx(np.full(20, 0.01))
