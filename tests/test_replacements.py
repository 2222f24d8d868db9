"""Replaced features in tree ensembles: the index against scoring every replacement."""

import numpy as np
import pytest

from plumbline.operators import fidelity
from plumbline.operators.trees import Ensemble, ReplacementIndex, ensemble_margins, leaf_values, staged_margins

FEATURES = ["a", "b", "c", "d", "e", "unused"]


def grown(rng, depth, tree, node=0, out=None):
    """A random tree that may split on a feature more than once on one path, and may stop early."""
    out = [] if out is None else out
    if depth == 0 or (node and rng.random() < 0.15):
        out.append((tree, rng.uniform(0.1, 1), node, None, None, -1, -1, 1.0, float(rng.normal())))
        return out
    out.append((tree, 0.5, node, FEATURES[rng.integers(5)], float(rng.normal()), 2 * node + 1, 2 * node + 2, 2.0, 0.0))
    for child in (2 * node + 1, 2 * node + 2):
        grown(rng, depth - 1, tree, child, out)
    return out


@pytest.fixture(params=range(4))
def case(request):
    rng = np.random.default_rng(request.param)
    nodes = [n for t in range(12) for n in grown(rng, int(rng.integers(0, 7)), t)]
    x, new = rng.normal(size=(2, 40, len(FEATURES)))
    x[rng.random(x.shape) < 0.05] = np.nan
    new[rng.random(x.shape) < 0.05] = np.nan
    new[:5] = x[:5]
    ranks = np.array([rng.permutation(len(FEATURES)) + 1 for _ in x])
    ranks[::7, 2] = 0
    return Ensemble(nodes, FEATURES, scale=2.0), x, new, ranks


def test_each_replacement_scores_as_the_whole_ensemble_does(case):
    ensemble, x, new, _ = case
    arrays = ensemble.margin_arrays()
    start, after = ReplacementIndex.of(ensemble).replace_each(x, new)
    plain = fidelity.replace_each(lambda rows: ensemble_margins(arrays, rows), x, new)
    assert start == pytest.approx(plain[0]) and after == pytest.approx(plain[1], abs=1e-12)
    assert (after[:5] == start[:5, None]).all() and (after[:, 5] == start).all()


def test_replacements_in_order_score_as_the_whole_ensemble_does(case):
    ensemble, x, new, ranks = case
    arrays = ensemble.margin_arrays()
    start, after = ReplacementIndex.of(ensemble).replace_in_order(x, new, ranks)
    plain = fidelity.replace_in_order(lambda rows: ensemble_margins(arrays, rows), x, new, ranks)
    assert start == pytest.approx(plain[0]) and after == pytest.approx(plain[1], abs=1e-12)


def test_index_names_the_trees_of_a_feature(case):
    ensemble, *_ = case
    index = ReplacementIndex.of(ensemble)
    for j, f in enumerate(FEATURES):
        assert index.trees[j].tolist() == sorted({n[0] for n in ensemble.nodes if n[3] == f})


def test_staged_margins_are_those_of_the_first_trees(case):
    ensemble, x, *_ = case
    staged = staged_margins(ensemble.margin_arrays(), x)
    for k in (1, 5, 12):
        first = Ensemble([n for n in ensemble.nodes if n[0] < k], FEATURES, ensemble.scale)
        assert staged[:, k - 1] == pytest.approx(ensemble_margins(first.margin_arrays(), x))
    assert leaf_values(ensemble.margin_arrays(), x).shape == (40, 12)


def test_an_empty_batch(case):
    ensemble, *_ = case
    none = np.zeros((0, 0))
    index = ReplacementIndex.of(ensemble)
    assert index.replace_each(none, none)[1].shape == index.replace_in_order(none, none, none.astype(int))[1].shape == (0, 0)
