"""Tree Shapley values read from tables of turns, against those of one leaf after the other."""

import numpy as np
import pytest

from plumbline.operators import shapley
from plumbline.operators.shapley import TreeShap, leaf_paths, planned_values, tree_plans, tree_values
from plumbline.operators.trees import Ensemble

FEATURES = ["a", "b", "c", "d", "e", "unused"]


def grown(rng, depth, tree, cover=1000.0, node=0, out=None):
    """A random tree with covers that add up; features may come again on a path, and branches may stop early."""
    out = [] if out is None else out
    if depth == 0 or (node and rng.random() < 0.1):
        out.append((tree, 0.3, node, None, None, -1, -1, cover, float(rng.normal())))
        return out
    share = rng.uniform(0.2, 0.8)
    out.append((tree, 0.3, node, FEATURES[rng.integers(5)], float(rng.normal()), 2 * node + 1, 2 * node + 2, cover, 0.0))
    grown(rng, depth - 1, tree, cover * share, 2 * node + 1, out)
    return grown(rng, depth - 1, tree, cover * (1 - share), 2 * node + 2, out)


@pytest.mark.parametrize("turns", [8, 4, 1, 0])
@pytest.mark.parametrize("deepest", [0, 1, 6, 10])
def test_tables_give_the_values_of_all_leaves(monkeypatch, turns, deepest):
    monkeypatch.setattr(shapley, "TURNS", turns)
    rng = np.random.default_rng(deepest)
    nodes = [n for t in range(4) for n in grown(rng, deepest, t)]
    ensemble = Ensemble(nodes, FEATURES, scale=2.0)
    x = rng.normal(size=(50, len(FEATURES)))
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:3] = next((n[4] for n in nodes if n[4] is not None), 0.0)
    plans = tree_plans(ensemble)
    assert planned_values(plans, x) == pytest.approx(tree_values(leaf_paths(ensemble), x), abs=1e-12)
    assert planned_values(plans, np.zeros((0, 0))).shape == (0, 0)


def test_trees_of_the_usual_depth_are_tables_alone():
    rng = np.random.default_rng(1)
    plans = TreeShap(Ensemble([n for t in range(3) for n in grown(rng, 6, t)], FEATURES)).plans

    def parts(part):
        return [p for child in part.below for p in parts(child)] if isinstance(part, shapley.Turn) else [part]

    found = [p for plan in plans for p in parts(plan)]
    assert all(isinstance(p, shapley.Answers) and p.table.shape[1] <= 2**shapley.TURNS for p in found)
