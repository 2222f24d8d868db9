"""What the booster's queries read, and how the scores of all prefixes are counted."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from plumbline.functions.vectors import list_array
from plumbline.operators import modeling
from plumbline.operators.trees import Ensemble, staged_margins
from plumbline.plans import catalog, report
from plumbline.plans.standin import FEATURES


@pytest.mark.parametrize("name", ["batch_score", "booster_evaluation", "booster_evaluation_check"])
def test_the_table_the_booster_was_trained_on_is_not_built_again(spark, sf_dir, monkeypatch, name):
    table = catalog.stored(catalog.transactions, spark, sf_dir)
    path = report.trained_model_path(table, FEATURES, maxIter=2, maxDepth=2)
    monkeypatch.setattr(catalog, "_ONCE", {(spark.sparkContext.applicationId, "trained_path", sf_dir): path})

    def transactions(spark, sf_dir):
        raise AssertionError("built again")

    monkeypatch.setattr(catalog, "transactions", transactions)
    found = getattr(catalog, name)(spark, sf_dir)
    assert found.count() == (table.count() if name == "batch_score" else found.distinct().count())


@pytest.mark.parametrize("dense", [0, 11])
def test_a_task_sends_each_tree_and_level_once_where_all_fit(monkeypatch, dense):
    nodes = []
    for tree in range(3):
        nodes += [(tree, 1.0, 0, "a", 0.2 * tree, 1, 2, 9.0, 0.0), (tree, 1.0, 1, None, None, -1, -1, 5.0, -0.3 - tree)]
        nodes += [(tree, 1.0, 2, "b", 0.0, 3, 4, 4.0, 0.0), (tree, 1.0, 3, None, None, -1, -1, 2.0, 0.2), (tree, 1.0, 4, None, None, -1, -1, 2.0, 0.9)]
    arrays = Ensemble(nodes, ["a", "b"], 2.0).margin_arrays()
    rng, levels = np.random.default_rng(1), 16
    parts = [(rng.normal(size=(n, 2)), rng.random(n) < 0.4) for n in (200, 0, 300)]
    batches = [pa.RecordBatch.from_arrays([list_array(x), pa.array(y, pa.bool_())], ["x", "actual"]) for x, y in parts]
    monkeypatch.setattr(modeling, "HELD_LEVELS", 5 if dense else 3)
    monkeypatch.setattr(modeling, "DENSE_LEVELS", dense, raising=False)
    sent, found, want = [], Counter(), Counter()
    for batch in modeling.staged_counter(arrays, levels)(iter(batches)):
        for r in batch.to_pylist():
            sent.append((r["n_trees"], r["level"]))
            found.update({(*sent[-1], 1): r["pos"], (*sent[-1], 0): r["neg"]})
    for x, y in parts:
        if len(x):
            p = 1.0 / (1.0 + np.exp(-staged_margins(arrays, x)))
            for i, n in np.ndindex(p.shape):
                want[n + 1, int(p[i, n] * levels), int(y[i])] += 1
    assert +found == want
    assert not dense or len(sent) == len(set(sent))
