"""How rows reach the boosted trees: equal parts for each core, and folds read from one stored table."""

import threading

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import functions as F

from plumbline.operators import modeling, sampling
from plumbline.plans import checks

GRID = {"max_depth": [1, 2], "min_child_weight": [1, 5]}


@pytest.fixture(scope="module")
def rows(spark):
    """Two features, of which one decides, in parts of very different sizes."""
    parts = [spark.range(a, b, 1, n) for a, b, n in ((0, 900, 1), (900, 1000, 9))]
    wanted = ((F.col("id") * 7) % 13 < 4) != (F.col("id") % 17 == 0)
    named = parts[0].union(parts[1]).select("id", ((F.col("id") * 7) % 13).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    return named.withColumn("Class", wanted.cast("int"))


@pytest.fixture
def fits(monkeypatch):
    """Tables that boosted trees were fitted on, and how many fits ran side by side at most."""
    seen, now, lock, fit = {"tables": [], "most": 0}, [0], threading.Lock(), GBTClassifier._fit

    def counted(self, dataset):
        with lock:
            now[0] += 1
            seen["tables"].append(dataset)
            seen["most"] = max(seen["most"], now[0])
        try:
            return fit(self, dataset)
        finally:
            with lock:
                now[0] -= 1

    monkeypatch.setattr(GBTClassifier, "_fit", counted)
    return seen


def test_rows_of_a_fit_are_dealt_equally(spark, rows, fits, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(modeling, "EVEN_ROWS", 10, raising=False)
    monkeypatch.setattr(modeling, "TASK_ROWS", 100, raising=False)
    model = modeling.fit_booster(rows, ["a", "b"], maxIter=1, maxDepth=1)
    sizes = fits["tables"][0].rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert sum(sizes) == 1000 and len(sizes) == cores * -(-1000 // (cores * 100))
    assert max(sizes) - min(sizes) <= rows.rdd.getNumPartitions()
    assert modeling.score_model(model, rows).count() == 1000


def test_a_small_table_stays_as_it_lies(rows, fits):
    modeling.fit_booster(rows, ["a", "b"], maxIter=1, maxDepth=1)
    assert fits["tables"][0].rdd.getNumPartitions() == rows.rdd.getNumPartitions()


def test_the_search_is_sparks_over_the_same_folds(rows):
    found = modeling.tune_booster(rows, ["a", "b"], GRID, maxIter=2, keep_models=True)
    pipeline = modeling.booster_pipeline(["a", "b"], maxIter=2)
    settings = modeling.parameter_grid(pipeline.getStages()[-1], GRID)
    judge = BinaryClassificationEvaluator(labelCol="Class", metricName="areaUnderPR", numBins=0)
    plain = CrossValidator(estimator=pipeline, estimatorParamMaps=settings, evaluator=judge, numFolds=3, foldCol="fold")
    other = plain.fit(sampling.with_fold(rows, 3))
    assert found.avgMetrics == pytest.approx(other.avgMetrics, abs=1e-12)
    assert found.stdMetrics == pytest.approx(other.stdMetrics, abs=1e-12)
    scores = [modeling.score_model(m, rows).orderBy("id").select("p").toPandas()["p"] for m in (found.bestModel, other.bestModel)]
    assert scores[0].tolist() == pytest.approx(scores[1].tolist(), abs=1e-9)
    assert [len(subs) for subs in found.subModels] == [4, 4, 4]
    assert [{p.name: v for p, v in m.items()} for m in found.getEstimatorParamMaps()] == [{p.name: v for p, v in m.items()} for m in settings]


@pytest.mark.parametrize(("held", "most"), [(1, 1), (2500, 2)])
def test_fits_side_by_side_hold_a_bounded_number_of_rows(rows, fits, monkeypatch, held, most):
    monkeypatch.setattr(modeling, "SIDE_ROWS", held, raising=False)
    modeling.tune_booster(rows, ["a", "b"], GRID, maxIter=1)
    assert len(fits["tables"]) == 13 and fits["most"] == most


def test_an_empty_fold_is_refused(rows):
    with pytest.raises(ValueError, match="fold"):
        modeling.tune_booster(rows.where("id = 3"), ["a", "b"], GRID, maxIter=1)


def test_the_check_scores_a_fold_once_for_all_settings(spark, rows, monkeypatch):
    model = modeling.tune_booster(rows, ["a", "b"], GRID, maxIter=2, keep_models=True)
    monkeypatch.setattr(checks, "searched", lambda spark, sf_dir: (model, rows))
    stored, store = [], checks.materialize
    monkeypatch.setattr(checks, "materialize", lambda df, name: stored.append(name) or store(df, name))
    found = checks.cross_validation_check(spark, "").collect()
    assert sum(r["n_rows"] for r in found) == 1000 and {(r["n_settings"], r["n_off"]) for r in found} == {(4, 0)}
    assert stored == ["folds"] + ["scored-folds"] * 3
    model.avgMetrics[2] += 0.01
    assert {r["n_off"] for r in checks.cross_validation_check(spark, "").collect()} == {1}
