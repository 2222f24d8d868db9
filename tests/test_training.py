"""Early stopping, search names, balanced samples, certificates, stored scopes and the jobs' settings."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.arrays import vectorize
from plumbline.functions.hashing import hash_key
from plumbline.operators import certificates, discriminate, metrics, modeling, profiling, quantiles, sampling
from plumbline.operators.trees import Ensemble
from plumbline.plans import report
from plumbline.plans.standin import FEATURES, transactions
from plumbline.sources.models import first_trees, load_ensemble, load_model, save_model
from plumbline.sources.shared import fresh_path, materialize, scratch
from plumbline.sources.tables import read_table


@pytest.fixture(scope="module")
def table(spark, sf_dir):
    return materialize(transactions(spark, sf_dir), "rows")


@pytest.fixture(scope="module")
def path(table):
    return report.trained_model_path(table, FEATURES, maxIter=8, maxDepth=4)


# --- early stopping ---------------------------------------------------------------------


@pytest.mark.parametrize(
    ("areas", "patience", "kept"),
    [
        ([0.1, 0.2, 0.3], 2, 3),
        ([0.5, 0.4, 0.6, 0.9], 2, 4),
        ([0.5, 0.4, 0.3, 0.9], 2, 1),
        ([0.5, 0.5, 0.5], 5, 1),
        ([None, 0.2, 0.2], 2, 2),
        ([None, None], 5, 1),
        ([0.7], 1, 1),
    ],
)
def test_patience(areas, patience, kept):
    assert modeling.best_prefix(areas, patience) == kept


def test_first_trees_score_like_the_prefix(spark, table, path):
    short = first_trees(spark, path, 3)
    assert short.stages[-1].getNumTrees == 3
    saved = save_model(short, fresh_path(spark, "model"))
    ensemble = load_ensemble(spark, path)
    want = Ensemble([n for n in ensemble.nodes if n[0] < 3], ensemble.features, ensemble.scale)
    for model in (short, load_model(saved)):
        rows = modeling.score_model(model, table).withColumn("x", F.array(*[F.col(f) for f in FEATURES])).select("x", "p").toPandas()
        scorer = modeling.TreeScorer(want)
        assert scorer.batch_function()(np.array(rows["x"].tolist())) == pytest.approx(rows["p"].to_numpy())


@pytest.mark.parametrize("held", [1 << 20, 50])
def test_staged_areas_equal_curves_of_each_prefix(spark, table, path, monkeypatch, held):
    monkeypatch.setattr(modeling, "HELD_LEVELS", held)
    ensemble = load_ensemble(spark, path)
    rows = vectorize(table, FEATURES)
    staged = {r["n_trees"]: r for r in modeling.staged_areas(rows, ensemble).collect()}
    assert sorted(staged) == list(range(1, 9))
    for n in (1, 4, 8):
        scored = modeling.score_model(first_trees(spark, path, n), table)
        level = F.floor(F.col("p") * modeling.SCORE_LEVELS) / modeling.SCORE_LEVELS
        plain = metrics.curve_areas(scored.withColumn("p", level)).first()
        for name in ("auc_roc", "auc_pr", "average_precision"):
            assert staged[n][name] == pytest.approx(plain[name], abs=1e-12)


def test_early_stopping_cuts_where_patience_ends(table):
    marked = sampling.with_split(table, 0.7, to="keep").withColumn("is_validation", ~F.col("keep")).drop("keep")
    model, areas = modeling.fit_with_early_stopping(marked, FEATURES, patience=2, maxIter=12, maxDepth=3)
    found = [r["auc_pr"] for r in areas.orderBy("n_trees").collect()]
    assert len(found) == 12 and model.stages[-1].getNumTrees == modeling.best_prefix(found, 2)


def test_grid_names_are_mapped_or_refused_by_name():
    booster = modeling.booster_pipeline(FEATURES).getStages()[-1]
    grid = {name: [1] for name in modeling.GRID_NAMES if name != "colsample_bytree"} | {"colsample_bytree": [0.8]}
    (setting,) = modeling.parameter_grid(booster, grid)
    assert {p.name for p in setting} == set(modeling.GRID_NAMES.values())
    assert next(v for p, v in setting.items() if p.name == "featureSubsetStrategy") == "0.8"
    for name in modeling.GRID_REFUSED:
        with pytest.raises(ValueError, match=name):
            modeling.parameter_grid(booster, {name: [0, 1]})


# --- certificates -----------------------------------------------------------------------


def test_leaf_means_certify_every_tree_and_catch_a_changed_leaf(spark, table, path):
    ensemble = load_ensemble(spark, path)
    train = vectorize(sampling.with_split(table, 0.8).where("is_train"), FEATURES)
    rows = certificates.leaf_means(train, ensemble).collect()
    assert {r["tree"] for r in rows} == set(range(8))
    assert all(r["value"] == pytest.approx(r["mean"], abs=1e-9) for r in rows)
    nodes = [(*n[:8], n[8] + 0.01) if n[0] == 5 and n[5] < 0 else n for n in ensemble.nodes]
    off = {r["tree"] for r in certificates.leaf_means(train, Ensemble(nodes, ensemble.features, 2.0)).collect() if abs(r["value"] - r["mean"]) > 1e-6}
    assert 5 in off and not off & set(range(5))


def test_slopes_vanish_at_the_solution_only(table):
    model = modeling.fit_simple_model(table, FEATURES)
    assert all(abs(r["slope"]) < 1e-2 for r in certificates.loss_slopes(table, model).collect())
    other = modeling.fit_simple_model(table.where("id % 9 = 0"), FEATURES)
    assert any(abs(r["slope"]) > 1e-2 for r in certificates.loss_slopes(table, other).collect())


def test_votes_are_the_tree_of_those_rows_only(table):
    model = modeling.fit_simple_model(table, FEATURES, "tree")
    assert all(r["p"] == pytest.approx(r["vote"]) for r in certificates.leaf_votes(table, model).collect())
    other = table.withColumn("Class", F.when(F.col("id") % 3 == 0, 1 - F.col("Class")).otherwise(F.col("Class")))
    assert any(abs(r["p"] - r["vote"]) > 1e-6 for r in certificates.leaf_votes(other, model).collect())


def test_evaluators_agree_and_differ(spark, table, path):
    scored = materialize(modeling.score_model(load_model(path), table).select("Class", "p", "prediction"), "scored")
    assert certificates.evaluator_gaps(scored) == []
    wrong = {"f1_score": 0.1, "recall": 0.1, "precision": 0.1, "accuracy": 0.1, "auc_pr": 0.1}
    assert len(certificates.evaluator_gaps(scored, wrong)) == 5


# --- one scored pass --------------------------------------------------------------------


def test_counts_give_the_same_metrics_as_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(float(s), int(y), int(s > 0.5)) for s, y in zip(rng.integers(0, 9, 300) / 8, rng.integers(0, 2, 300))]
    rows += [(None, 1, 0), (float("nan"), 0, 0)]
    scored = spark.createDataFrame(rows, "p double, Class int, prediction int")
    counts = metrics.score_counts(scored)
    assert metrics.counted_confusion(counts).collect() == metrics.confusion_counts(scored).collect()
    assert metrics.counted_areas(counts).collect() == metrics.curve_areas(scored).collect()


def test_scored_rows_are_executed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(i):
        seen.add(1)
        return float(i % 7) / 7

    rows = spark.range(200).select(score("id").alias("p"), (F.col("id") % 2).alias("Class"), F.lit(1.0).alias("prediction"))
    metrics.positive_class_metrics(rows.where("p >= 0")).collect()
    assert seen.value <= 400  # the filter and the projection of one pass


def test_class_sizes_of_a_split(spark, table):
    split = discriminate.split_matrix(table.select("id", "Class", "V1"))
    sizes = {r["Class"]: r["count"] for r in table.groupBy("Class").count().collect()}
    assert (split.positives, split.others) == (sizes[1], sizes[0]) and split.usable
    assert not discriminate.split_matrix(table.select("id", "Class", "V1").where("Class = 0")).usable


def test_a_label_with_too_many_values_is_refused_by_name(spark, monkeypatch):
    monkeypatch.setattr(modeling, "MOST_LABELS", 5)
    with pytest.raises(ValueError, match="Amount"):
        modeling.with_balanced_weight(spark.range(10).withColumnRenamed("id", "Amount"), "Amount")


# --- balanced samples -------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 7, 400, 5000])
def test_smallest_rows_match_a_sort(spark, n):
    rows = spark.range(3000).select("id", (F.col("id") % 11 == 0).cast("int").alias("Class")).withColumn("h", hash_key(1, F.col("id")))
    got = {(r["Class"], r["id"]) for r in sampling.smallest_rows(rows, n, "h", "Class").collect()}
    expected = set()
    for c in (0, 1):
        own = sorted((r["h"], r["id"]) for r in rows.where(F.col("Class") == c).collect())
        expected |= {(c, i) for _, i in own[:n]}
    assert got == expected


def test_a_repeated_key_fills_a_class(spark):
    rows = spark.range(900).select(F.when(F.col("id") < 600, 5).otherwise(F.col("id")).alias("id"), F.lit(1).alias("Class"))
    got = sampling.balanced_sample(rows, 50).collect()
    assert len(got) == 50
    assert sampling.balanced_sample(rows.where("id < 0"), 50).collect() == []


def test_only_rows_below_the_cut_are_shuffled(spark, table, monkeypatch):
    seen = {}
    number = sampling.number_rows
    monkeypatch.setattr(sampling, "number_rows", lambda df, *a, **k: number(seen.setdefault("rows", df), *a, **k))
    assert sampling.balanced_sample(table, 20).count() == 40
    assert 40 <= seen["rows"].count() <= 4 * 40


# --- scopes and jobs --------------------------------------------------------------------


def _folder(spark) -> set[str]:
    return set(os.listdir(spark.conf.get("spark.checkpoint.dir")))


def test_a_scope_deletes_what_was_stored_inside(spark):
    before = _folder(spark)
    with scratch(spark) as owned:
        materialize(spark.range(5), "one")
        with scratch(spark):
            materialize(spark.range(5), "two")
            assert len(_folder(spark) - before) == 2
        assert len(_folder(spark) - before) == 1 and len(owned) == 1
    assert _folder(spark) == before
    with pytest.raises(ZeroDivisionError), scratch(spark):
        materialize(spark.range(5), "three")
        1 / 0
    assert _folder(spark) == before


def test_jobs_leave_only_their_results(spark, table, tmp_path):
    before = _folder(spark)
    model = str(tmp_path / "model")
    written = report.saved(report.train, table, str(tmp_path / "train"), model, patience=2, maxIter=6, maxDepth=3)
    assert {"scored", "confusion", "metrics", "areas", "stages"} == set(written)
    assert spark.read.parquet(written["stages"]).count() == 6
    predictions = str(tmp_path / "predictions.csv")
    written = report.saved(report.explain, table, str(tmp_path / "explain"), model, n=60, threshold=0.3, predictions=predictions)
    assert _folder(spark) == before
    rows = read_table(spark, predictions, "id long, p double, flagged boolean")
    assert rows.count() == 60 and rows.where("flagged != (p >= 0.3)").count() == 0
    assert spark.read.parquet(written["explanations"]).count() == 60
    assert spark.read.parquet(written["means"]).count() == 6


def test_a_search_and_patience_exclude_each_other(table, tmp_path):
    with pytest.raises(ValueError, match="early stopping"):
        report.train(table, str(tmp_path / "m"), grid={"max_depth": [2]}, patience=3)


# --- quantiles ----------------------------------------------------------------------------


ORDERS = {
    "rising": lambda n, rng: np.arange(n, dtype=float),
    "falling": lambda n, rng: -np.arange(n, dtype=float),
    "zigzag": lambda n, rng: np.where(np.arange(n) % 2 == 0, np.arange(n), -np.arange(n)).astype(float),
    "blocks": lambda n, rng: np.concatenate([np.arange(k, n, 97) for k in range(97)]).astype(float),
    "hot": lambda n, rng: np.where(rng.random(n) < 0.4, 7.0, rng.normal(size=n) * 10.0 ** rng.integers(-200, 200, n)),
    "two": lambda n, rng: (np.arange(n) > n // 3).astype(float),
}


@pytest.mark.parametrize("order", ORDERS)
@pytest.mark.parametrize("error", [None, 1e-7])
def test_quantiles_of_adversarial_orders(spark, monkeypatch, order, error):
    """Also with brackets so narrow that every rank is missed at first, and widened until it is held."""
    if error:
        monkeypatch.setattr(quantiles, "rank_error", lambda size: error)
    n, probs = 6001, [0.0, 0.013, 0.25, 0.5, 0.9, 1.0]
    data = ORDERS[order](n, np.random.default_rng(3))
    rows = spark.createDataFrame([("c", float(v)) for v in data] + [("d", 1.0), ("d", None), ("e", float("nan"))], "g string, v double").coalesce(2)
    found = quantiles.exact_quantiles(rows, ["g"], "v", probs, accuracy=8).collect()
    got = {(r["g"], r["prob"]): r["quantile"] for r in found}
    assert {g for g, _ in got} == {"c", "d"} and all(got["d", p] == 1.0 for p in probs)
    assert [got["c", p] for p in probs] == pytest.approx(np.quantile(data, probs).tolist(), rel=1e-12)
    ranks = {r["prob"]: r["quantile"] for r in quantiles.exact_quantiles(rows, ["g"], "v", probs, discrete=True, accuracy=8).where("g = 'c'").collect()}
    assert ranks == {p: np.sort(data)[int(np.floor(p * n + 1e-9)) - 1] for p in probs if np.floor(p * n + 1e-9) > 0}


# --- tiles ----------------------------------------------------------------------------------


def test_tiles_cover_every_pair_once():
    for n, block in ((1, 4), (7, 3), (9, 9), (10, 1)):
        pairs = [(i, j) for a, b in profiling.column_tiles(n, block) for i in a for j in b if i < j]
        assert sorted(pairs) == [(i, j) for i in range(n) for j in range(i + 1, n)]


def test_tiled_profiles_equal_whole_ones(spark, table, monkeypatch):
    columns = FEATURES[:9]
    whole = {tuple(r) for r in profiling.scatter_bins(table, columns).collect()}
    r = {(x["col_a"], x["col_b"]): x["r"] for x in profiling.pairwise_correlation(table, columns).collect()}
    monkeypatch.setattr(profiling, "GRID_BYTES", 8 * 100 * 2 * 9)
    monkeypatch.setattr(profiling, "MOMENT_BLOCK", 4)
    assert {tuple(x) for x in profiling.scatter_bins(table, columns).collect()} == whole
    tiled = {(x["col_a"], x["col_b"]): x["r"] for x in profiling.pairwise_correlation(table, columns).collect()}
    assert tiled.keys() == r.keys() and all(tiled[k] == pytest.approx(r[k], abs=1e-12) for k in r)


def test_scatter_of_a_continuous_label_is_refused_by_name(table):
    with pytest.raises(ValueError, match="'Amount'"):
        profiling.scatter_bins(table.where("id > 0"), ["V1", "V2"], label="Amount")
