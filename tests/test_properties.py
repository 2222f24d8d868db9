"""Definitions that must hold on any data, and brute-force comparisons."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.arrays import spread, vectorize
from plumbline.functions.hashing import hash_key
from plumbline.functions.vectors import gaussian_matrix
from plumbline.operators import (
    cleaning,
    discriminate,
    fidelity,
    metrics,
    modeling,
    numbering,
    profiling,
    sampling,
    shapley,
    stability,
)
from plumbline.operators.quantiles import exact_quantiles
from plumbline.operators.shapley import LinearShap, TreeShap, leaf_paths, tree_values
from plumbline.operators.surrogate import GRID, Lime, Sampler
from plumbline.operators.trees import Ensemble, ensemble_margins
from plumbline.plans import report
from plumbline.plans.standin import (
    FEATURES,
    FIXED_TREES,
    LOGISTIC_BIAS,
    LOGISTIC_WEIGHTS,
    transactions,
    transactions_dirty,
)
from plumbline.sources.models import load_ensemble


@pytest.fixture(scope="module")
def table(spark, sf_dir):
    return transactions(spark, sf_dir).persist()


@pytest.fixture(scope="module")
def scorer(table):
    return modeling.LogisticScorer.fit(table, FEATURES, LOGISTIC_BIAS, LOGISTIC_WEIGHTS)


@pytest.fixture(scope="module")
def model_path(table):
    return report.trained_model_path(table, FEATURES, maxIter=5, maxDepth=4)


# --- tree values ------------------------------------------------------------------------


def random_tree(rng, features, depth, node=0, tree=0, cover=64.0, out=None):
    out = [] if out is None else out
    if depth == 0:
        out.append((tree, 0.7, node, None, None, -1, -1, cover, float(rng.normal())))
        return out
    left = float(int(cover * rng.uniform(0.2, 0.8)))
    feature = features[rng.integers(len(features))]
    out.append((tree, 0.7, node, feature, float(rng.normal()), 2 * node + 1, 2 * node + 2, cover, 0.0))
    random_tree(rng, features, depth - 1, 2 * node + 1, tree, left, out)
    random_tree(rng, features, depth - 1, 2 * node + 2, tree, cover - left, out)
    return out


def conditional(nodes, node, x, known):
    """Expected leaf value when only the features in ``known`` are given."""
    _, weight, _, feature, cut, left, right, cover, value = nodes[node]
    if left < 0:
        return weight * value
    if feature in known:
        return conditional(nodes, left if x[feature] <= cut else right, x, known)
    return sum(nodes[c][7] / cover * conditional(nodes, c, x, known) for c in (left, right))


def brute_force(rows, features, x):
    trees = {}
    for row in rows:
        trees.setdefault(row[0], {})[row[2]] = row
    m, phi = len(features), []
    for f in features:
        others, total = [g for g in features if g != f], 0.0
        for size in range(m):
            share = factorial(size) * factorial(m - size - 1) / factorial(m)
            for known in combinations(others, size):
                for tree in trees.values():
                    total += share * (
                        conditional(tree, 0, x, {*known, f}) - conditional(tree, 0, x, set(known))
                    )
        phi.append(total)
    return phi


def test_tree_values_equal_subset_enumeration():
    rng = np.random.default_rng(3)
    features = ["a", "b", "c", "d", "e"]
    rows = random_tree(rng, features, 4) + random_tree(rng, features, 3, tree=1)
    ensemble = Ensemble(rows, features)
    x = rng.normal(size=(12, 5))
    phi = tree_values(leaf_paths(ensemble), x)
    for i in range(len(x)):
        assert phi[i] == pytest.approx(brute_force(rows, features, dict(zip(features, x[i]))), abs=1e-12)
    base = sum(t[0] * np.prod(t[4]) for t in leaf_paths(ensemble))
    assert phi.sum(axis=1) + base == pytest.approx(ensemble_margins(ensemble.margin_arrays(), x))


def test_booster_values_add_up_and_skip_unused_features(spark, table, model_path):
    scorer = report.load_scorer(spark, model_path)
    explainer = TreeShap(scorer.ensemble)
    explained = scorer.score(explainer.explain(spread(vectorize(table, FEATURES)))).collect()
    used = {n[3] for n in scorer.ensemble.nodes if n[3]}
    for r in explained:
        assert sum(r["phi"]) + explainer.base == pytest.approx(r["margin"], abs=1e-9)
        assert all(v == 0 for f, v in zip(FEATURES, r["phi"]) if f not in used)


def test_booster_scores_agree_between_spark_and_batches(spark, table, model_path):
    scorer = report.load_scorer(spark, model_path)
    rows = scorer.score(vectorize(table, FEATURES)).select("x", "p").toPandas()
    assert scorer.batch_function()(np.array(rows["x"].tolist())) == pytest.approx(rows["p"].to_numpy())


def test_planted_features_come_first(spark, table, model_path):
    explainer = TreeShap(load_ensemble(spark, model_path))
    explained = explainer.explain(vectorize(table, FEATURES))
    top = [r["feature"] for r in shapley.global_importance(explained, FEATURES).limit(2).collect()]
    assert set(top) == {"V2", "V13"}


def test_fixed_trees_score_alike_as_columns_and_arrays(table):
    ensemble = Ensemble(FIXED_TREES, FEATURES)
    rows = modeling.TreeScorer(ensemble).score(vectorize(table, FEATURES)).select("x", "margin").toPandas()
    margins = ensemble_margins(ensemble.margin_arrays(), np.array(rows["x"].tolist()))
    assert margins == pytest.approx(rows["margin"].to_numpy())


def test_missing_values_take_the_same_branch_everywhere(spark):
    ensemble = Ensemble(FIXED_TREES, FEATURES)
    x = [[float("nan") if f in gone else 0.0 for f in FEATURES] for gone in ([], ["V13"], ["V2", "V13"], FEATURES)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "id long, x array<double>")
    scored = modeling.TreeScorer(ensemble).score(rows).orderBy("id").collect()
    assert [r["margin"] for r in scored] == pytest.approx(
        ensemble_margins(ensemble.margin_arrays(), np.array(x)).tolist()
    )
    explainer = TreeShap(ensemble)
    phi = tree_values(explainer.leaves, np.array(x))
    assert (phi.sum(axis=1) + explainer.base).tolist() == pytest.approx([r["margin"] for r in scored])


# --- surrogates -------------------------------------------------------------------------


def ridge(z, y, w, alpha):
    """Weighted ridge with a free intercept by the augmented normal equations."""
    a = np.column_stack([z, np.ones(len(z))])
    penalty = np.diag([alpha] * z.shape[1] + [0.0])
    return np.linalg.solve(a.T @ (a * w[:, None]) + penalty, a.T @ (w * y))[:-1]


def test_surrogate_weights_equal_a_row_by_row_fit():
    rng = np.random.default_rng(5)
    width, samples = 6, 200
    cuts = np.tile([-0.7, 0.0, 0.7], (width, 1))
    values = np.sort(rng.normal(size=(width, 4, GRID)), axis=2)
    sampler = Sampler(cuts, np.tile([0.25, 0.5, 0.75], (width, 1)), values)
    slope = rng.normal(size=width)
    predict = lambda m: 1 / (1 + np.exp(-(m @ slope)))
    lime = Lime([f"f{i}" for i in range(width)], sampler, None, n_samples=samples, n_features=3)
    x = rng.normal(size=(4, width))
    p = predict(x)
    phi, classes = lime.solve(*lime.samples(predict), x, p, None)
    shared = sampler.draw(np.zeros(1, np.int64), samples - 1, lime.seed)
    for i in range(len(x)):
        drawn = np.vstack([x[i], shared[1][0]])
        bins = np.vstack([sampler.bins(x[i : i + 1]), shared[0][0]])
        z = (bins == bins[0]).astype(float)
        y = predict(drawn)
        assert p[i] == pytest.approx(y[0]) and classes[i] == (y[0] > 0.5)
        y = y if classes[i] else 1 - y
        distance = np.sqrt(((z - z[0]) ** 2).sum(axis=1))
        w = np.sqrt(np.exp(-(distance**2) / (0.75 * np.sqrt(width)) ** 2))
        chosen = sorted(np.argsort(-np.abs(ridge(z, y, w, 0.01)), kind="stable")[:3])
        assert sorted(np.flatnonzero(~np.isnan(phi[i]))) == chosen
        assert phi[i][chosen] == pytest.approx(ridge(z[:, chosen], y, w, 1.0))


def test_surrogates_rank_planted_features_and_do_not_depend_on_partitions(spark, table, scorer):
    lime = Lime.fit(table, FEATURES, scorer, n_samples=300)
    rows = vectorize(table, FEATURES)
    one, many = (
        lime.long_values(lime.explain(rows.repartition(n))).orderBy("id", "rank").toPandas() for n in (1, 7)
    )
    assert one.drop(columns="weight").equals(many.drop(columns="weight"))
    assert one["weight"].to_numpy() == pytest.approx(many["weight"].to_numpy())
    first = one[one["rank"] == 1]["feature"].value_counts().index[:2]
    assert set(first) <= {"V2", "V13", "Amount"}
    assert one.groupby("id").size().eq(10).all()


# --- stability --------------------------------------------------------------------------


def test_no_noise_means_equal_explanations(table, scorer):
    explainer = LinearShap(scorer, FEATURES)
    explained = explainer.explain(vectorize(table, FEATURES))
    row = (
        stability.analyze_stability(explained, explainer, scorer.stds, multiplier=0.0)
        .agg(F.min("cosine"), F.min("jaccard_5"), F.min("jaccard_20"))
        .first()
    )
    assert list(row) == [pytest.approx(1.0), 1.0, 1.0]


def test_noise_draws_are_standard_normal_and_uncorrelated():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**31, size=(2, 50_000))
    g = gaussian_matrix(words[0], words[1], 25)
    assert abs(g.mean()) < 0.005 and abs(g.std() - 1) < 0.005 and abs((g**4).mean() - 3) < 0.05
    assert np.abs(np.corrcoef(g.T) - np.eye(25)).max() < 0.03
    assert np.abs(np.corrcoef((g**2).T) - np.eye(25)).max() < 0.03


# --- quantiles, profiles, cleaning ------------------------------------------------------


def test_quantiles_through_narrow_brackets_with_a_hot_value(spark):
    n, probs = 40_000, [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    value = F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.pow(F.rand(11) * 10, 2))
    df = spark.range(n).select(F.lit("a").alias("column"), value.alias("value")).persist()
    data = np.array([r["value"] for r in df.select("value").collect()])
    found = exact_quantiles(df, ["column"], "value", probs, accuracy=500).orderBy("prob").collect()
    assert [r["quantile"] for r in found] == pytest.approx(np.quantile(data, probs).tolist())
    exact = exact_quantiles(df, ["column"], "value", [0.8], discrete=True, accuracy=500).first()
    assert exact["quantile"] == np.sort(data)[int(0.8 * n) - 1]


def test_profiles_and_cleaning_accept_text_and_time(spark, sf_dir):
    dirty = transactions_dirty(spark, sf_dir)
    missing = {r["column"]: r["n_missing"] for r in profiling.missing_counts(dirty).collect()}
    assert missing["V5"] > 0 and missing["V7"] > 0 and missing["D"] == 0
    types = dict(cleaning.clean(dirty).dtypes)
    assert "K" not in types and types["T"] == "float" and types["D"] == "timestamp_ntz"


# --- splits and metrics -----------------------------------------------------------------


def test_splits_do_not_depend_on_partitions(table):
    def ids(df):
        return {r["id"] for r in df.select("id").collect()}

    few, many = table.coalesce(1), table.repartition(7)
    assert ids(sampling.hash_split(few)[0]) == ids(sampling.hash_split(many)[0])
    assert ids(sampling.balanced_sample(few)) == ids(sampling.balanced_sample(many))
    assert ids(sampling.with_stratified_split(few).where("is_train")) == ids(
        sampling.with_stratified_split(many).where("is_train")
    )


def test_balanced_sample_takes_any_number(table, monkeypatch):
    monkeypatch.setattr(numbering, "ROWS_A_SLICE", 100)
    for n in (0, 1, 700, 10**6):
        found = {r["Class"]: r["count"] for r in sampling.balanced_sample(table, n).groupBy("Class").count().collect()}
        have = {r["Class"]: r["count"] for r in table.groupBy("Class").count().collect()}
        assert found == {c: min(n, m) for c, m in have.items() if n}


def test_numbers_are_gapless_in_hash_order(spark, monkeypatch):
    monkeypatch.setattr(numbering, "ROWS_A_SLICE", 50)
    hashed = spark.range(1000).withColumn("h", hash_key(1, F.col("id")))
    rows = numbering.number_rows(hashed, "h", "n").orderBy("h", "id").collect()
    assert [r["n"] for r in rows] == list(range(1, 1001))


def test_every_row_gives_and_takes_once(table):
    rows = fidelity.with_donors(vectorize(table, FEATURES)).select("id", "x", "donor").collect()
    assert len(rows) == table.count()
    assert sorted(map(tuple, (r["donor"] for r in rows))) == sorted(map(tuple, (r["x"] for r in rows)))


def test_areas_do_not_tie_small_scores(spark):
    scored = spark.createDataFrame([(4e-7, 1), (3e-7, 0), (2e-7, 0), (1e-7, 0)], "p double, Class int")
    assert metrics.curve_areas(scored).first().asDict() == {"auc_roc": 1.0, "auc_pr": 1.0, "average_precision": 1.0}


def test_clean_by_subset_drops_duplicates_before_constants(spark):
    rows = spark.createDataFrame([(1, 5, 2.0), (1, 6, 2.0), (1, 7, 2.0)], "k int, a int, c double")
    assert cleaning.clean(rows, ["k"]).columns == []
    assert cleaning.clean(rows, ["a"]).columns == ["a"]


def test_missing_values_get_the_text_of_their_bin(spark):
    sampler = Sampler(np.tile([-1.0, 0.0, 1.0], (1, 1)), np.tile([0.25, 0.5, 0.75], (1, 1)), np.zeros((1, 4, GRID)))
    rows = spark.createDataFrame([(1, [float("nan")]), (2, [5.0])], "id long, x array<double>")
    texts = [r[0][0] for r in rows.orderBy("id").select(Lime(["a"], sampler, None).conditions()).collect()]
    assert texts == ["a <= -1.00", "a > 1.00"] and sampler.bins(np.array([[np.nan]])).tolist() == [[0]]


def test_edges_fall_into_the_bucket_above(spark):
    rows = spark.createDataFrame([(k / 10,) for k in range(11)], "v double")
    got = [r[0] for r in rows.orderBy("v").select(profiling.bucket(F.col("v"), F.lit(0.0), F.lit(1.0), 10)).collect()]
    assert got == [*range(10), 9]



def test_confusion_counts_sum_to_the_rows_and_areas_ignore_monotone_maps(table, scorer):
    scored = modeling.with_class_probabilities(scorer.score(vectorize(table, FEATURES))).persist()
    assert sum(metrics.confusion_counts(scored).first()) == scored.count()
    coarse = scored.withColumn("p", F.round("p", 3))
    squeezed = coarse.withColumn("p", F.col("p") / 2 + 0.25)
    assert metrics.curve_areas(coarse).first()["auc_roc"] == pytest.approx(
        metrics.curve_areas(squeezed).first()["auc_roc"]
    )


# --- models trained on explanations, reports --------------------------------------------


def test_one_class_gives_zero_metrics(table):
    split = discriminate.split_matrix(table.where("Class = 0"))
    rows, importance = discriminate.train_and_evaluate(split, FEATURES)
    assert {r["metric"]: r["value"] for r in rows.collect()} == dict.fromkeys(discriminate.METRICS, 0.0)
    assert importance is None


def test_explanations_beat_chance(table, scorer):
    explained = LinearShap(scorer, FEATURES).explain(vectorize(table, FEATURES))
    split = discriminate.split_matrix(discriminate.explanation_matrix(explained, FEATURES))
    rows, _ = discriminate.train_and_evaluate(split, FEATURES, "tree")
    found = {r["metric"]: r["value"] for r in rows.collect()}
    assert found["recall"] > 0.8 and found["accuracy"] > 0.8


def test_unused_features_do_not_spoil_the_regression(table, model_path, spark):
    explained = TreeShap(load_ensemble(spark, model_path)).explain(vectorize(table, FEATURES))
    matrix = discriminate.explanation_matrix(explained, FEATURES).withColumn("V7", F.lit(0.0))
    rows, importance = discriminate.train_and_evaluate(discriminate.split_matrix(matrix), FEATURES)
    found = {r["metric"]: r["value"] for r in rows.collect()}
    assert found["f1_score"] > 0.9 and found["auc_pr"] > 0.9
    weights = {r["feature"]: r["importance"] for r in importance.collect()}
    assert len(weights) == 25 and weights["V7"] == 0 and min(weights["V2"], weights["V13"]) > 0.5


def test_unknown_method_is_refused(table, scorer):
    with pytest.raises(ValueError):
        report.get_explainer("gradients", table, FEATURES, scorer)


def test_report_grades_the_first_rows_only_when_asked(spark, table, model_path):
    results = report.explain(table, model_path, "LIME", n=60, n_samples=200)
    assert results["explanations"].count() == 60
    means = {r["metric"]: r for r in results["means"].collect()}
    assert means["cosine"]["n"] == 60 and 0 < means["cosine"]["mean"] <= 1


def test_analysis_covers_every_profile(table):
    results = report.analyze(table)
    assert results["statistics"].count() == 27
    assert results["correlations"].count() == 27 * 26 // 2
