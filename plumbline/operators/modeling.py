"""Training with Spark ML, and the scorer contract.

A scorer's ``score(df, x)`` adds ``margin`` and ``p`` (probability of class 1)
to a DataFrame that has the features in an array column; ``batch_function``
gives the same probability for a numpy matrix inside a task. A scorer that knows how a
replaced feature moves its score may offer ``replacement_functions``: functions of
``(x, new)`` and ``(x, new, ranks)`` that give the scores of ``x`` and of each replacement.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, Window, functions as F

from plumbline.functions.arrays import KEY, LABEL, vectorize
from plumbline.functions.guards import sigmoid
from plumbline.functions.vectors import matrix_of
from plumbline.operators.metrics import areas_of
from plumbline.operators.profiling import MOST_LABELS, describe, quartiles
from plumbline.operators.sampling import with_fold
from plumbline.operators.trees import Ensemble, ReplacementIndex, ensemble_margins, staged_margins
from plumbline.sources.models import first_trees, load_ensemble, save_model
from plumbline.sources.shared import fresh_path, materialize, shared_dir

# Tuning names of the reference's settings and the nearest tree parameters.
GRID_NAMES = {
    "max_depth": "maxDepth",
    "learning_rate": "stepSize",
    "n_estimators": "maxIter",
    "subsample": "subsamplingRate",
    "colsample_bytree": "featureSubsetStrategy",
    "min_child_weight": "minInstancesPerNode",
    "gamma": "minInfoGain",
}
# Tuning names that Spark's trees have no counterpart of (penalties on leaf values).
GRID_REFUSED = ("reg_alpha", "reg_lambda")

SCORE_LEVELS = 1 << 14
HELD_LEVELS = 1 << 20
DENSE_LEVELS = 4
# Rows a task of a fit, rows a core below which they stay as they lie, and rows that fits side by side hold.
TASK_ROWS = 1_000_000
EVEN_ROWS = 10_000
SIDE_ROWS = 1 << 22


def linear_margins(bias, weights, means, stds, x: np.ndarray) -> np.ndarray:
    return bias + ((x - means) / stds) @ weights


def in_space(space: str, margins, x: np.ndarray) -> np.ndarray:
    """Scores of a batch in ``margin`` or ``p``."""
    found = margins(x)
    return found if space == "margin" else 1.0 / (1.0 + np.exp(-found))


def replaced_in_space(space: str, margins, *batch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores before and after replacements in ``margin`` or ``p``."""
    found = margins(*batch)
    return found if space == "margin" else tuple(1.0 / (1.0 + np.exp(-m)) for m in found)


def batch_scores(arrays):
    """Arrow function ``x -> p`` by a node table's arrays."""

    @F.arrow_udf("double")
    def scores(x: pa.Array) -> pa.Array:
        return pa.array(in_space("p", partial(ensemble_margins, arrays), matrix_of(x)))

    return scores


class LogisticScorer:
    """Fixed weights on standardised features."""

    def __init__(self, bias, weights, means, stds):
        self.bias = float(bias)
        self.weights = [float(w) for w in weights]
        self.means = [float(m) for m in means]
        self.stds = [float(s) or 1.0 for s in stds]

    @classmethod
    def fit(cls, df: DataFrame, features: list[str], bias, weights) -> LogisticScorer:
        """Take means and deviations from the table: one row per feature reaches the driver."""
        rows = {r["column"]: r for r in describe(df, features).collect()}
        return cls(
            bias,
            weights,
            [rows[f]["mean"] for f in features],
            [rows[f]["stddev"] for f in features],
        )

    def contributions(self, x: str = "x"):
        """``w (x - mean) / std`` for each feature, as an array column."""
        return F.array(
            *[
                F.lit(w) * (F.col(x)[j] - F.lit(m)) / F.lit(s)
                for j, (w, m, s) in enumerate(zip(self.weights, self.means, self.stds))
            ]
        )

    def score(self, df: DataFrame, x: str = "x") -> DataFrame:
        margin = F.lit(self.bias)
        for j, (w, m, s) in enumerate(zip(self.weights, self.means, self.stds)):
            margin = margin + F.lit(w) * (F.col(x)[j] - F.lit(m)) / F.lit(s)
        return df.withColumn("margin", margin).withColumn("p", sigmoid(F.col("margin")))

    def batch_function(self, space: str = "p"):
        arrays = (np.array(v) for v in (self.weights, self.means, self.stds))
        return partial(in_space, space, partial(linear_margins, self.bias, *arrays))


class TreeScorer:
    """A few shallow fixed trees as conditionals."""

    def __init__(self, ensemble: Ensemble):
        self.ensemble = ensemble

    def score(self, df: DataFrame, x: str = "x") -> DataFrame:
        return df.withColumn("margin", self.ensemble.margin_column(x)).withColumn(
            "p", sigmoid(F.col("margin"))
        )

    def batch_function(self, space: str = "p"):
        return partial(in_space, space, partial(ensemble_margins, self.ensemble.margin_arrays()))

    def replacement_functions(self, space: str = "p"):
        index = ReplacementIndex.of(self.ensemble)
        return tuple(partial(replaced_in_space, space, f) for f in (index.replace_each, index.replace_in_order))


class GBTScorer(TreeScorer):
    """A fitted boosted-tree pipeline; rows are scored by Spark ML in the JVM."""

    def __init__(self, model: PipelineModel, ensemble: Ensemble):
        super().__init__(ensemble)
        self.booster = model.stages[-1]

    def score(self, df: DataFrame, x: str = "x") -> DataFrame:
        inner = self.booster.copy()
        inner.setFeaturesCol("__features").setRawPredictionCol("__raw")
        inner.setProbabilityCol("").setPredictionCol("")
        scored = inner.transform(df.withColumn("__features", array_to_vector(F.col(x))))
        margin = F.lit(2.0) * vector_to_array("__raw")[1]
        return (
            scored.withColumn("margin", margin)
            .withColumn("p", sigmoid(F.col("margin")))
            .drop("__features", "__raw")
        )


def stat_vectors(
    df: DataFrame, features: list[str], names: tuple[str, ...] = ("mean", "median", "std")
) -> dict[str, list[float]]:
    """Means, medians and deviations in feature order: one row per feature on the driver."""
    out = {}
    if "mean" in names or "std" in names:
        rows = {r["column"]: r for r in describe(df, features).collect()}
        out = {"mean": [rows[f]["mean"] for f in features], "std": [rows[f]["stddev"] for f in features]}
    if "median" in names:
        medians = {r["column"]: r["quantile"] for r in quartiles(df, features, (0.5,)).collect()}
        out["median"] = [medians[f] for f in features]
    return {n: out[n] for n in names}


def booster_pipeline(features: list[str], label: str = LABEL, **params) -> Pipeline:
    """Assembler and boosted trees; parameters by either naming."""
    settings = {GRID_NAMES.get(k, k): v for k, v in params.items()}
    settings.setdefault("seed", 42)
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=features, outputCol="features"),
            GBTClassifier(featuresCol="features", labelCol=label, **settings),
        ]
    )


def dealt(rows: DataFrame, n_rows: int) -> DataFrame:
    """Rows in equal parts, as many for each core, for a learner that passes over them hundreds of times.

    Parts that lie unequally, or one more than there are cores, would leave cores waiting in each
    pass. Small tables stay as they lie.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if n_rows < cores * EVEN_ROWS:
        return rows
    return rows.repartition(cores * -(-n_rows // (cores * TASK_ROWS)))


def fit_booster(
    train: DataFrame, features: list[str], label: str = LABEL, **params
) -> PipelineModel:
    """Fit on the training rows; the shared folder bounds the lineage of the residuals.

    The rows are assembled and dealt once, before the learner reads them.
    """
    shared_dir(train.sparkSession)
    assembler, learner = booster_pipeline(features, label, **params).getStages()
    return PipelineModel([assembler, learner.fit(dealt(assembler.transform(train), train.count()))])


def staged_counter(arrays, levels: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``x, actual`` to counts ``n_trees, level, pos, neg`` of the scores by each prefix of the trees.

    A task holds two numbers for each tree and level, and adds to them in place. Where these are more
    than ``DENSE_LEVELS`` times ``HELD_LEVELS``, counts are merged as they come and sent on once ``HELD_LEVELS`` are held.
    """
    n_codes = len(arrays[4]) * (levels + 1)

    def merged(codes: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        distinct, which = np.unique(codes, return_inverse=True)
        sums = [np.bincount(which, v, len(distinct)).astype(np.int64) for v in (pos, neg)]
        return distinct, *sums

    def out(codes: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> pa.RecordBatch:
        columns = [(codes // (levels + 1) + 1).astype(np.int32), codes % (levels + 1), pos, neg]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["n_trees", "level", "pos", "neg"])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Codes of tree and level of the rows of a batch, and whether the rows are of class 1."""
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = in_space("p", partial(staged_margins, arrays), matrix_of(batch.column("x")))
            codes = np.arange(scores.shape[1]) * (levels + 1) + np.floor(scores * levels).astype(np.int64)
            yield codes, batch.column("actual").to_numpy(zero_copy_only=False).astype(np.int64)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = np.zeros(2 * n_codes, np.int64)
        for codes, actual in coded(batches):
            np.add.at(sides, (codes + n_codes * actual[:, None]).ravel(), 1)
        neg, pos = sides[:n_codes], sides[n_codes:]
        found = np.flatnonzero(pos + neg)
        if len(found):
            yield out(found, pos[found], neg[found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for codes, actual in coded(batches):
            actual = np.repeat(actual, codes.shape[1])
            parts = (codes.ravel(), actual, 1 - actual)
            held = list(merged(*[np.concatenate(v) for v in zip(held, parts, strict=True)]))
            if len(held[0]) > HELD_LEVELS:
                yield out(*held)
                held = [np.zeros(0, np.int64)] * 3
        if len(held[0]):
            yield out(*held)

    return dense if n_codes <= DENSE_LEVELS * HELD_LEVELS else run


def staged_areas(rows: DataFrame, ensemble: Ensemble, label: str = LABEL, levels: int = SCORE_LEVELS) -> DataFrame:
    """``(n_trees, auc_roc, auc_pr, average_precision)`` of the ensemble's first tree, first two, and so on.

    One pass over ``rows`` (with ``x``): the margins of all prefixes are running sums over
    the trees of a row. Scores tie at a resolution of ``levels`` steps of the probability, so a
    prefix is at most ``levels + 1`` counts, which are merged before they are shuffled.
    """
    arrays = ensemble.margin_arrays()
    given = rows.select("x", (F.col(label) == 1).alias("actual"))
    counts = given.mapInArrow(staged_counter(arrays, levels), "n_trees int, level long, pos long, neg long")
    merged = counts.groupBy("n_trees", "level").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    down = Window.partitionBy("n_trees").orderBy(F.desc("level"))
    curve = merged.select("*", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"))
    return areas_of(curve, ("n_trees",))


def best_prefix(areas: list[float | None], patience: int) -> int:
    """How many trees to keep: the best so far when ``patience`` more have not bettered it, or all have been seen."""
    best, most = 1, -1.0
    for n, area in enumerate(areas, 1):
        if area is not None and area > most:
            best, most = n, area
        elif n - best >= patience:
            break
    return best


def fit_with_early_stopping(
    train: DataFrame,
    features: list[str],
    validation: str = "is_validation",
    patience: int = 5,
    metric: str = "auc_pr",
    label: str = LABEL,
    **params,
) -> tuple[PipelineModel, DataFrame]:
    """The trees before the first ``patience`` that do not better ``metric`` on the marked rows, and all areas.

    The learner cannot be stopped from outside, so all trees are fitted on the unmarked
    rows, every prefix is measured in one pass over the marked ones, and the model is cut
    to the chosen prefix. One row a tree reaches the driver.
    """
    spark = train.sparkSession
    model = fit_booster(train.where(~F.col(validation)), features, label, **params)
    path = save_model(model, fresh_path(spark, "model"))
    held_out = vectorize(train.where(validation), features, (label,))
    areas = materialize(staged_areas(held_out, load_ensemble(spark, path, model), label), "staged-areas")
    found = [r[metric] for r in areas.orderBy("n_trees").collect()]
    return first_trees(spark, path, best_prefix(found, patience)), areas


def parameter_grid(booster: GBTClassifier, values: dict[str, list]) -> list[dict]:
    """Every combination of the given values, by either naming; shares of columns become text."""
    builder = ParamGridBuilder()
    for name, options in values.items():
        if name in GRID_REFUSED:
            raise ValueError(f"{name} has no counterpart: Spark's trees put no penalty on leaf values")
        param = booster.getParam(GRID_NAMES.get(name, name))
        builder = builder.addGrid(param, [str(v) for v in options] if param.name == "featureSubsetStrategy" else options)
    return builder.build()


class StoredFoldSearch(CrossValidator):
    """A search whose folds are read from one stored table of assembled rows; its estimator is assembler and learner.

    Nothing is cached for a fold, and settings are fitted side by side only as far as
    ``SIDE_ROWS`` allows: a learner holds some 300 bytes a row while it runs, and one
    fit of that many rows keeps all cores at work.
    """

    def _fit(self, dataset: DataFrame) -> CrossValidatorModel:
        assembler, learner = self.getEstimator().getStages()
        settings, judge, fold = self.getEstimatorParamMaps(), self.getEvaluator(), self.getFoldCol()
        columns = [learner.getFeaturesCol(), learner.getLabelCol()]
        n_rows = dataset.count()
        rows = materialize(dealt(assembler.transform(dataset).select(*columns, fold), n_rows), "fold-rows")
        found = {r[fold] for r in rows.select(fold).distinct().limit(self.getNumFolds() + 1).collect()}
        if found != set(range(self.getNumFolds())):
            raise ValueError(f"every fold from 0 to {self.getNumFolds() - 1} needs rows, and no others may be; found {found}")
        scores, kept = [], []

        def judged(i: int, setting: dict) -> tuple[float, PipelineModel]:
            model = learner.fit(rows.where(F.col(fold) != i).select(*columns), setting)
            return judge.evaluate(model.transform(rows.where(F.col(fold) == i))), PipelineModel([assembler, model])

        with ThreadPool(max(1, min(self.getParallelism(), SIDE_ROWS // n_rows))) as pool:
            for i in range(self.getNumFolds()):
                task = inheritable_thread_target(rows.sparkSession)(partial(judged, i))
                fitted = pool.map(task, settings, chunksize=1)
                scores.append([score for score, _ in fitted])
                kept.append([model for _, model in fitted])
        means, spreads = np.mean(scores, axis=0), np.std(scores, axis=0)
        best = int(np.argmax(means) if judge.isLargerBetter() else np.argmin(means))
        model = PipelineModel([assembler, learner.fit(rows.select(*columns), settings[best])])
        subs = kept if self.getCollectSubModels() else None
        return self._copyValues(CrossValidatorModel(model, means.tolist(), subs, spreads.tolist()))


def tune_booster(
    train: DataFrame,
    features: list[str],
    grid: dict[str, list],
    folds: int = 3,
    seed: int = 42,
    parallelism: int = 4,
    label: str = LABEL,
    key: str = KEY,
    keep_models: bool = False,
    **params,
) -> CrossValidatorModel:
    """Cross-validated search by exact area under PR; folds come from the row key.

    With ``keep_models`` the model of every fold and setting is kept, so that areas can be recomputed.
    """
    shared_dir(train.sparkSession)
    estimator = booster_pipeline(features, label, **params)
    search = StoredFoldSearch(
        estimator=estimator,
        estimatorParamMaps=parameter_grid(estimator.getStages()[-1], grid),
        evaluator=BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderPR", numBins=0),
        numFolds=folds,
        foldCol="fold",
        parallelism=parallelism,
        collectSubModels=keep_models,
    )
    return search.fit(with_fold(train, folds, seed, key))


def with_class_probabilities(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``p0``, ``p1`` and the predicted class, the likelier one at the default threshold."""
    return scored.select(
        "*",
        (1 - F.col("p")).alias("p0"),
        F.col("p").alias("p1"),
        (F.col("p") > threshold).cast("int").alias("prediction"),
    )


def with_decision(scored: DataFrame, threshold: float = 0.8) -> DataFrame:
    return scored.withColumn("flagged", F.col("p") >= threshold)


def with_balanced_weight(df: DataFrame, label: str = LABEL, to: str = "weight") -> DataFrame:
    """Row weight ``n / (2 n_class)``; one count per class reaches the driver, ``MOST_LABELS`` at most."""
    found = df.groupBy(label).count().limit(MOST_LABELS + 1).collect()
    if len(found) > MOST_LABELS:
        raise ValueError(f"{label!r} has more than {MOST_LABELS} values; a label is wanted")
    sizes = {r[label]: r["count"] for r in found}
    total = float(sum(sizes.values()))
    weight = F.lit(None).cast("double")
    for value, n in sizes.items():
        weight = F.when(F.col(label) == value, F.lit(total / (2.0 * n))).otherwise(weight)
    return df.withColumn(to, weight)


def fit_simple_model(
    train: DataFrame, features: list[str], kind: str = "logistic", label: str = LABEL
) -> PipelineModel:
    """Balanced logistic regression, or a balanced tree of depth 3, on plain columns.

    ``regParam = 1 / n`` is an L2 penalty with unit strength on the summed loss. The
    regression stops after 100 rounds, next to the optimum (see ``certificates.loss_slopes``).
    Features with next to no variation (squared deviations summing to less than
    1e-9) are left out of the regression: under that penalty they could move no
    margin by more than about ``1e-9 sqrt(n)``, but the learner divides the penalty by
    their variance and would stop at zero.
    """
    if kind == "logistic":
        rows = {r["column"]: r for r in describe(train, features).collect()}
        total = {f: (rows[f]["n"] - 1) * (rows[f]["stddev"] or 0.0) ** 2 for f in rows}
        features = [f for f in features if total.get(f, 0.0) > 1e-9] or features[:1]
        penalty = 1.0 / max(r["n"] for r in rows.values())
        learner = LogisticRegression(
            labelCol=label, weightCol="weight", standardization=False, regParam=penalty
        )
    elif kind == "tree":
        learner = DecisionTreeClassifier(labelCol=label, weightCol="weight", maxDepth=3, seed=42)
    else:
        raise ValueError(f"unknown model: {kind}; use 'logistic' or 'tree'")
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    return Pipeline(stages=[assembler, learner]).fit(with_balanced_weight(train, label))


def score_model(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``p`` and ``prediction`` of any fitted classification pipeline."""
    return model.transform(df).withColumn("p", vector_to_array("probability")[1])


def score_models(fitted: list[PipelineModel], df: DataFrame) -> DataFrame:
    """``p``: an array of each fitted pipeline's probability, in one pass; all share the first one's assembler."""
    scored = fitted[0].stages[0].transform(df)
    for i, model in enumerate(fitted):
        names = {"rawPredictionCol": f"__raw_{i}", "probabilityCol": f"__p_{i}", "predictionCol": f"__guess_{i}"}
        own = model.stages[-1]
        scored = own.transform(scored, {own.getParam(k): v for k, v in names.items()}).drop(f"__guess_{i}")
    return scored.withColumn("p", F.array(*[vector_to_array(f"__p_{i}")[1] for i in range(len(fitted))]))


def coefficient_importance(
    model: PipelineModel, df: DataFrame, features: list[str]
) -> DataFrame:
    """``(feature, importance)``: absolute logistic coefficients, 0 for features left out."""
    fitted = dict(zip(model.stages[0].getInputCols(), model.stages[-1].coefficients))
    rows = [(f, abs(float(fitted.get(f, 0.0)))) for f in features]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")

