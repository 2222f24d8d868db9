"""Discriminative power: how well simple models recover the label from explanations alone."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from plumbline.functions.arrays import KEY, LABEL
from plumbline.operators.metrics import positive_class_metrics
from plumbline.operators.modeling import coefficient_importance, fit_simple_model, score_model
from plumbline.operators.sampling import with_stratified_split
from plumbline.sources.shared import materialize

# Names of the metrics and models in the reference's results.
METRICS = ("f1_score", "auc_pr", "recall", "precision", "accuracy")
MODELS = {"logistic_regression": "logistic", "decision_tree": "tree"}


def explanation_matrix(
    explained: DataFrame, features: list[str], keep: tuple[str, ...] = (KEY, LABEL)
) -> DataFrame:
    """One column per feature from the importance array; absent features are 0."""
    return explained.select(
        *keep,
        *[F.coalesce(F.col("phi")[j], F.lit(0.0)).alias(f) for j, f in enumerate(features)],
    )


def pivot_explanations(
    long: DataFrame, features: list[str], value: str = "phi", key: str = KEY
) -> DataFrame:
    """Long rows ``(id, feature, value)`` to one column per feature; absent features are 0."""
    wide = long.groupBy(key).pivot("feature", features).agg(F.first(value))
    return wide.na.fill(0.0, subset=features)


def _zero_metrics(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(m, 0.0) for m in METRICS], "metric string, value double"
    )


@dataclass
class Split:
    """Stored rows with ``is_train``, and the sizes of both classes, counted once for all models."""

    rows: DataFrame
    positives: int
    others: int

    @property
    def usable(self) -> bool:
        """Whether both classes have at least two rows."""
        return min(self.positives, self.others) > 1


def split_matrix(
    matrix: DataFrame, ratio: float = 0.8, seed: int = 42, label: str = LABEL, key: str = KEY
) -> Split:
    """The matrix with ``is_train``, written once for the passes of fitting and scoring."""
    rows = materialize(with_stratified_split(matrix, ratio, seed, key, label), "explanation-matrix")
    is_one = F.col(label) == 1
    sizes = rows.agg(F.count_if(is_one).alias("positives"), F.count_if(~is_one).alias("others")).first()
    return Split(rows, **sizes.asDict())


def fit_and_score(
    split: Split, features: list[str], kind: str = "logistic", label: str = LABEL
) -> tuple[PipelineModel, DataFrame]:
    """A simple model of the training rows, and ``(label, p, prediction)`` of the held-out ones."""
    model = fit_simple_model(split.rows.where("is_train"), features, kind, label)
    return model, score_model(model, split.rows.where("NOT is_train")).select(label, "p", "prediction")


def train_and_evaluate(
    split: Split, features: list[str], kind: str = "logistic", label: str = LABEL
) -> tuple[DataFrame, DataFrame | None]:
    """``(metric, value)`` on the held-out part of ``split_matrix``, and coefficient
    importance for ``logistic``.

    With fewer than two usable classes all metrics are 0. The held-out rows are scored once.
    """
    if not split.usable:
        return _zero_metrics(split.rows), None
    model, scored = fit_and_score(split, features, kind, label)
    importance = coefficient_importance(model, split.rows, features) if kind == "logistic" else None
    return positive_class_metrics(scored, label=label), importance


def analyze_discriminative_power(
    matrix: DataFrame, features: list[str], seed: int = 42, label: str = LABEL, key: str = KEY
) -> dict[str, DataFrame]:
    """``metrics`` rows ``(model, metric, value)`` of both models, and ``importance``."""
    split = split_matrix(matrix, seed=seed, label=label, key=key)
    parts, out = [], {}
    for name, kind in MODELS.items():
        metrics, coefficients = train_and_evaluate(split, features, kind, label)
        parts.append(metrics.select(F.lit(name).alias("model"), "metric", "value"))
        if coefficients is not None:
            out["importance"] = coefficients
    return {"metrics": reduce(DataFrame.unionByName, parts), **out}


def compare_models(metrics: DataFrame) -> DataFrame:
    """``(metric, logistic_regression, decision_tree)`` side by side."""
    return metrics.groupBy("metric").pivot("model", list(MODELS)).agg(F.first("value"))
