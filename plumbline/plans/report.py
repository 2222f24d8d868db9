"""The three jobs end to end: analyze a table, train a model, explain and grade it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from plumbline.functions.arrays import (
    KEY,
    LABEL,
    feature_columns,
    numeric_columns,
    unpivot_columns,
    vectorize,
)
from plumbline.functions.guards import drop_nan
from plumbline.operators import cleaning, discriminate, fidelity, metrics, modeling, profiling
from plumbline.operators import stability as stab
from plumbline.operators.sampling import first_rows, with_split
from plumbline.operators.shapley import TreeShap, global_importance
from plumbline.operators.surrogate import Lime
from plumbline.sources.models import load_ensemble, load_model, save_model
from plumbline.sources.shared import fresh_path, materialize, scratch
from plumbline.sources.tables import write_table


def analyze(df: DataFrame, label: str = LABEL, correlation_threshold: float = 0.5) -> dict[str, DataFrame]:
    """Every profile of a table, as lazy DataFrames by name."""
    numeric = numeric_columns(df)
    return {
        "columns": profiling.column_profile(df),
        "classes": profiling.class_distribution(df, label),
        "statistics": profiling.describe_with_quartiles(df, numeric),
        "values": profiling.value_distribution(df),
        "correlations": profiling.pairwise_correlation(df, numeric),
        "strong_correlations": profiling.strong_correlations(df, numeric, correlation_threshold),
        "histograms": profiling.histogram_by_class(df, numeric, label),
        "boxes": profiling.box_by_class(df, numeric, label),
        "scatter": profiling.scatter_bins(df, numeric, label),
    }


def saved(job: Callable[..., dict], df: DataFrame, folder: str, *args, **settings) -> dict[str, str]:
    """Run ``analyze``, ``train`` or ``explain`` and write every table it returns below ``folder``.

    Intermediate tables of the job are deleted once the results are written.
    """
    with scratch(df.sparkSession):
        results = job(df, *args, **settings)
        return save_statistics({k: v for k, v in results.items() if isinstance(v, DataFrame)}, folder)


def save_statistics(results: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Each table to its own parquet folder; returns the paths."""
    return {name: write_table(df, f"{folder}/{name}.parquet") for name, df in results.items()}


def train(
    df: DataFrame,
    path: str,
    ratio: float = 0.8,
    seed: int = 42,
    grid: dict[str, list] | None = None,
    clean: bool = True,
    patience: int | None = None,
    validation: float = 0.2,
    label: str = LABEL,
    key: str = KEY,
    **params,
) -> dict[str, DataFrame | PipelineModel | str]:
    """Clean, split, fit (or tune), score the held-out rows once, and save the model to ``path``.

    With ``patience`` a share ``validation`` of the training rows is kept aside, and the
    trees after the best prefix are cut when that many more did not better it; ``stages``
    then holds the areas of all prefixes.
    """
    if grid and patience:
        raise ValueError("a search and early stopping at once are not supported; stop the chosen setting early")
    rows = cleaning.clean(df) if clean else df
    marked = with_split(with_split(rows, ratio, seed, key), ratio * (1 - validation), seed, key, "is_fitted")
    rows = materialize(marked, "training-rows")
    features = [f for f in feature_columns(rows, label, key) if f not in ("is_train", "is_fitted")]
    train_rows, stages = rows.where("is_train"), {}
    if grid:
        model = modeling.tune_booster(train_rows, features, grid, label=label, key=key, **params).bestModel
    elif patience:
        held_out = train_rows.withColumn("is_validation", ~F.col("is_fitted"))
        model, areas = modeling.fit_with_early_stopping(held_out, features, patience=patience, label=label, **params)
        stages = {"stages": areas}
    else:
        model = modeling.fit_booster(train_rows, features, label, **params)
    save_model(model, path)
    scored = materialize(
        modeling.score_model(model, rows.where("NOT is_train")).select(key, label, "p", "prediction"),
        "scored-rows",
    )
    confusion = metrics.confusion_counts(scored, label=label)
    return {
        "model": model,
        "path": path,
        "scored": scored,
        "confusion": confusion,
        "metrics": metrics.class_metrics(confusion),
        "areas": metrics.curve_areas(scored, label=label),
        **stages,
    }


def get_explainer(method: str, df: DataFrame, features: list[str], scorer, **settings):
    """Explainer by name (``shap`` or ``lime``, any case); both add a ``phi`` array."""
    name = method.lower()
    if name == "shap":
        return TreeShap(scorer.ensemble)
    if name == "lime":
        return Lime.fit(df, features, scorer, **settings)
    raise ValueError(f"no explainer is called {method!r}; choose shap or lime")


def load_scorer(spark, path: str) -> modeling.GBTScorer:
    model = load_model(path)
    return modeling.GBTScorer(model, load_ensemble(spark, path, model))


def metric_means(rows: DataFrame, names: list[str]) -> DataFrame:
    """``(metric, mean, n, n_undefined)``: undefined rows are counted apart from the mean."""
    wide = rows.agg(
        *[
            F.struct(
                F.lit(c).alias("metric"),
                F.avg(drop_nan(F.col(c))).alias("mean"),
                F.count(drop_nan(F.col(c))).alias("n"),
                F.count_if(F.col(c).isNull() | F.isnan(c)).alias("n_undefined"),
            ).alias(f"m_{c}")
            for c in names
        ]
    )
    return wide.select(F.inline(F.array(*[f"m_{c}" for c in names])))


def score_histograms(rows: DataFrame, names: list[str], bins: int = 20) -> DataFrame:
    """``(metric, bucket, n)`` of per-row scores."""
    return profiling.histograms(unpivot_columns(rows, names, [], "metric"), "metric", [], bins)


def explain(
    df: DataFrame,
    path: str,
    method: str = "shap",
    features: list[str] | None = None,
    n: int | None = None,
    repetitions: int = 5,
    seed: int = 42,
    threshold: float = 0.8,
    predictions: str | None = None,
    label: str = LABEL,
    key: str = KEY,
    **settings,
) -> dict[str, DataFrame]:
    """Explain every row (or the first ``n`` by key) with a saved model and grade the explanations.

    Explanations are computed once and written to the shared folder; fidelity,
    stability and discriminative power all read that table. A row's scores are folded side by
    side in the task that holds it, so nothing is joined. ``predictions`` of the result are
    the rows' probabilities and whether they reach ``threshold``; a path of that name
    has them written there, as CSV or parquet by its ending.
    """
    spark = df.sparkSession
    scorer = load_scorer(spark, path)
    features = features or scorer.ensemble.features
    stats = modeling.stat_vectors(df, features)
    explainer = get_explainer(method, df, features, scorer, **settings)
    chosen = df if n is None else first_rows(df, n, key)
    rows = vectorize(chosen, features, (key, label))
    explained = materialize(scorer.score(explainer.explain(rows)).drop("margin"), "explanations")
    curve = fidelity.mean_curve(
        fidelity.fidelity_curve(
            explained, scorer, fidelity.replacement_values("median", stats), key=key
        )
    )
    rows = explained.select(
        key,
        fidelity.fidelity_of(explained, scorer, stats).alias("f"),
        stab.stability_of(explained, explainer, stats["std"], repetitions=repetitions, seed=seed, key=key).alias("s"),
    )
    scores = rows.where("f.n > 0").select(key, "f.aufc", "f.correlation", "s.*")
    scores = materialize(scores, "explanation-scores")
    names = ["aufc", "correlation", "cosine", *[f"jaccard_{k}" for k in stab.TOP_K]]
    power = discriminate.analyze_discriminative_power(
        discriminate.explanation_matrix(explained, features, (key, label)), features, seed, label, key
    )
    decided = modeling.with_decision(explained, threshold).select(key, "p", "flagged")
    if predictions:
        write_table(decided, predictions)
    return {
        "explanations": explained,
        "predictions": decided,
        "importance": global_importance(explained, features),
        "scores": scores,
        "means": metric_means(scores, names),
        "histograms": score_histograms(scores, names),
        "fidelity_curve": curve,
        **{f"discriminative_{k}": v for k, v in power.items()},
    }


def report_summary(results: dict[str, DataFrame], method: str) -> DataFrame:
    """All means of one report as ``(method, part, metric, value)``."""
    parts = [
        results["means"].select(F.lit("rows").alias("part"), "metric", F.col("mean").alias("value")),
        results["discriminative_metrics"].select(F.col("model").alias("part"), "metric", "value"),
    ]
    return reduce(DataFrame.unionByName, parts).select(
        F.lit(method).alias("method"), "part", "metric", "value"
    )


def trained_model_path(df: DataFrame, features: list[str], label: str = LABEL, **params) -> str:
    """Fit on the train side of ``df`` and return where the model was saved."""
    rows = with_split(df, 0.8).where("is_train").drop("is_train")
    return save_model(
        modeling.fit_booster(rows, features, label, **params), fresh_path(df.sparkSession, "model")
    )
