"""Queries that count where trained models, reports and estimates disagree with another computation.

What a learner gives cannot be stated in SQL; that it disagrees nowhere can.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plumbline.functions.arrays import vectorize
from plumbline.operators import certificates, discriminate, fidelity, metrics, modeling, profiling, sampling, shapley
from plumbline.operators import stability as stab
from plumbline.operators.modeling import SCORE_LEVELS
from plumbline.plans import report
from plumbline.plans.catalog import (
    BOOSTER,
    Boosted,
    Linear,
    searched,
    stopped_early,
    stored,
    trained_path,
    training_results,
)
from plumbline.plans.standin import FEATURES, transactions, transactions_dirty
from plumbline.sources import models
from plumbline.sources.shared import materialize

CHECKS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def check(fn):
    CHECKS[fn.__name__] = fn
    return fn


def _differ(a: Column, b: Column, by: float = 1e-9) -> Column:
    """Whether two numbers differ, or only one of them is known."""
    return F.coalesce(F.abs(a - b) > by, a.isNull() != b.isNull())


def _count(spark: SparkSession, off: int) -> DataFrame:
    return spark.createDataFrame([(off,)], "n_off long")


@check
def booster_fit_check(spark, sf_dir):
    """Leaves whose value is not the mean of what their training rows wanted, over all trees."""
    path = trained_path(spark, sf_dir)
    train = sampling.with_split(stored(transactions, spark, sf_dir), 0.8).where("is_train")
    ensemble = models.load_ensemble(spark, path)
    means = certificates.leaf_means(vectorize(train, FEATURES), ensemble)
    off = _differ(F.col("value"), F.col("mean"), 1e-6)
    return means.agg(F.count_distinct("tree").alias("n_trees"), F.count_if(off).alias("n_off"))


@check
def early_stopping_check(spark, sf_dir):
    """Whether the rule, stated with windows, chooses the same prefix, and the cut model scores like that prefix."""
    model, areas, held_out = stopped_early(spark, sf_dir)
    kept = model.stages[-1].getNumTrees
    seen = Window.orderBy("n_trees").rowsBetween(Window.unboundedPreceding, 0)
    best = F.max_by("n_trees", F.struct(F.col("auc_pr"), -F.col("n_trees"))).over(seen)
    steps = areas.withColumn("best", best).withColumn("over", F.col("n_trees") - F.col("best") >= 5)
    stop = F.coalesce(F.min(F.when(F.col("over"), F.col("n_trees"))), F.max("n_trees"))
    chosen = steps.join(F.broadcast(steps.agg(stop.alias("n_trees"))), "n_trees").first()["best"]
    score = F.floor(F.col("p") * SCORE_LEVELS) / SCORE_LEVELS
    cut = metrics.curve_areas(modeling.score_model(model, held_out).withColumn("p", score)).first()
    row = areas.where(F.col("n_trees") == kept).first()
    off = sum(abs(cut[c] - row[c]) > 1e-9 for c in ("auc_roc", "auc_pr", "average_precision"))
    return spark.createDataFrame([(BOOSTER["maxIter"], int(chosen != kept), off)], "n_fitted int, n_other_prefix int, n_off int")


@check
def cross_validation_check(spark, sf_dir):
    """Settings whose mean area over the folds differs from that of the folds' own models, scored again."""
    model, train = searched(spark, sf_dir)
    rows = materialize(sampling.with_fold(train, 3), "folds")
    areas = []
    for fold, subs in enumerate(model.subModels):
        scored = materialize(modeling.score_models(subs, rows.where(F.col("fold") == fold)).select("Class", "p"), "scored-folds")
        each = [scored.select("Class", F.col("p")[i].alias("p")) for i in range(len(subs))]
        areas.append([metrics.curve_areas(s).first()["auc_pr"] for s in each])
    off = sum(abs(sum(found) / len(found) - mean) > 1e-9 for found, mean in zip(zip(*areas), model.avgMetrics, strict=True))
    sizes = rows.groupBy("fold").agg(F.count("*").alias("n_rows"))
    return sizes.select("fold", "n_rows", F.lit(len(model.avgMetrics)).alias("n_settings"), F.lit(int(off)).alias("n_off"))


def _simple_model(spark, sf_dir, kind: str):
    """Training rows, a model of them, and how many of its held-out metrics Spark's evaluators do not give."""
    split = discriminate.split_matrix(stored(transactions, spark, sf_dir))
    model, scored = discriminate.fit_and_score(split, FEATURES, kind)
    gaps = certificates.evaluator_gaps(materialize(scored, "scored-rows"))
    return split.rows.where("is_train"), model, len(gaps)


def _metric_gaps(split: discriminate.Split, kind: str) -> int:
    """Held-out metrics of a simple model that Spark's evaluators do not give."""
    scored = materialize(discriminate.fit_and_score(split, FEATURES, kind)[1], "scored-rows")
    return len(certificates.evaluator_gaps(scored))


@check
def logistic_check(spark, sf_dir):
    """Features along which the balanced loss still slopes at the fitted regression, and metrics that differ.

    The learner stops after 100 rounds; a slope of 0.01 a deviation is far below the 0.1 to 1 of an unfitted one.
    """
    train, model, gaps = _simple_model(spark, sf_dir, "logistic")
    slopes = certificates.loss_slopes(train, model)
    off = F.coalesce(F.abs("slope") > 1e-2, F.lit(True))
    return slopes.agg(F.count_if(off).alias("n_sloping"), F.lit(gaps).cast("long").alias("n_off"))


@check
def shallow_tree_check(spark, sf_dir):
    """Leaves whose probability is not the weighted share of their rows, and metrics that differ."""
    train, model, gaps = _simple_model(spark, sf_dir, "tree")
    votes = certificates.leaf_votes(train, model)
    off = _differ(F.col("p"), F.col("vote"))
    return votes.agg(F.count_if(off).alias("n_outvoted"), F.lit(gaps).cast("long").alias("n_off"))


@check
def coefficient_importance_check(spark, sf_dir):
    """Features whose importance is not how far one unit of them moves the margin."""
    table = stored(transactions, spark, sf_dir)
    model = modeling.fit_simple_model(table, FEATURES)
    effects = certificates.unit_effects(model, table, FEATURES)
    given = {r["feature"]: r["importance"] for r in modeling.coefficient_importance(model, table, FEATURES).collect()}
    off = sum(abs(abs(effects[f]) - given[f]) > 1e-6 for f in FEATURES)
    return spark.createDataFrame([(len(given), off)], "n_features int, n_off int")


@check
def explain_by_method_check(spark, sf_dir):
    """Rows whose explanation, by either method's name, is not the one its definition asks for."""
    boosted = Boosted(spark, sf_dir)
    shap = report.get_explainer("SHAP", boosted.table, FEATURES, boosted.scorer)
    sums = F.aggregate("phi", F.lit(shap.base), lambda acc, v: acc + v)
    by_shap = boosted.scorer.score(shap.explain(boosted.rows)).select(_differ(sums, F.col("margin")).alias("off"))
    lime = report.get_explainer("lime", boosted.table, FEATURES, boosted.scorer)
    explained = lime.explain(boosted.rows)
    by_lime = explained.select((lime.refit_gap(explained) > 1e-6).alias("off"))
    parts = [rows.withColumn("method", F.lit(name)) for name, rows in (("shap", by_shap), ("lime", by_lime))]
    rows = reduce(DataFrame.unionByName, parts).groupBy("method")
    return rows.agg(F.count("*").alias("n_rows"), F.count_if("off").alias("n_off"))


def _boosted_matrix(spark, sf_dir) -> DataFrame:
    return discriminate.explanation_matrix(Boosted(spark, sf_dir).shap()[1], FEATURES)


@check
def train_on_explanations_check(spark, sf_dir):
    """Metrics of the regression on explanations that Spark's evaluators do not give."""
    return _count(spark, _metric_gaps(discriminate.split_matrix(_boosted_matrix(spark, sf_dir)), "logistic"))


@check
def discriminative_power_check(spark, sf_dir):
    """The same for both models, by model."""
    split = discriminate.split_matrix(_boosted_matrix(spark, sf_dir))
    rows = [(name, _metric_gaps(split, kind)) for name, kind in discriminate.MODELS.items()]
    return spark.createDataFrame(rows, "model string, n_off long")


@check
def model_comparison_check(spark, sf_dir):
    """Metrics that stand elsewhere in the comparison than in the models' own rows."""
    matrix = discriminate.explanation_matrix(Linear(spark, sf_dir).explained, FEATURES)
    power = materialize(discriminate.analyze_discriminative_power(matrix, FEATURES)["metrics"], "power")
    side = discriminate.compare_models(power)
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("other")) for m in discriminate.MODELS])
    again = side.select("metric", F.inline(pairs))
    both = power.join(again, ["model", "metric"], "full")
    return both.agg(F.count("*").alias("n_values"), F.count_if(_differ(F.col("value"), F.col("other"))).alias("n_off"))


@check
def raw_feature_baseline_check(spark, sf_dir):
    """Metrics of both models on explanations and on features that Spark's evaluators do not give."""
    linear = Linear(spark, sf_dir)
    inputs = {"explanations": discriminate.explanation_matrix(linear.explained, FEATURES), "features": linear.table}
    rows = []
    for name, matrix in inputs.items():
        split = discriminate.split_matrix(matrix)
        rows += [(name, model, _metric_gaps(split, kind)) for model, kind in discriminate.MODELS.items()]
    return spark.createDataFrame(rows, "inputs string, model string, n_off long")


@check
def boosted_fidelity_check(spark, sf_dir):
    """Rows whose fidelity by the replacement index differs from scoring every replaced row with the model.

    Where all impacts are rounding noise, their correlation says nothing and only the areas are compared.
    """
    boosted = Boosted(spark, sf_dir)
    explained = materialize(boosted.shap()[1], "explanations")
    folded = fidelity.analyze_fidelity(explained, boosted.scorer, boosted.stats())
    values = fidelity.replacement_values("mean", boosted.stats())
    long = fidelity.row_fidelity(fidelity.feature_impacts(explained, boosted.scorer, values))
    both = folded.join(long.select("id", F.col("aufc").alias("area"), F.col("correlation").alias("r")), "id", "full")
    noise = F.greatest("aufc", "area") < 1e-12
    off = _differ(F.col("aufc"), F.col("area")) | (~noise & _differ(F.col("correlation"), F.col("r"), 1e-6))
    return both.agg(F.count("*").alias("n_rows"), F.count_if(off).alias("n_off"))


@check
def boosted_curve_check(spark, sf_dir):
    """Steps of the booster's fidelity curves that differ from scoring the replaced rows with the model."""
    boosted = Boosted(spark, sf_dir)
    explained = materialize(boosted.shap()[1], "explanations")
    values = fidelity.replacement_values("mean", boosted.stats())
    curve = fidelity.fidelity_curve(explained, boosted.scorer, values)
    rows = fidelity.perturb_top_k(explained.withColumnRenamed("p", "before").drop("margin"), values, keep=("before",))
    long = boosted.scorer.score(rows).select("id", "k", F.pow(F.col("before") - F.col("p"), 2).alias("other"))
    both = curve.join(long, ["id", "k"], "full")
    return both.agg(F.count("*").alias("n_steps"), F.count_if(_differ(F.col("loss"), F.col("other"))).alias("n_off"))


@check
def training_report_check(spark, sf_dir):
    """Metrics of the training report that Spark's evaluators do not give for its scored rows."""
    results = training_results(spark, sf_dir)
    row = results["metrics"].first().asDict() | results["areas"].first().asDict()
    names = {"f1_score": "f1_1", "recall": "recall_1", "precision": "precision_1", "accuracy": "accuracy"}
    found = {ours: row[theirs] for ours, theirs in names.items()} | {"auc_pr": row["average_precision"]}
    return _count(spark, len(certificates.evaluator_gaps(results["scored"], found)))


@check
def explanation_report_check(spark, sf_dir):
    """Means of the report that differ from those of each analysis taken by itself."""
    boosted = Boosted(spark, sf_dir)
    means = report.explain(boosted.table, boosted.path, "shap")["means"]
    explainer, explained = boosted.shap()
    stats = boosted.stats()
    alone = [
        fidelity.analyze_fidelity(explained, boosted.scorer, stats).select("aufc", "correlation"),
        stab.analyze_stability(explained, explainer, stats["std"]).drop("id"),
    ]
    parts = []
    for rows in alone:
        wide = rows.agg(*[F.avg(F.when(~F.isnan(c), F.col(c))).alias(c) for c in rows.columns])
        pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).alias("other")) for c in rows.columns]
        parts.append(wide.select(F.inline(F.array(*pairs))))
    both = means.join(reduce(DataFrame.unionByName, parts), "metric", "full")
    return both.agg(F.count("*").alias("n_metrics"), F.count_if(_differ(F.col("mean"), F.col("other"))).alias("n_off"))


@check
def approx_distinct_counts_check(spark, sf_dir):
    """Columns whose estimated count is further from the exact one than three standard errors of the sketch."""
    table = stored(transactions_dirty, spark, sf_dir)
    exact = profiling.distinct_counts(table).select("column", F.col("n_distinct").alias("exact"))
    both = profiling.approx_distinct_counts(table).join(exact, "column", "full")
    off = F.coalesce(F.abs(F.col("n_distinct") - F.col("exact")) > F.greatest(F.lit(1.0), 0.15 * F.col("exact")), F.lit(True))
    return both.agg(F.count("*").alias("n_columns"), F.count_if(off).alias("n_off"))


@check
def boosted_importance_check(spark, sf_dir):
    """Features whose importance differs from the mean over exploded values."""
    _, explained = Boosted(spark, sf_dir).shap()
    explained = materialize(explained, "explanations")
    long = shapley.long_values(explained, FEATURES).groupBy("feature").agg(F.avg(F.abs("phi")).alias("other"))
    both = shapley.global_importance(explained, FEATURES).join(long, "feature", "full")
    off = _differ(F.col("importance"), F.col("other"), 1e-7)
    return both.agg(F.count("*").alias("n_features"), F.count_if(off).alias("n_off"))
