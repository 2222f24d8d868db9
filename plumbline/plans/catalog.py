"""One query per operator, each over whole tables.

``QUERIES[name](spark, sf_dir)`` returns a DataFrame. Doubles are rounded to six
digits here, and only here, because sums differ in their last bits between
engines.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType

from plumbline.functions.arrays import (
    feature_columns,
    literal_array,
    literal_names,
    shuffled,
    spread,
    unpivot_array,
    unpivot_columns,
    vectorize,
)
from plumbline.functions.vectors import explode_positions
from plumbline.operators import (
    cleaning,
    discriminate,
    fidelity,
    metrics,
    modeling,
    profiling,
    sampling,
    shapley,
    stability,
    surrogate,
)
from plumbline.operators.modeling import LogisticScorer, TreeScorer
from plumbline.operators.shapley import LinearShap, TreeShap
from plumbline.operators.trees import Ensemble
from plumbline.plans import report
from plumbline.plans.standin import (
    FEATURES,
    FIXED_TREES,
    LOGISTIC_BIAS,
    LOGISTIC_WEIGHTS,
    transactions,
    transactions_dirty,
)
from plumbline.sources import models, tables
from plumbline.sources.shared import fresh_path, materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

BOOSTER = {"maxIter": 100, "maxDepth": 6}
# Sizes of the fits of the catalogue; all boosters have the first, but those of the search.
GRID = {"max_depth": [2, 4], "learning_rate": [0.1, 0.3], "min_child_weight": [1, 5]}
GRID_TREES = 5
AS_TEXT = "yyyy-MM-dd HH:mm:ss"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(
        *[
            F.round(f"`{f.name}`", digits).alias(f.name)
            if isinstance(f.dataType, DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def vectorize_columns():
    return F.array(*[F.col(c).cast("double") for c in FEATURES]).alias("x")


def tied(scored: DataFrame, digits: int = 6) -> DataFrame:
    """Scores rounded on both sides of a comparison, as their last bits differ between engines."""
    return scored.withColumn("p", F.round("p", digits))


_STORED: dict[tuple[str, str, str], DataFrame] = {}


def stored(make: Query, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in table, written once for each session and data folder."""
    slot = (spark.sparkContext.applicationId, make.__name__, sf_dir)
    if slot not in _STORED:
        _STORED[slot] = materialize(spread(make(spark, sf_dir)), "stand-in")
    return _STORED[slot]


class Linear:
    """The stand-in rows with the fixed logistic scorer and its closed-form explanations."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.table = stored(transactions, spark, sf_dir)
        self.scorer = LogisticScorer.fit(self.table, FEATURES, LOGISTIC_BIAS, LOGISTIC_WEIGHTS)
        self.stats = {"mean": self.scorer.means, "std": self.scorer.stds}
        self.explainer = LinearShap(self.scorer, FEATURES)
        self.rows = vectorize(self.table, FEATURES)

    @property
    def scored(self) -> DataFrame:
        return modeling.with_class_probabilities(self.scorer.score(self.rows))

    @property
    def explained(self) -> DataFrame:
        return self.scorer.score(self.explainer.explain(self.rows)).select(
            "id", "Class", "x", "phi", "margin", "p"
        )

    def values(self, strategy: str):
        if strategy == "median":
            self.stats |= modeling.stat_vectors(self.table, FEATURES, ("median",))
        return fidelity.replacement_values(strategy, self.stats)

    def pairs(self, strategy: str = "gaussian") -> DataFrame:
        return stability.explain_copies(
            self.explained, self.explainer, self.stats["std"], strategy=strategy
        )


_ONCE: dict[tuple, object] = {}


def once(make: Callable) -> Callable:
    """What ``make`` trains, once for each session and data folder; by the first query that needs it."""

    @functools.wraps(make)
    def kept(spark: SparkSession, sf_dir: str):
        slot = (spark.sparkContext.applicationId, make.__name__, sf_dir)
        if slot not in _ONCE:
            _ONCE[slot] = make(spark, sf_dir)
        return _ONCE[slot]

    return kept


@once
def trained_path(spark: SparkSession, sf_dir: str) -> str:
    """The saved model that most queries read."""
    return report.trained_model_path(stored(transactions, spark, sf_dir), FEATURES, **BOOSTER)


@once
def searched(spark: SparkSession, sf_dir: str):
    """The search over the grid with the models of all folds, and its rows."""
    train = sampling.hash_split(stored(transactions, spark, sf_dir))[0]
    return modeling.tune_booster(train, FEATURES, GRID, maxIter=GRID_TREES, keep_models=True), train


@once
def stopped_early(spark: SparkSession, sf_dir: str):
    """A model cut by patience, the areas of all prefixes, and the rows that decided."""
    marked = sampling.with_split(stored(transactions, spark, sf_dir), 0.8, to="keep")
    rows = materialize(marked.withColumn("is_validation", ~F.col("keep")).drop("keep"), "validation")
    model, areas = modeling.fit_with_early_stopping(rows, FEATURES, patience=5, **BOOSTER)
    return model, areas, rows.where("is_validation")


@once
def training_results(spark: SparkSession, sf_dir: str):
    """The training job at full size."""
    return report.train(stored(transactions, spark, sf_dir), fresh_path(spark, "model"), **BOOSTER)


class Boosted:
    """The stand-in rows with the trained booster."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.path = trained_path(spark, sf_dir)
        self.scorer = report.load_scorer(spark, self.path)
        self.table = stored(transactions, spark, sf_dir)
        self.rows = vectorize(self.table, FEATURES)

    def stats(self) -> dict[str, list[float]]:
        return modeling.stat_vectors(self.table, FEATURES, ("mean", "std"))

    def shap(self) -> tuple[TreeShap, DataFrame]:
        explainer = TreeShap(self.scorer.ensemble)
        return explainer, self.scorer.score(explainer.explain(self.rows))

    def lime(self) -> tuple[surrogate.Lime, DataFrame]:
        explainer = surrogate.Lime.fit(
            self.table, FEATURES, self.scorer
        )
        return explainer, explainer.explain(self.rows)


# --- sources and sinks ------------------------------------------------------------------


@query
def csv_scan(spark, sf_dir):
    table = transactions(spark, sf_dir)
    path = tables.write_table(table, fresh_path(spark, "transactions") + ".csv")
    return rounded(tables.read_table(spark, path, table.schema))


@query
def csv_scan_inferred(spark, sf_dir):
    path = tables.write_table(transactions(spark, sf_dir), fresh_path(spark, "transactions") + ".csv")
    found = tables.read_table(spark, path, infer=True)
    return rounded(found.select(F.col("id").cast("bigint").alias("id"), *FEATURES, "Class"))


@query
def parquet_scan(spark, sf_dir):
    table = tables.read_table(spark, f"{sf_dir}/orders.parquet")
    return table.withColumn("o_orderdate", F.date_format("o_orderdate", AS_TEXT))


@query
def repartitioned(spark, sf_dir):
    return rounded(tables.redistribute(transactions(spark, sf_dir), 4, "id"))


@query
def persisted(spark, sf_dir):
    """One cached table read by two jobs, and released."""
    table = spark.read.parquet(f"{sf_dir}/orders.parquet")
    cached = table.withColumn("o_orderdate", F.date_format("o_orderdate", AS_TEXT)).persist()
    n_rows = cached.count()
    result = materialize(cached.withColumn("n_rows", F.lit(n_rows).cast("bigint")), "persisted")
    cached.unpersist()
    return result


@query
def model_round_trip(spark, sf_dir):
    table = stored(transactions, spark, sf_dir)
    model = models.load_model(trained_path(spark, sf_dir))
    path = models.save_model(model, fresh_path(spark, "model"))
    before = modeling.score_model(model, table).withColumnRenamed("p", "p_before")
    both = modeling.score_model(
        models.load_model(path),
        before.drop("features", "rawPrediction", "probability", "prediction"),
    )
    return both.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.abs(F.col("p") - F.col("p_before")) > 1e-12).alias("n_changed"),
    )


@query
def model_nodes(spark, sf_dir):
    return models.model_nodes(spark, trained_path(spark, sf_dir))


@query
def model_nodes_check(spark, sf_dir):
    """Split nodes whose children's training rows do not add up to their own."""
    nodes = models.model_nodes(spark, trained_path(spark, sf_dir))
    child = nodes.select("tree", F.col("node").alias("child"), F.col("cover").alias("part"))
    splits = nodes.where("left >= 0").select("tree", "node", "cover", F.explode(F.array("left", "right")).alias("child"))
    sums = splits.join(child, ["tree", "child"]).groupBy("tree", "node", "cover").agg(F.sum("part").alias("parts"))
    return sums.agg(F.count_if(F.abs(F.col("parts") - F.col("cover")) > 1e-6).alias("n_off"))


@query
def scored_output(spark, sf_dir):
    rows = modeling.with_decision(Linear(spark, sf_dir).scored).select("id", "p", "flagged")
    path = tables.write_table(rows, fresh_path(spark, "predictions") + ".csv")
    return rounded(tables.read_table(spark, path, rows.schema))


@query
def statistics_output(spark, sf_dir):
    table = transactions(spark, sf_dir)
    paths = report.save_statistics(
        {"statistics": profiling.describe(table, FEATURES)}, fresh_path(spark, "profile")
    )
    return rounded(tables.read_table(spark, paths["statistics"]), 4)


# --- projection, filter, cleaning -------------------------------------------------------


@query
def feature_projection(spark, sf_dir):
    table = transactions(spark, sf_dir)
    return rounded(table.select(*feature_columns(table)))


@query
def column_drop(spark, sf_dir):
    return rounded(transactions(spark, sf_dir).drop("Class", "V1", "V24"))


@query
def class_filter(spark, sf_dir):
    return rounded(transactions(spark, sf_dir).where(F.col("Class") == 1))


def _dirty_columns(df: DataFrame) -> DataFrame:
    """All columns; the timestamp as text."""
    return rounded(df.withColumn("D", F.date_format("D", AS_TEXT)))


@query
def drop_missing_rows(spark, sf_dir):
    return _dirty_columns(cleaning.drop_missing(transactions_dirty(spark, sf_dir)))


@query
def drop_duplicate_rows(spark, sf_dir):
    return _dirty_columns(cleaning.drop_duplicates(transactions_dirty(spark, sf_dir)))


@query
def duplicate_report(spark, sf_dir):
    return cleaning.duplicate_report(transactions_dirty(spark, sf_dir))


@query
def drop_constant_columns(spark, sf_dir):
    return _dirty_columns(cleaning.drop_constant(stored(transactions_dirty, spark, sf_dir)))


@query
def cast_text_to_float(spark, sf_dir):
    table = cleaning.cast_text_to_float(transactions_dirty(spark, sf_dir))
    return table.select("id", *[F.col(c).cast("double").alias(c) for c in ("T", "U", "S")])


@query
def clean_table(spark, sf_dir):
    table = cleaning.clean(stored(transactions_dirty, spark, sf_dir))
    text = [F.col(c).cast("double").alias(c) for c in ("T", "U", "S")]
    return _dirty_columns(table.select("id", *FEATURES, "Class", *text, "D"))


@query
def vector_assembly(spark, sf_dir):
    table = profiling.assemble(transactions(spark, sf_dir), FEATURES)
    return rounded(profiling.disassemble(table, FEATURES))


@query
def prediction_label_pairs(spark, sf_dir):
    pairs = metrics.prediction_label_pairs(Linear(spark, sf_dir).scored)
    return pairs.groupBy("prediction", "label").agg(F.count("*").alias("n"))


# --- profiling --------------------------------------------------------------------------


@query
def column_profile(spark, sf_dir):
    table = stored(transactions_dirty, spark, sf_dir)
    return profiling.column_profile(table).select(
        "column", "pos", "type", "nullable", "n_missing", "n_distinct"
    )


@query
def class_distribution(spark, sf_dir):
    return profiling.class_distribution(transactions(spark, sf_dir))


@query
def describe_columns(spark, sf_dir):
    return rounded(profiling.describe(transactions_dirty(spark, sf_dir)), 4)


@query
def describe_with_quartiles(spark, sf_dir):
    return rounded(profiling.describe_with_quartiles(stored(transactions_dirty, spark, sf_dir)), 4)


@query
def missing_counts(spark, sf_dir):
    return profiling.missing_counts(transactions_dirty(spark, sf_dir))


@query
def distinct_counts(spark, sf_dir):
    return profiling.distinct_counts(transactions_dirty(spark, sf_dir))


@query
def approx_distinct_counts(spark, sf_dir):
    return profiling.approx_distinct_counts(transactions_dirty(spark, sf_dir))


@query
def value_distribution(spark, sf_dir):
    return profiling.value_distribution(stored(transactions_dirty, spark, sf_dir))


@query
def correlation_matrix(spark, sf_dir):
    return rounded(profiling.correlation_matrix(stored(transactions, spark, sf_dir), FEATURES))


@query
def pairwise_correlation(spark, sf_dir):
    table = stored(transactions_dirty, spark, sf_dir)
    return rounded(profiling.pairwise_correlation(table, [*FEATURES, "K"]))


@query
def strong_correlations(spark, sf_dir):
    return rounded(profiling.strong_correlations(stored(transactions, spark, sf_dir), FEATURES, 0.5))


@query
def histogram_by_class(spark, sf_dir):
    return profiling.histogram_by_class(stored(transactions, spark, sf_dir), FEATURES)


@query
def box_by_class(spark, sf_dir):
    return rounded(profiling.box_by_class(stored(transactions, spark, sf_dir), FEATURES))


@query
def outlier_counts(spark, sf_dir):
    return profiling.outlier_counts(stored(transactions, spark, sf_dir), FEATURES)


@query
def scatter_bins(spark, sf_dir):
    return profiling.scatter_bins(stored(transactions, spark, sf_dir), FEATURES)


@query
def feature_stats(spark, sf_dir):
    return rounded(profiling.feature_stats(stored(transactions, spark, sf_dir), FEATURES), 4)


# --- joins ------------------------------------------------------------------------------


@query
def join_explanations(spark, sf_dir):
    linear = Linear(spark, sf_dir)
    phi = shapley.long_values(linear.explained, FEATURES)
    values = unpivot_columns(linear.table, FEATURES, ["id"], "feature")
    joined = shuffled(values).join(shuffled(phi), ["id", "feature"])
    return rounded(joined.select("id", "feature", "value", "phi"))


@query
def join_labels(spark, sf_dir):
    linear = Linear(spark, sf_dir)
    wide = discriminate.explanation_matrix(linear.explained, FEATURES, ("id",))
    return rounded(wide.join(linear.table.select("id", "Class"), "id"))


@query
def join_feature_stats(spark, sf_dir):
    table = stored(transactions, spark, sf_dir)
    stats = F.broadcast(profiling.feature_stats(table, FEATURES))
    values = unpivot_columns(table, FEATURES, ["id"], "feature")
    return rounded(values.join(stats, "feature").select("id", "feature", "value", "mean", "median", "std"))


@query
def align_explanations(spark, sf_dir):
    linear = Linear(spark, sf_dir)
    copies = linear.pairs()
    original = shapley.long_values(linear.explained, FEATURES)
    noisy = unpivot_array(copies, "phi", FEATURES, ["id", "rep"], "phi")
    aligned = stability.align_explanations(original, noisy, FEATURES)
    rows = aligned.select("id", "rep", "phi_original", "phi", explode_positions("phi").alias("i", "v"))
    return rounded(
        rows.groupBy("id", "rep").agg(
            F.sum(F.col("phi_original")[F.col("i")]).alias("total_original"),
            F.sum("v").alias("total"),
            F.max(F.abs(F.col("v") - F.col("phi_original")[F.col("i")])).alias("largest_change"),
        )
    )


@query
def expand_instances(spark, sf_dir):
    """Rows x features, rows x k and rows x repetitions, counted by kind and number."""
    linear = Linear(spark, sf_dir)
    singles = fidelity.perturb_single(linear.explained, linear.values("mean"))
    tops = fidelity.perturb_top_k(linear.explained, linear.values("mean"))
    kinds = [("feature", singles, "feature_pos"), ("k", tops, "k"), ("rep", linear.pairs(), "rep")]
    parts = [df.select(F.lit(kind).alias("kind"), F.col(i).cast("int").alias("i"), "id") for kind, df, i in kinds]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("kind", "i").agg(F.count("*").alias("n"), F.sum("id").alias("id_sum"))


# --- sort, top-k ------------------------------------------------------------------------


@query
def order_by_count(spark, sf_dir):
    return profiling.order_by_count(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderpriority")


@query
def global_importance(spark, sf_dir):
    return rounded(shapley.global_importance(Linear(spark, sf_dir).explained, FEATURES))


@query
def rank_features(spark, sf_dir):
    rows = fidelity.rank_features(Linear(spark, sf_dir).explained, FEATURES)
    return rounded(rows.select("id", "rank", "feature", "phi"))


@query
def top_k_features(spark, sf_dir):
    rows = fidelity.top_k_features(Linear(spark, sf_dir).explained, FEATURES, 5)
    return rows.groupBy("id").agg(
        F.array_join(F.sort_array(F.collect_set("feature")), ",").alias("top_features")
    )


@query
def first_rows(spark, sf_dir):
    return rounded(sampling.first_rows(transactions(spark, sf_dir), 100))


# --- sampling and splits ----------------------------------------------------------------


@query
def hash_split(spark, sf_dir):
    train, test = sampling.hash_split(transactions(spark, sf_dir))
    return rounded(
        sampling.union_rows(train.withColumn("side", F.lit("train")), test.withColumn("side", F.lit("test")))
    )


@query
def validation_split(spark, sf_dir):
    marked = sampling.with_split(transactions(spark, sf_dir), ratio=0.7)
    return marked.groupBy("Class", "is_train").agg(F.count("*").alias("n"), F.sum("id").alias("id_sum"))


@query
def balanced_sample(spark, sf_dir):
    return rounded(sampling.balanced_sample(stored(transactions, spark, sf_dir)))


@query
def union_classes(spark, sf_dir):
    table = transactions(spark, sf_dir)
    fraud, rest = table.where("Class = 1"), table.where("Class = 0")
    return rounded(sampling.union_rows(fraud, rest))


@query
def stratified_split(spark, sf_dir):
    return rounded(sampling.with_stratified_split(stored(transactions, spark, sf_dir)))


@query
def fold_split(spark, sf_dir):
    return rounded(sampling.with_fold(transactions(spark, sf_dir)))


# --- models and metrics -----------------------------------------------------------------


@query
def booster_fit(spark, sf_dir):
    model = models.load_model(trained_path(spark, sf_dir))
    importances = model.stages[-1].featureImportances.toArray()
    nodes = models.model_nodes(spark, trained_path(spark, sf_dir))
    uses = nodes.where("feature IS NOT NULL").groupBy("feature").agg(F.count("*").alias("n_splits"))
    share = F.get(
        literal_array(importances), F.array_position(literal_names(FEATURES), F.col("feature")) - 1
    )
    return rounded(uses.withColumn("importance", share))


@query
def cross_validation(spark, sf_dir):
    model, _ = searched(spark, sf_dir)
    settings = [
        ", ".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda e: e[0].name))
        for m in model.getEstimatorParamMaps()
    ]
    rows = [(s, float(v)) for s, v in zip(settings, model.avgMetrics)]
    return spark.createDataFrame(rows, "setting string, area_under_pr double")


@query
def early_stopping(spark, sf_dir):
    model, _, held_out = stopped_early(spark, sf_dir)
    scored = modeling.score_model(model, held_out)
    return rounded(
        metrics.curve_areas(scored).withColumn("n_trees", F.lit(model.stages[-1].getNumTrees))
    )


@query
def staged_areas(spark, sf_dir):
    """Areas of the booster's first tree, first two, and so on, over all rows."""
    boosted = Boosted(spark, sf_dir)
    return rounded(modeling.staged_areas(boosted.rows, boosted.scorer.ensemble))


@query
def batch_score(spark, sf_dir):
    model = models.load_model(trained_path(spark, sf_dir))
    scored = modeling.score_model(model, stored(transactions, spark, sf_dir))
    return rounded(scored.select("id", "p", "prediction", "Class"))


@query
def batch_score_check(spark, sf_dir):
    """Rows whose probability by the model and by its node table differ."""
    boosted = Boosted(spark, sf_dir)
    other = boosted.scorer.ensemble.margin_arrays()
    table = stored(transactions, spark, sf_dir)
    scored = modeling.score_model(models.load_model(boosted.path), table).select("p", vectorize_columns())
    by_nodes = modeling.batch_scores(other)(F.col("x"))
    off = F.abs(F.col("p") - by_nodes) > 1e-9
    return scored.agg(F.count("*").alias("n_rows"), F.count_if(off).alias("n_off"))


@query
def booster_evaluation_check(spark, sf_dir):
    """Areas of the booster's held-out scores against rank sums and plain running counts."""
    model = models.load_model(trained_path(spark, sf_dir))
    test = sampling.hash_split(stored(transactions, spark, sf_dir))[1]
    scored = materialize(modeling.score_model(model, test).select("id", "Class", "p"), "scored-rows")
    by_ranks = metrics.rank_sum_area(scored).first()["by_ranks"]
    off = F.abs(F.col("auc_roc") - F.lit(by_ranks)) > 1e-9
    return metrics.curve_areas(scored).select(off.cast("int").alias("n_off"))


@query
def booster_evaluation(spark, sf_dir):
    model = models.load_model(trained_path(spark, sf_dir))
    test = sampling.hash_split(stored(transactions, spark, sf_dir))[1]
    scored = modeling.score_model(model, test).select("id", "Class", "p", "prediction")
    scored = materialize(scored, "scored-rows")
    confusion = metrics.class_metrics(metrics.confusion_counts(scored))
    areas = metrics.curve_areas(scored)
    return rounded(
        unpivot_columns(confusion, confusion.columns, [], "metric").unionByName(
            unpivot_columns(areas, areas.columns, [], "metric")
        )
    )


@query
def class_probabilities(spark, sf_dir):
    return rounded(Linear(spark, sf_dir).scored.select("id", "margin", "p0", "p1", "prediction"))


@query
def area_under_roc(spark, sf_dir):
    return rounded(metrics.curve_areas(tied(Linear(spark, sf_dir).scored)).select("auc_roc"))


@query
def area_under_pr(spark, sf_dir):
    return rounded(metrics.curve_areas(tied(Linear(spark, sf_dir).scored)).select("auc_pr"))


@query
def average_precision(spark, sf_dir):
    return rounded(metrics.curve_areas(tied(Linear(spark, sf_dir).scored)).select("average_precision"))


@query
def score_curve(spark, sf_dir):
    return rounded(metrics.score_curve(tied(Linear(spark, sf_dir).scored)))


@query
def f1_weighted(spark, sf_dir):
    confusion = metrics.confusion_counts(Linear(spark, sf_dir).scored)
    return rounded(metrics.class_metrics(confusion).select("f1_0", "f1_1", "f1_weighted", "accuracy"))


@query
def precision_by_label(spark, sf_dir):
    confusion = metrics.confusion_counts(Linear(spark, sf_dir).scored)
    return rounded(metrics.class_metrics(confusion).select("precision_0", "precision_1"))


@query
def recall_by_label(spark, sf_dir):
    confusion = metrics.confusion_counts(Linear(spark, sf_dir).scored)
    return rounded(metrics.class_metrics(confusion).select("recall_0", "recall_1"))


@query
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(Linear(spark, sf_dir).scored)


@query
def positive_class_metrics(spark, sf_dir):
    return rounded(metrics.positive_class_metrics(tied(Linear(spark, sf_dir).scored)))


@query
def decision_threshold(spark, sf_dir):
    return modeling.with_decision(Linear(spark, sf_dir).scored, 0.8).select("id", "flagged")


@query
def balanced_weights(spark, sf_dir):
    return rounded(
        modeling.with_balanced_weight(transactions(spark, sf_dir)).select("id", "Class", "weight")
    )


@query
def logistic_on_features(spark, sf_dir):
    split = discriminate.split_matrix(transactions(spark, sf_dir))
    return rounded(discriminate.train_and_evaluate(split, FEATURES, "logistic")[0])


@query
def shallow_tree(spark, sf_dir):
    split = discriminate.split_matrix(transactions(spark, sf_dir))
    return rounded(discriminate.train_and_evaluate(split, FEATURES, "tree")[0])


@query
def coefficient_importance(spark, sf_dir):
    table = stored(transactions, spark, sf_dir)
    return rounded(modeling.coefficient_importance(modeling.fit_simple_model(table, FEATURES), table, FEATURES))


# --- explanations -----------------------------------------------------------------------


def _fixed_trees() -> Ensemble:
    return Ensemble(FIXED_TREES, FEATURES)


@query
def tree_shap_fixed(spark, sf_dir):
    explained = TreeShap(_fixed_trees()).explain(vectorize(stored(transactions, spark, sf_dir), FEATURES))
    return rounded(explained.select("id", *[F.col("phi")[j].alias(f"phi_{f}") for j, f in enumerate(FEATURES)]))


@query
def fixed_tree_scores(spark, sf_dir):
    rows = vectorize(transactions(spark, sf_dir), FEATURES)
    return rounded(TreeScorer(_fixed_trees()).score(rows).select("id", "margin", "p"))


@query
def tree_shap(spark, sf_dir):
    _, explained = Boosted(spark, sf_dir).shap()
    return rounded(shapley.long_values(explained, FEATURES))


@query
def tree_shap_additivity(spark, sf_dir):
    explainer, explained = Boosted(spark, sf_dir).shap()
    total = F.aggregate("phi", F.lit(explainer.base), lambda acc, v: acc + v)
    off = F.abs(total - F.col("margin")) > 1e-9
    return explained.agg(F.count("*").alias("n_rows"), F.count_if(off).alias("n_off"))


@query
def linear_shap(spark, sf_dir):
    return rounded(shapley.long_values(Linear(spark, sf_dir).explained, FEATURES))


@query
def boosted_importance(spark, sf_dir):
    _, explained = Boosted(spark, sf_dir).shap()
    return rounded(shapley.global_importance(explained, FEATURES))


@query
def shap_summary(spark, sf_dir):
    return shapley.summary_bins(Linear(spark, sf_dir).explained, FEATURES)


@query
def surrogate_bins(spark, sf_dir):
    return rounded(surrogate.surrogate_bins(stored(transactions, spark, sf_dir), FEATURES), 4)


@query
def lime(spark, sf_dir):
    explainer, explained = Boosted(spark, sf_dir).lime()
    return rounded(explainer.long_values(explained))


@query
def lime_check(spark, sf_dir):
    """Rows without ten weights, and rows whose weights another solver does not find."""
    explainer, explained = Boosted(spark, sf_dir).lime()
    off = explainer.refit_gap(explained) > 1e-6
    ten = F.size(F.filter("phi", lambda v: v.isNotNull())) != 10
    return explained.select("phi", "x", "p", "explained_class").agg(
        F.count("*").alias("n_rows"), F.count_if(ten).alias("n_not_ten"), F.count_if(off).alias("n_off")
    )


@query
def lime_importance(spark, sf_dir):
    _, explained = Boosted(spark, sf_dir).lime()
    absent_as_zero = discriminate.explanation_matrix(explained, FEATURES, ("id",))
    return rounded(
        shapley.global_importance(vectorize(absent_as_zero, FEATURES, ("id",)).withColumnRenamed("x", "phi"), FEATURES)
    )


@query
def prediction_summary(spark, sf_dir):
    return rounded(surrogate.prediction_summary(Linear(spark, sf_dir).scored))


@query
def explain_by_method(spark, sf_dir):
    boosted = Boosted(spark, sf_dir)
    parts = []
    for method in ("SHAP", "lime"):
        explainer = report.get_explainer(
            method, boosted.table, FEATURES, boosted.scorer
        )
        rows = shapley.long_values(explainer.explain(boosted.rows), FEATURES)
        parts.append(rows.withColumn("method", F.lit(method.lower())))
    return rounded(parts[0].unionByName(parts[1]))


# --- fidelity ---------------------------------------------------------------------------


@query
def perturb_single(spark, sf_dir):
    linear = Linear(spark, sf_dir)
    rows = linear.scorer.score(fidelity.perturb_single(linear.explained, linear.values("mean")))
    value = F.col("x")[F.col("feature_pos") - 1].alias("value")
    return rounded(rows.select("id", "feature_pos", value, "margin"))


@query
def feature_impacts(spark, sf_dir):
    linear = Linear(spark, sf_dir)
    rows = fidelity.feature_impacts(linear.explained, linear.scorer, linear.values("mean"))
    return rounded(rows.select("id", "rank", "feature_pos", "importance", "impact"))


@query
def area_under_fidelity_curve(spark, sf_dir):
    linear = Linear(spark, sf_dir)
    rows = fidelity.analyze_fidelity(linear.explained, linear.scorer, linear.stats)
    return rounded(rows.select("id", "aufc"))


@query
def importance_correlation(spark, sf_dir):
    linear = Linear(spark, sf_dir)
    rows = fidelity.analyze_fidelity(linear.explained, linear.scorer, linear.stats)
    return rounded(rows.select("id", "correlation"))


@query
def row_fidelity(spark, sf_dir):
    linear = Linear(spark, sf_dir)
    return rounded(fidelity.analyze_fidelity(linear.explained, linear.scorer, linear.stats))


@query
def row_fidelity_margin(spark, sf_dir):
    linear = Linear(spark, sf_dir)
    return rounded(
        fidelity.analyze_fidelity(linear.explained, linear.scorer, linear.stats, space="margin")
    )


@query
def row_fidelity_zero(spark, sf_dir):
    linear = Linear(spark, sf_dir)
    return rounded(fidelity.analyze_fidelity(linear.explained, linear.scorer, linear.stats, "zero"))


@query
def row_fidelity_random(spark, sf_dir):
    linear = Linear(spark, sf_dir)
    return rounded(fidelity.analyze_fidelity(linear.explained, linear.scorer, linear.stats, "random"))


@query
def perturb_top_k(spark, sf_dir):
    linear = Linear(spark, sf_dir)
    rows = linear.scorer.score(fidelity.perturb_top_k(linear.explained, linear.values("median")))
    return rounded(rows.select("id", "k", "margin"))


@query
def fidelity_curve(spark, sf_dir):
    linear = Linear(spark, sf_dir)
    return rounded(
        fidelity.fidelity_curve(linear.explained, linear.scorer, linear.values("median"))
    )


@query
def mean_fidelity_curve(spark, sf_dir):
    linear = Linear(spark, sf_dir)
    curve = fidelity.fidelity_curve(linear.explained, linear.scorer, linear.values("median"))
    return rounded(fidelity.mean_curve(curve))


@query
def boosted_fidelity(spark, sf_dir):
    boosted = Boosted(spark, sf_dir)
    stats = boosted.stats()
    return rounded(fidelity.analyze_fidelity(boosted.shap()[1], boosted.scorer, stats))


@query
def boosted_fidelity_curve(spark, sf_dir):
    boosted = Boosted(spark, sf_dir)
    values = fidelity.replacement_values("mean", boosted.stats())
    curve = fidelity.fidelity_curve(boosted.shap()[1], boosted.scorer, values)
    return rounded(fidelity.mean_curve(curve))


@query
def lime_fidelity(spark, sf_dir):
    boosted = Boosted(spark, sf_dir)
    stats = boosted.stats()
    return rounded(fidelity.analyze_fidelity(boosted.lime()[1], boosted.scorer, stats))


# --- stability --------------------------------------------------------------------------


def _by_copy(long: DataFrame, value: str) -> DataFrame:
    """Four figures per noisy copy that depend on every entry and its position."""
    v = F.col(value)
    return rounded(
        long.groupBy("id", "rep").agg(
            F.sum(v).alias("total"),
            F.sum(v * F.col("feature_pos")).alias("weighted"),
            F.min(v).alias("least"),
            F.max(v).alias("most"),
        )
    )


def _noise(spark, sf_dir, strategy):
    linear = Linear(spark, sf_dir)
    stds = linear.stats["std"]
    rows = stability.perturb_noise(
        linear.rows.withColumn("before", F.col("x")), stds, strategy=strategy
    )
    shift = F.zip_with("x", "before", lambda a, b: a - b)
    scaled = F.zip_with(shift, literal_array(stds), lambda d, s: d / s)
    long = unpivot_array(rows.withColumn("shift", scaled), "shift", FEATURES, ["id", "rep"], "shift")
    return _by_copy(long, "shift")


@query
def gaussian_noise(spark, sf_dir):
    return _noise(spark, sf_dir, "gaussian")


@query
def uniform_noise(spark, sf_dir):
    return _noise(spark, sf_dir, "uniform")


@query
def relative_noise(spark, sf_dir):
    return _noise(spark, sf_dir, "relative")


@query
def explain_noisy_copies(spark, sf_dir):
    rows = unpivot_array(Linear(spark, sf_dir).pairs(), "phi", FEATURES, ["id", "rep"], "phi")
    return _by_copy(rows, "phi")


@query
def cosine_similarity(spark, sf_dir):
    pairs = stability.pair_stability(Linear(spark, sf_dir).pairs())
    return rounded(pairs.select("id", "rep", "cosine"))


@query
def jaccard_index(spark, sf_dir):
    pairs = stability.pair_stability(Linear(spark, sf_dir).pairs())
    return rounded(pairs.select("id", "rep", "jaccard_5", "jaccard_10", "jaccard_20"))


@query
def pair_stability(spark, sf_dir):
    return rounded(stability.pair_stability(Linear(spark, sf_dir).pairs()))


@query
def row_stability(spark, sf_dir):
    linear = Linear(spark, sf_dir)
    return rounded(
        stability.analyze_stability(linear.explained, linear.explainer, linear.stats["std"])
    )


@query
def boosted_stability(spark, sf_dir):
    boosted = Boosted(spark, sf_dir)
    explainer, explained = boosted.shap()
    stds = boosted.stats()["std"]
    return rounded(stability.analyze_stability(explained, explainer, stds))


@query
def lime_stability(spark, sf_dir):
    boosted = Boosted(spark, sf_dir)
    explainer, explained = boosted.lime()
    stds = boosted.stats()["std"]
    return rounded(stability.analyze_stability(explained, explainer, stds))


# --- discriminative power and reports ---------------------------------------------------


@query
def explanation_matrix(spark, sf_dir):
    long = shapley.long_values(Linear(spark, sf_dir).explained, FEATURES)
    return rounded(discriminate.pivot_explanations(long, FEATURES))


@query
def train_on_explanations(spark, sf_dir):
    _, explained = Boosted(spark, sf_dir).shap()
    matrix = discriminate.explanation_matrix(explained, FEATURES)
    return rounded(discriminate.train_and_evaluate(discriminate.split_matrix(matrix), FEATURES)[0])


@query
def discriminative_power(spark, sf_dir):
    _, explained = Boosted(spark, sf_dir).shap()
    matrix = discriminate.explanation_matrix(explained, FEATURES)
    return rounded(discriminate.analyze_discriminative_power(matrix, FEATURES)["metrics"])


@query
def model_comparison(spark, sf_dir):
    matrix = discriminate.explanation_matrix(Linear(spark, sf_dir).explained, FEATURES)
    power = discriminate.analyze_discriminative_power(matrix, FEATURES)
    return rounded(discriminate.compare_models(power["metrics"]))


@query
def raw_feature_baseline(spark, sf_dir):
    """The same two models on the original features, next to the explanation-trained ones."""
    linear = Linear(spark, sf_dir)
    inputs = {
        "explanations": discriminate.explanation_matrix(linear.explained, FEATURES),
        "features": linear.table,
    }
    parts = [
        discriminate.analyze_discriminative_power(m, FEATURES)["metrics"].withColumn("inputs", F.lit(n))
        for n, m in inputs.items()
    ]
    return rounded(parts[0].unionByName(parts[1]))


def _row_scores(spark, sf_dir) -> DataFrame:
    linear = Linear(spark, sf_dir)
    rows = linear.explained.select(
        "id",
        fidelity.fidelity_of(linear.explained, linear.scorer, linear.stats).alias("f"),
        stability.stability_of(linear.explained, linear.explainer, linear.stats["std"]).alias("s"),
    )
    return rows.where("f.n > 0").select("id", "f.aufc", "f.correlation", "s.*")


SCORES = ["aufc", "correlation", "cosine", "jaccard_5", "jaccard_10", "jaccard_20"]


@query
def score_histograms(spark, sf_dir):
    scores = rounded(_row_scores(spark, sf_dir))
    return report.score_histograms(scores, SCORES)


@query
def metric_means(spark, sf_dir):
    return rounded(report.metric_means(_row_scores(spark, sf_dir), SCORES))


@query
def explanation_report(spark, sf_dir):
    table = stored(transactions, spark, sf_dir)
    results = report.explain(table, trained_path(spark, sf_dir), "shap")
    return rounded(report.report_summary(results, "shap"))


@query
def lime_report(spark, sf_dir):
    path = trained_path(spark, sf_dir)
    table = stored(transactions, spark, sf_dir)
    results = report.explain(table, path, "lime")
    return rounded(report.report_summary(results, "lime"))


@query
def training_report(spark, sf_dir):
    results = training_results(spark, sf_dir)
    parts = [unpivot_columns(results[k], results[k].columns, [], "metric") for k in ("metrics", "areas")]
    return rounded(parts[0].unionByName(parts[1]))
