"""Classification metrics as aggregates; every result is a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.arrays import LABEL
from plumbline.functions.guards import ratio
from plumbline.sources.shared import materialize


def prediction_label_pairs(
    scored: DataFrame, prediction: str = "prediction", label: str = LABEL
) -> DataFrame:
    return scored.select(
        F.col(prediction).cast("double").alias("prediction"),
        F.col(label).cast("double").alias("label"),
    )


def confusion_counts(
    scored: DataFrame, prediction: str = "prediction", label: str = LABEL
) -> DataFrame:
    """One row ``(tn, fp, fn, tp)``; absent cells are 0."""
    actual, guess = F.col(label) == 1, F.col(prediction) == 1
    return scored.agg(
        F.count_if(~actual & ~guess).alias("tn"),
        F.count_if(~actual & guess).alias("fp"),
        F.count_if(actual & ~guess).alias("fn"),
        F.count_if(actual & guess).alias("tp"),
    )


def score_counts(
    scored: DataFrame, prediction: str = "prediction", score: str = "p", label: str = LABEL
) -> DataFrame:
    """``(score, actual, guess, n)``, written once: all that metrics and curves need of scored rows.

    ``scored`` is executed once here and not again, whatever is read from the counts. Rows
    are counted in the map tasks, so a score that a third of them share is one row a task.
    """
    counts = scored.groupBy(
        F.col(score).alias("score"), (F.col(label) == 1).alias("actual"), (F.col(prediction) == 1).alias("guess")
    ).agg(F.count("*").alias("n"))
    return materialize(counts, "score-counts")


def counted_confusion(counts: DataFrame) -> DataFrame:
    """``confusion_counts`` from ``score_counts``."""
    cells = {"tn": "NOT actual AND NOT guess", "fp": "NOT actual AND guess", "fn": "actual AND NOT guess", "tp": "actual AND guess"}
    return counts.agg(*[F.coalesce(F.sum(F.when(F.expr(w), F.col("n"))), F.lit(0)).alias(c) for c, w in cells.items()])


def counted_areas(counts: DataFrame) -> DataFrame:
    """``curve_areas`` from ``score_counts``."""
    known = counts.where(F.col("score").isNotNull() & ~F.isnan("score"))

    def total(of: Column) -> Column:
        return F.sum(F.when(of, F.col("n")).otherwise(0))

    sides = known.groupBy("score").agg(total(F.col("actual")).alias("pos"), total(~F.col("actual")).alias("neg"))
    return areas_of(running_curve(sides))


def confusion_matrix(
    scored: DataFrame, prediction: str = "prediction", label: str = LABEL
) -> DataFrame:
    """Rows ``(actual, predicted, n)`` of the full 2x2 matrix."""
    cells = [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    return confusion_counts(scored, prediction, label).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(a).alias("actual"), F.lit(g).alias("predicted"), F.col(c).alias("n")
                    )
                    for a, g, c in cells
                ]
            )
        )
    )


def class_metrics(confusion: DataFrame) -> DataFrame:
    """Precision, recall and F1 of both labels, weighted F1 and accuracy, from the four counts.

    0 where a denominator is 0.
    """
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    total = tn + fp + fn + tp
    f1_0 = ratio(2 * tn, 2 * tn + fp + fn, 0.0)
    f1_1 = ratio(2 * tp, 2 * tp + fp + fn, 0.0)
    return confusion.select(
        ratio(tn, tn + fn, 0.0).alias("precision_0"),
        ratio(tp, tp + fp, 0.0).alias("precision_1"),
        ratio(tn, tn + fp, 0.0).alias("recall_0"),
        ratio(tp, tp + fn, 0.0).alias("recall_1"),
        f1_0.alias("f1_0"),
        f1_1.alias("f1_1"),
        ratio((tn + fp) * f1_0 + (tp + fn) * f1_1, total, 0.0).alias("f1_weighted"),
        ratio(tn + tp, total, 0.0).alias("accuracy"),
    )


def score_curve(scored: DataFrame, score: str = "p", label: str = LABEL) -> DataFrame:
    """``(score, pos, neg, tp, fp)``: counts at and running counts down to each distinct score.

    Scores are any numbers and tie only when equal; null and NaN scores are left out.
    """
    counts = (
        scored.where(F.col(score).isNotNull() & ~F.isnan(score))
        .groupBy(F.col(score).alias("score"))
        .agg(
            F.count_if(F.col(label) == 1).alias("pos"),
            F.count_if(F.col(label) != 1).alias("neg"),
        )
    )
    return running_curve(counts)


def running_curve(counts: DataFrame) -> DataFrame:
    """``(score, pos, neg, tp, fp)`` from distinct ``(score, pos, neg)``.

    Scores are dealt into ranges of about equally many of them; running counts are taken
    inside a range and shifted by the totals of the ranges above. The ranges are
    written once, so that both steps see the same ones.
    """
    ranges = counts.repartitionByRange(F.desc("score")).withColumn("interval", F.spark_partition_id())
    counts = materialize(ranges, "score-ranges")
    above = Window.orderBy("interval").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        counts.groupBy("interval")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .select(
            "interval",
            F.coalesce(F.sum("pos").over(above), F.lit(0)).alias("tp_above"),
            F.coalesce(F.sum("neg").over(above), F.lit(0)).alias("fp_above"),
        )
    )
    inside = Window.partitionBy("interval").orderBy(F.desc("score"))
    return counts.join(F.broadcast(shifts), "interval").select(
        "score",
        "pos",
        "neg",
        (F.sum("pos").over(inside) + F.col("tp_above")).alias("tp"),
        (F.sum("neg").over(inside) + F.col("fp_above")).alias("fp"),
    )


def curve_areas(scored: DataFrame, score: str = "p", label: str = LABEL) -> DataFrame:
    """One row ``(auc_roc, auc_pr, average_precision)``.

    ``auc_pr`` joins the points by straight lines and starts flat at the first
    point's precision; ``average_precision`` is the step sum. Null if a class
    is absent.
    """
    return areas_of(score_curve(scored, score, label))


def areas_of(curve: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Areas under running curves ``(by…, pos, neg, tp, fp)``, one row for each ``by``."""
    tp, fp, pos, neg = (F.col(c).cast("double") for c in ("tp", "fp", "pos", "neg"))
    before_tp, before_fp = tp - pos, fp - neg
    precision = tp / (tp + fp)
    before = F.coalesce(F.try_divide(before_tp, before_tp + before_fp), precision)
    sums = curve.groupBy(*by).agg(
        F.sum(pos).alias("p"),
        F.sum(neg).alias("n"),
        F.sum(neg * (tp + before_tp) / 2).alias("roc"),
        F.sum(pos * (precision + before) / 2).alias("pr"),
        F.sum(pos * precision).alias("ap"),
    )
    return sums.select(
        *by,
        F.try_divide("roc", F.col("p") * F.col("n")).alias("auc_roc"),
        F.try_divide(F.col("pr"), F.when(F.col("n") > 0, F.col("p"))).alias("auc_pr"),
        F.try_divide(F.col("ap"), F.col("p")).alias("average_precision"),
    )


def rank_sum_area(scored: DataFrame, score: str = "p", label: str = LABEL) -> DataFrame:
    """``by_ranks``: the area under the ROC curve as a share of ordered pairs, for checks.

    Each positive counts the negatives below it, and half of those level with it.
    """
    curve = score_curve(scored, score, label)
    totals = curve.agg(
        F.sum("pos").alias("p"),
        F.sum("neg").alias("n"),
        F.sum(F.col("pos") * F.col("fp")).alias("above"),
        F.sum(F.col("pos") * F.col("neg")).alias("level"),
    )
    pairs = (F.col("p") * F.col("n")).cast("double")
    return totals.select(F.try_divide(pairs - F.col("above") + F.col("level") / 2, pairs).alias("by_ranks"))


def positive_class_metrics(
    scored: DataFrame, prediction: str = "prediction", score: str = "p", label: str = LABEL
) -> DataFrame:
    """``(metric, value)``: F1, average precision, recall, precision and accuracy for class 1.

    The rows are scored and counted in one pass, which both the confusion and the curve read.
    """
    counts = score_counts(scored, prediction, score, label)
    at_class = class_metrics(counted_confusion(counts)).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(name).alias("metric"), F.col(c).alias("value"))
                    for name, c in (
                        ("f1_score", "f1_1"),
                        ("recall", "recall_1"),
                        ("precision", "precision_1"),
                        ("accuracy", "accuracy"),
                    )
                ]
            )
        )
    )
    area = counted_areas(counts).select(
        F.lit("auc_pr").alias("metric"),
        F.coalesce("average_precision", F.lit(0.0)).alias("value"),
    )
    return at_class.unionByName(area)
