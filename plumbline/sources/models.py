"""Fitted pipelines on disk, and their trees as a node table."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.operators.trees import Ensemble
from plumbline.sources.shared import fresh_path


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def first_trees(spark: SparkSession, path: str, n: int) -> PipelineModel:
    """The saved booster's first ``n`` trees as a pipeline of its own."""
    model = load_model(path)
    stage = f"{path.rstrip('/')}/stages/1_{model.stages[1].uid}"
    short = fresh_path(spark, "booster")
    for part, tree in (("treesMetadata", "_1"), ("data", "treeID")):
        spark.read.parquet(f"{stage}/{part}").where(F.col(tree) < n).write.parquet(f"{short}/{part}")
    about = json.loads(spark.read.text(f"{stage}/metadata").first()[0]) | {"numTrees": n}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{short}/metadata")
    return PipelineModel([model.stages[0], GBTClassificationModel.load(short)])


def model_nodes(spark: SparkSession, path: str, model: PipelineModel | None = None) -> DataFrame:
    """Tree nodes of a saved assembler + boosted-trees pipeline.

    ``(tree, weight, node, feature, threshold, left, right, cover, value)``;
    children are negative at a leaf, the cover is the training row count.
    """
    model = model or load_model(path)
    names = model.stages[0].getInputCols()
    stage = f"{path.rstrip('/')}/stages/1_{model.stages[1].uid}"
    weights = spark.read.parquet(f"{stage}/treesMetadata").select(
        F.col("_1").cast("int").alias("tree"), F.col("_3").alias("weight")
    )
    nodes = spark.read.parquet(f"{stage}/data").select(
        F.col("treeID").cast("int").alias("tree"), "nodeData.*"
    )
    leaf = F.col("leftChild") < 0
    return nodes.join(F.broadcast(weights), "tree").select(
        "tree",
        "weight",
        F.col("id").alias("node"),
        F.when(~leaf, F.get(F.array(*[F.lit(n) for n in names]), F.col("split.featureIndex"))).alias(
            "feature"
        ),
        F.when(~leaf, F.get(F.col("split.leftCategoriesOrThreshold"), F.lit(0))).alias("threshold"),
        F.col("leftChild").alias("left"),
        F.col("rightChild").alias("right"),
        F.col("rawCount").cast("double").alias("cover"),
        F.col("prediction").alias("value"),
    )


def load_ensemble(spark: SparkSession, path: str, model: PipelineModel | None = None) -> Ensemble:
    """The node table on the driver; its size is set by the model, not by the data."""
    model = model or load_model(path)
    nodes = [tuple(r) for r in model_nodes(spark, path, model).collect()]
    return Ensemble(sorted(nodes, key=lambda n: (n[0], n[2])), list(model.stages[0].getInputCols()), scale=2.0)
