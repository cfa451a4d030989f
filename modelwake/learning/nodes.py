"""Fitted tree models as tables of nodes, scored and explained by joins.

A node table is data like any other: it can be stored, compared between versions, queried,
and applied to rows wherever an equi-join runs, without the model's classes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwake.functions.exprs import one_row
from modelwake.session import bounded_broadcast, scratch_path


def node_table(model, spark) -> DataFrame:
    """One row per node of a fitted forest or boosted model, read from the files it is saved in.

    tree and node number; feature (slot, -1 at a leaf), threshold (left if not above it) or
    categories (left if among them); left and right child (-1 at a leaf); prediction, gain
    and the weighted rows of the node; weight of the tree.
    """
    path = scratch_path(spark, "nodes")
    model.save(path)
    split = F.col("nodeData.split")
    is_threshold = split["numCategories"] < 0
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        F.col("nodeData.id").alias("node"),
        split["featureIndex"].alias("feature"),
        F.when(is_threshold, F.get(split["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"),
        F.when(~is_threshold, split["leftCategoriesOrThreshold"]).alias("categories"),
        F.col("nodeData.leftChild").alias("left_child"),
        F.col("nodeData.rightChild").alias("right_child"),
        F.col("nodeData.prediction").alias("prediction"),
        F.col("nodeData.gain").alias("gain"),
        F.get(F.col("nodeData.impurityStats"), F.lit(0)).alias("n_rows"),
    )
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "_metadata", "weight").drop("_metadata")
    return nodes.join(bounded_broadcast(weights, model.getNumTrees), "tree")


def leaves(vectors: DataFrame, keys: Sequence[str], vector: str, nodes: DataFrame) -> DataFrame:
    """keys, tree, prediction and weight: the leaf that every row reaches in every tree.

    One equi-join on (tree, node) per level. Node tables of up to ``BROADCAST_ROWS`` rows are
    broadcast, so all levels run in one stage over rows that never move; beyond, AQE splits
    the roots, which all rows of a task meet. ``vector`` must hold no missing values.
    """
    trees = nodes.agg(F.max("tree").alias("last"), F.count("*").alias("n")).first()
    depth = _depth(nodes)
    steps = bounded_broadcast(nodes.withColumnsRenamed({"tree": "_tree", "node": "_node"}), trees["n"])
    kept = [F.col(k) for k in keys]
    state = vectors.select(*kept, vector_to_array(vector).alias("_x")).select(
        *kept, "_x", F.explode(F.sequence(F.lit(0), F.lit(trees["last"]))).alias("tree"), F.lit(0).alias("node")
    )
    for _ in range(depth):
        met = state.join(steps, (F.col("tree") == F.col("_tree")) & (F.col("node") == F.col("_node")))
        value = F.get(F.col("_x"), F.col("feature"))
        is_left = F.when(F.col("categories").isNull(), value <= F.col("threshold")).otherwise(F.array_contains("categories", value))
        child = F.when(F.col("left_child") < 0, F.col("node")).when(is_left, F.col("left_child")).otherwise(F.col("right_child"))
        state = met.select(*kept, "_x", "tree", child.alias("node"))
    ends = state.join(steps, (F.col("tree") == F.col("_tree")) & (F.col("node") == F.col("_node")))
    return ends.select(*kept, "tree", "prediction", "weight")


def _depth(nodes: DataFrame) -> int:
    """Levels below the roots: children are followed until none is left. Node tables only."""
    level, depth = nodes.where(F.col("node") == 0).select("tree", "node"), 0
    inner = nodes.where(F.col("left_child") >= 0).select(
        "tree", "node", F.explode(F.array("left_child", "right_child")).alias("child")
    )
    while True:
        level = level.join(inner, ["tree", "node"]).select("tree", F.col("child").alias("node"))
        if level.isEmpty():
            return depth
        depth += 1


def forest_scores(vectors: DataFrame, keys: Sequence[str], vector: str, nodes: DataFrame, name: str = "score") -> DataFrame:
    """keys and the mean over the trees: what a regression forest predicts. ``keys`` identify a row."""
    found = leaves(vectors, keys, vector, nodes)
    return found.groupBy(*keys).agg((F.sum(F.col("prediction") * F.col("weight")) / F.sum("weight")).alias(name))


def boosted_scores(vectors: DataFrame, keys: Sequence[str], vector: str, nodes: DataFrame, name: str = "score") -> DataFrame:
    """keys and the weighted sum of the trees: a boosted regression, or the margin whose sign is the class."""
    found = leaves(vectors, keys, vector, nodes)
    return found.groupBy(*keys).agg(F.sum(F.col("prediction") * F.col("weight")).alias(name))


def node_importance(nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature and importance of a forest: gain times rows, per tree scaled to 1, and over all trees to 1."""
    inner = nodes.where(F.col("left_child") >= 0)
    cells = inner.groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("n_rows")).alias("gain"))
    per_tree = cells.groupBy("tree").agg(F.sum("gain").alias("_whole"))
    shares = cells.join(per_tree, "tree").groupBy("feature").agg(F.sum(F.try_divide("gain", "_whole")).alias("share"))
    names = nodes.sparkSession.createDataFrame(list(enumerate(features)), "feature int, name string")
    # One row per feature slot.
    joined = names.join(bounded_broadcast(shares, len(features)), "feature", "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    whole = one_row(shares.agg(F.sum("share").alias("sum")))["sum"]
    return joined.select(F.col("name").alias("feature"), F.coalesce(F.try_divide(F.col("share"), whole), F.lit(0.0)).alias("importance"))
