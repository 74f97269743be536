"""Fitted trees as a table, and scores by walking it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path


def tree_table(model: Model, spark: SparkSession) -> DataFrame:
    """(tree, weight, levels, node, feature, threshold, left, right, value): one row a node of each tree.

    Inner nodes send a row to ``left`` if its feature, numbered from 0, is at most ``threshold``, else to ``right``; leaves have -1
    there. ``value`` is the leaf's prediction; of a classifier of two classes, the share of the second one. The root is node 0,
    and no leaf is more than ``levels`` below it.
    The model is saved to scratch, and its nodes are read as Spark writes them.
    """
    path = scratch_path(spark, "model")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    each = [(i, float(w), t.depth) for i, (w, t) in enumerate(zip(model.treeWeights, model.trees))]
    weights = spark.createDataFrame(each, "tree int, weight double, levels int")
    value = F.col("prediction")
    if hasattr(model, "numClasses"):
        if model.numClasses > 2:
            raise ValueError("two classes at most")
        stats = F.col("impurityStats")
        value = F.try_divide(F.try_element_at(stats, F.lit(2)), F.aggregate(stats, F.lit(0.0), lambda a, x: a + x))
    return nodes.select(
        F.col("treeID").alias("tree"), F.col("id").alias("node"),
        F.when(F.col("leftChild") >= 0, F.col("split.featureIndex")).alias("feature"),
        F.when(F.col("leftChild") >= 0, F.element_at("split.leftCategoriesOrThreshold", 1)).alias("threshold"),
        F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), value.alias("value"),
    ).join(weights, "tree")


def walk(rows: DataFrame, table: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, score, weight, n_trees): for each row the weighted sum of the leaves it reaches, the trees' weights and number.

    Each tree is one row of arrays; rows meet all trees, and a fold goes down a tree until it stands on a leaf. So a walk is one
    join, however deep the trees are.
    """
    node = F.struct("node", "feature", "threshold", "left", "right", "value")
    packed = table.groupBy("tree", "weight", "levels").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    n_trees = table.agg(F.max("tree")).first()[0] + 1
    features = F.array(*[F.col(c).cast("double") for c in columns])
    each = rows.select(*keys, features.alias("_x"), F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree"))

    def down(at, _):
        n = F.element_at("nodes", at + 1)
        lower = F.element_at("_x", n["feature"] + 1) <= n["threshold"]
        return F.when(n["left"] < 0, at).when(lower, n["left"]).otherwise(n["right"])

    leaf = F.aggregate(F.sequence(F.lit(0), F.col("levels")), F.lit(0), down)
    reached = each.join(packed, "tree").select(*keys, "weight", F.element_at("nodes", leaf + 1)["value"].alias("value"))
    return reached.groupBy(*keys).agg(
        F.sum(F.col("weight") * F.col("value")).alias("score"), F.sum("weight").alias("weight"), F.count("*").alias("n_trees")
    )
